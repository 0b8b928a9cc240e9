"""Files that are new or changed since their source's last successful run.

The processed sequence numbers of a source are those of the observations its successful runs could read; the gaps
between them and all available numbers are what is still to do, late observations included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.instants import normalise_instants
from siltbed.operators.intervals import Ledger, subtract_intervals, to_intervals
from siltbed.session import broadcast_if_small, materialise, scratch_path

LEFT_OUT = ("locked", "error")


def processed_rows(scan: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of ``scan`` that arrived by the greatest cutoff of their source's ``ok`` runs."""
    reach = runs.where((F.col("outcome") == "ok") & F.col("cutoff_at").isNotNull()).groupBy("cloud_id").agg(F.max("cutoff_at").alias("__reach"))
    return scan.join(broadcast_if_small(reach), "cloud_id").where(F.col("arrived_at") <= F.col("__reach")).drop("__reach")


def pending_intervals(scan: DataFrame, runs: DataFrame) -> DataFrame:
    """(cloud_id, block, lo, hi): the numbers that no successful run has read."""
    return subtract_intervals(to_intervals(scan, "cloud_id", "rev"), to_intervals(processed_rows(scan, runs), "cloud_id", "rev"), "cloud_id")


def _readable(scan: DataFrame) -> DataFrame:
    rows = scan.where(~F.coalesce(F.col("status"), F.lit("")).isin(*LEFT_OUT) & F.col("rel_path").isNotNull() & F.col("rev").isNotNull())
    return rows.select("cloud_id", "rel_path", F.col("rev").cast("bigint").alias("rev"), "size", "mtime", "arrived_at")


def _latest(rows: DataFrame) -> DataFrame:
    """The latest observation of each file: the greatest number, then the greatest size and mtime."""
    return rows.groupBy("cloud_id", "rel_path").agg(F.max(F.struct("rev", "size", "mtime")).alias("now"))


class ScanLedger:
    """Scans of files taken in run by run: a ledger whose output is the state of every file that a run touched.

    A run reads the rows whose numbers are not in the ledger yet, late ones included, and compares the files they
    belong to, and only these, with the states that earlier runs have committed.
    """

    STATE = "cloud_id string, rel_path string, rev bigint, size bigint, mtime string, pending boolean"

    def __init__(self, spark: SparkSession, folder: str, registry: DataFrame):
        self.ledger = Ledger(spark, folder, "cloud_id", "rev")
        self.zones = registry.groupBy("cloud_id").agg(F.max("time_zone").alias("zone"), F.max("date_locale").alias("locale"))

    def _process(self, new: DataFrame) -> DataFrame:
        touched = _latest(new)
        if not self.ledger.commits():
            return touched.select("cloud_id", "rel_path", "now.*", F.lit(True).alias("pending"))
        known = self.ledger.output().join(touched.select(F.col("cloud_id").alias("__c"), F.col("rel_path").alias("__p")), F.col("cloud_id").eqNullSafe(F.col("__c")) & (F.col("rel_path") == F.col("__p")), "left_semi")
        before = known.groupBy(F.col("cloud_id").alias("__c"), F.col("rel_path").alias("__p")).agg(F.max(F.struct("rev", "size", "mtime")).alias("before"))
        files = touched.join(before, F.col("cloud_id").eqNullSafe(F.col("__c")) & (F.col("rel_path") == F.col("__p")), "left").drop("__c", "__p")
        now = F.greatest("now", "before")  # a late observation does not replace a later one
        files = materialise(files.select(
            "cloud_id", "rel_path", now.alias("now"), F.col("before").isNull().alias("__new"),
            (~now["size"].eqNullSafe(F.col("before.size"))).alias("__resized"), F.col("before.mtime").alias("__was"), now["mtime"].alias("__is"),
        ), "touched")
        same_text = F.col("__is").eqNullSafe(F.col("__was"))
        plain = F.col("__new") | F.col("__resized") | same_text
        doubt = files.where(~plain).join(broadcast_if_small(self.zones), "cloud_id", "left")
        doubt = normalise_instants(doubt, ["__is", "__was"], "zone", "locale", ["__us_is", "__us_was"])
        state = lambda df, pending: df.select("cloud_id", "rel_path", "now.*", pending.alias("pending"))
        return state(files.where(plain), F.col("__new") | F.col("__resized")).unionByName(state(doubt, ~F.col("__us_is").eqNullSafe(F.col("__us_was"))))

    def take(self, scan: DataFrame) -> DataFrame:
        """Run over ``scan``; (cloud_id, rel_path) of the files that are new or changed since the runs before."""
        number = self.ledger.run(_readable(scan).drop("arrived_at"), self._process)
        return self.ledger.output(number).where("pending").select("cloud_id", "rel_path")


def pending_files(scan: DataFrame, runs: DataFrame, registry: DataFrame, folder: str | None = None) -> DataFrame:
    """(cloud_id, rel_path) whose latest observation differs in size or instant of mtime from the latest processed
    one, or that has no processed one; each once. What the successful runs have read is the ledger's first commit, the
    rest of the scan its second. ``folder``: where the ledger lies, else it lasts for this run only.

    Rows with status locked or error are left out; a null status is like any other. Rows without a path or a number
    are left out. Of rows with one number, which repeat one observation, the greatest (size, mtime) counts. Two null
    sizes are equal, and so are two unreadable mtimes. A source without a successful run, or a null source, has
    nothing processed.
    """
    files = ScanLedger(scan.sparkSession, folder or scratch_path(scan.sparkSession, "ledger"), registry)
    if not files.ledger.commits():
        files.take(processed_rows(scan, runs))
    return files.take(scan)
