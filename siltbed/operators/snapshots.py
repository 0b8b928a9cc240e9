"""The order of snapshots, and the state of every path in each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.instants import normalise_instants
from siltbed.session import broadcast_if_small, materialise

NOT_READ = ("locked", "error")


def number_rows(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """``df`` with consecutive numbers in the given total order, without bringing rows to one task: range partitions
    are numbered on their own and shifted by the sizes of those before. The table of sizes has one row a partition."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    kept = materialise(spread, "numbered")
    kept = kept.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND((1 << 33) - 1)})
    sizes = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return kept.join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + F.col("__at")).drop("__id", "__part", "__at", "__before")


def ordered_snapshots(manifests: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per snapshot: cloud_id, manifest_id, snap (consecutive numbers in snapshot order; those of one source
    follow each other), first_snap and last_snap of the source, zone and locale.

    Repeated rows count once. An unreadable ts sorts before all others of its source.
    """
    zones = registry.groupBy("cloud_id").agg(F.max("time_zone").alias("zone"), F.max("date_locale").alias("locale"))
    one = manifests.where(F.col("manifest_id").isNotNull()).groupBy("manifest_id").agg(F.max(F.struct("cloud_id", "ts")).alias("m")).select("manifest_id", "m.*")
    one = normalise_instants(one.join(broadcast_if_small(zones), "cloud_id", "left"), "ts", "zone", "locale", "ts_us")
    numbered = number_rows(one, ["cloud_id", "ts_us", "manifest_id"], "snap")
    bounds = numbered.groupBy("cloud_id").agg(F.min("snap").alias("first_snap"), F.max("snap").alias("last_snap"))
    bounds = bounds.withColumnRenamed("cloud_id", "__cloud")
    bounded = numbered.join(broadcast_if_small(bounds), F.col("cloud_id").eqNullSafe(F.col("__cloud"))).drop("__cloud")
    return materialise(bounded, "snapshots")


def normal_path(path: Column) -> Column:
    r"""``\`` becomes ``/``, then one leading ``/`` is dropped."""
    slashes = F.translate(path, "\\", "/")
    return F.when(slashes.startswith("/"), F.substring(slashes, F.lit(2), F.length(slashes))).otherwise(slashes)


def entries_of(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Entries with their snapshot: cloud_id, path (normal), snap, first_snap, last_snap, zone, locale, pos, entry_id,
    not_read, content_hash, mtime. Entries without a path or a manifest are left out."""
    snaps = snapshots.select("manifest_id", "cloud_id", "snap", "first_snap", "last_snap", "zone", "locale")
    wanted = files.where(F.col("path").isNotNull()).select(
        "manifest_id", normal_path(F.col("path")).alias("path"), "pos", "entry_id",
        F.coalesce(F.col("status"), F.lit("")).isin(*NOT_READ).alias("not_read"), "content_hash", "mtime",
    )
    return wanted.join(broadcast_if_small(snaps), "manifest_id").drop("manifest_id")


def states_of(entries: DataFrame) -> DataFrame:
    """One row per path and snapshot with the content_hash and mtime that hold there: of entries that share a path
    the one with the greatest pos (then entry_id); one that could not be read keeps those of the path's latest
    earlier one that could, or its own if there is none. ``entries`` should be partitioned by cloud_id and path;
    all of the windows below then work within these partitions, over one sort. ``was_read``: whether the values come from
    an entry that could be read."""
    path = Window.partitionBy("cloud_id", "path")
    last = entries.withColumn("__nth", F.row_number().over(Window.partitionBy("cloud_id", "path", "snap").orderBy(F.desc("pos"), F.desc("entry_id")))).where("__nth = 1").drop("__nth")
    so_far = path.orderBy("snap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    read = F.last(F.when(~F.col("not_read"), F.struct("content_hash", "mtime")), ignorenulls=True).over(so_far)
    held = last.withColumn("__read", read).withColumn("__held", F.coalesce(F.when(F.col("not_read"), F.col("__read")), F.struct("content_hash", "mtime")))
    held = held.withColumns({"content_hash": F.col("__held.content_hash"), "mtime": F.col("__held.mtime"), "was_read": F.col("__read").isNotNull()})
    return held.drop("__held", "__read", "not_read", "pos", "entry_id")
