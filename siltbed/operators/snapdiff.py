"""What changed between consecutive full snapshots.

Snapshots are kept range-partitioned and sorted by source and path. A delivery of new snapshots is range-partitioned and
sorted the same way and merged with what is kept: in each range one streaming pass over the sorted rows compares every
entry with its neighbour, which is the two-pointer merge of each snapshot with the one before it, and emits typed changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.commits import Commits
from siltbed.operators.snapshots import entries_of, states_of
from siltbed.session import broadcast_if_small, materialise, scratch_path

#: In how many deliveries a whole history is taken: each source's snapshots, in their order, by equal shares.
DELIVERIES = 2


def compare_neighbours(states: DataFrame) -> DataFrame:
    """``states`` (cloud_id, path, snap, first_snap, last_snap, content_hash, ...) with ``changes``, an array of (at, kind),
    and ``newest``: whether it is the path's last entry.

    ``added``: the path is not in the snapshot before, unless there is none before; ``removed``: it is not in the next
    snapshot, reported there; ``changed``: both have it with another content_hash (two nulls are equal).
    """
    path = Window.partitionBy("cloud_id", "path").orderBy("snap")
    near = states.withColumns({"__was_at": F.lag("snap").over(path), "__was": F.lag("content_hash").over(path), "__next_at": F.lead("snap").over(path)})
    follows = F.coalesce(F.col("__was_at") == F.col("snap") - 1, F.lit(False))
    here = F.when(~follows & (F.col("snap") > F.col("first_snap")), "added").when(follows & ~F.col("content_hash").eqNullSafe(F.col("__was")), "changed")
    gone = F.when((F.col("snap") < F.col("last_snap")) & F.coalesce(F.col("__next_at") > F.col("snap") + 1, F.lit(True)), "removed")
    changes = F.filter(F.array(F.struct(F.col("snap").alias("at"), here.alias("kind")), F.struct((F.col("snap") + 1).alias("at"), gone.alias("kind"))), lambda c: c.kind.isNotNull())
    return near.withColumns({"changes": changes, "newest": F.col("__next_at").isNull()}).drop("__was_at", "__was", "__next_at")


class SnapshotStore:
    """The last entry of every path of every source, in range partitions sorted by source and path, and how far each
    source has been taken; with each commit (see ``commits``) the changes that it brought.

    A new delivery is merged with these entries only, however long the history is. A path that is gone stays, for an
    unreadable entry may later refer to its last contents. Snapshots must be taken in their order within a source; one
    that is not later than those taken already is refused. A null source is a source; empty deliveries commit nothing new.
    """

    ENTRIES = "cloud_id string, path string, snap bigint, content_hash string, mtime string, was_read boolean"
    TAKEN = "cloud_id string, first_snap bigint, taken bigint"
    CHANGES = "cloud_id string, snap bigint, path string, change_kind string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, Commits(spark, folder)

    def changes(self) -> DataFrame:
        """Those of all commits: (cloud_id, snap, path, change_kind)."""
        return self.log.tables([f"{self.log.read(n)['data']}/changes" for n in self.log.numbers()], self.CHANGES)

    def take(self, entries: DataFrame, snapshots: DataFrame, attempts: int = 5) -> int:
        """Merge new snapshots; returns the commit's number. ``snapshots``: cloud_id, snap, consecutive within a source;
        one without entries is a snapshot of no files. ``entries``: cloud_id, path, snap, pos, entry_id, not_read,
        content_hash, mtime."""
        for _ in range(attempts):
            last, content = self.log.latest()
            data = self.log.stage()
            self._write(data, [content["data"]] if content else [], entries, snapshots)
            if self.log.commit(last + 1, {"data": data}):
                return last + 1
        raise RuntimeError(f"{attempts} commits in a row were taken by other runs")

    def _write(self, data: str, there: list[str], entries: DataFrame, snapshots: DataFrame) -> None:
        kept = self.log.tables([f"{d}/entries" for d in there], self.ENTRIES)
        taken = self.log.tables([f"{d}/taken" for d in there], self.TAKEN)
        new = snapshots.groupBy(F.col("cloud_id").alias("__cloud")).agg(F.min("snap").alias("lo"), F.max("snap").alias("hi"))
        both = taken.join(new, F.col("cloud_id").eqNullSafe(F.col("__cloud")), "full")
        reach = both.select(
            F.coalesce("cloud_id", "__cloud").alias("cloud_id"), F.coalesce("first_snap", "lo").alias("first_snap"),
            F.greatest("taken", "hi").alias("last_snap"), F.coalesce("taken", F.lit(-1)).alias("taken"), "lo",
        )
        reach = materialise(reach, "reach")
        if late := reach.where("lo <= taken").limit(1).collect():
            raise ValueError(f"snapshots of {late[0].cloud_id} up to {late[0].taken} were taken already")
        common = lambda df, not_read, pos, entry: df.select("cloud_id", "path", "snap", not_read.alias("not_read"), pos.cast("int").alias("pos"), entry.cast("bigint").alias("entry_id"), "content_hash", "mtime")
        rows = common(kept, ~F.col("was_read"), F.lit(0), F.lit(0)).unionByName(common(entries, F.col("not_read"), F.col("pos"), F.col("entry_id")))
        of_source = reach.select(F.col("cloud_id").alias("__cloud"), "first_snap", "last_snap", "taken")
        rows = rows.join(broadcast_if_small(of_source), F.col("cloud_id").eqNullSafe(F.col("__cloud"))).drop("__cloud")
        merged = materialise(compare_neighbours(states_of(rows.repartitionByRange("cloud_id", "path"))), "merged")
        found = merged.where(F.size("changes") > 0).select("cloud_id", "path", "taken", F.explode("changes").alias("c")).where("c.at > taken")
        found.select("cloud_id", F.col("c.at").alias("snap"), "path", F.col("c.kind").alias("change_kind")).write.parquet(f"{data}/changes")
        # In the order of the merge, so the ranges and their sorting are kept.
        merged.where("newest").select("cloud_id", "path", "snap", "content_hash", "mtime", "was_read").write.option("compression", "zstd").parquet(f"{data}/entries")
        reach.select("cloud_id", "first_snap", F.col("last_snap").alias("taken")).write.parquet(f"{data}/taken")


def snapshot_changes(files: DataFrame, snapshots: DataFrame, folder: str | None = None, deliveries: int = DELIVERIES) -> DataFrame:
    """(manifest_id, path, change_kind) of each manifest but a source's first against the one before it. The history goes
    into a store (at ``folder``, else for this run only) in ``deliveries``, each merged with what the ones before left."""
    store = SnapshotStore(files.sparkSession, folder or scratch_path(files.sparkSession, "snapshots"))
    share = F.floor((F.col("snap") - F.col("first_snap")) * deliveries / (F.col("last_snap") - F.col("first_snap") + 1))
    for turn in range(deliveries):
        some = snapshots.where(share == turn)
        store.take(entries_of(files, some).withColumn("mtime", F.lit(None).cast("string")), some)
    ids = snapshots.select("snap", "manifest_id")
    return store.changes().join(broadcast_if_small(ids), "snap").select("manifest_id", "path", "change_kind")


def diff_tables(before: DataFrame, after: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """Typed changes between two snapshots of any table: the key, change_kind and changed_columns.

    Keys are compared null-safe and so are the columns; of rows that repeat a key the greatest counts. Columns that
    only one side has are not compared. Both sides are range-partitioned by key once; the aggregation works
    within these partitions, in the order of the key.
    """
    side = lambda df, n: df.select(*key, F.lit(n).alias("__side"), F.struct(*compare).alias("__row"))
    at = lambda n: F.max(F.when(F.col("__side") == n, F.col("__row")))
    both = side(before, 0).unionByName(side(after, 1)).repartitionByRange(*key)
    merged = both.groupBy(*key).agg(at(0).alias("__old"), at(1).alias("__new"))
    differs = F.filter(F.array(*[F.when(~F.col(f"__old.{c}").eqNullSafe(F.col(f"__new.{c}")), F.lit(c)) for c in compare]), lambda c: c.isNotNull())
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.size(differs) > 0, "changed")
    return merged.select(*key, kind.alias("change_kind"), F.when(kind == "changed", differs).alias("changed_columns")).where(F.col("change_kind").isNotNull())
