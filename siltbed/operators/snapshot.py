"""Comparing a scan with the previous snapshot, and what a snapshot is summed up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.functions.paths import ancestors, base_name, dir_name

NOT_STORED = ("locked", "error")


def status_of(had: Column, now: Column, before: Column) -> Column:
    """new, changed or unchanged; a previous row that failed (empty hash) makes it changed, not new."""
    return F.when(~had, "new").when(~now.eqNullSafe(before), "changed").otherwise("unchanged")


def classify(current: DataFrame, previous: DataFrame) -> DataFrame:
    """One row per path of either side: path, status (with deleted), size, content_hash. One full outer join."""
    now = current.select("path", F.col("size").alias("now_size"), F.col("content_hash").alias("now_hash"), F.lit(True).alias("here"))
    before = previous.select("path", F.col("size").alias("was_size"), F.col("content_hash").alias("was_hash"), F.lit(True).alias("there"))
    both = now.join(before, "path", "full")
    status = F.when(F.col("here").isNull(), "deleted").otherwise(status_of(F.col("there").isNotNull(), F.col("now_hash"), F.col("was_hash")))
    return both.select("path", status.alias("status"), F.when(F.col("here").isNull(), F.col("was_size")).otherwise(F.col("now_size")).alias("size"), F.when(F.col("here").isNull(), F.col("was_hash")).otherwise(F.col("now_hash")).alias("content_hash"))


def classify_pairs(rows: DataFrame, key: list[str]) -> DataFrame:
    """The same from rows of both sides (``back`` 1: the snapshot, 2: the one before it) by one aggregation: of rows that
    share a key and side the one with the greatest ``pos`` counts. Needs size and content_hash."""
    at = lambda n: F.max(F.when(F.col("back") == n, F.struct("pos", "content_hash", "size")))
    both = rows.where(F.col("back").isin(1, 2)).groupBy(*key).agg(at(1).alias("now"), at(2).alias("was"))
    status = F.when(F.col("now").isNull(), "deleted").otherwise(status_of(F.col("was").isNotNull(), F.col("now.content_hash"), F.col("was.content_hash")))
    held = F.coalesce("now", "was")
    return both.select(*key, status.alias("status"), held["size"].alias("size"), held["content_hash"].alias("content_hash"))


def scan_counters(scan: DataFrame) -> DataFrame:
    """One row: files by outcome, those that failed or were locked or skipped too; any other status is ``other``."""
    names = {"new": "new_files", "changed": "changed_files", "unchanged": "unchanged_files", "error": "failed_files", "locked": "locked_files", "skipped": "skipped_files"}
    status = F.coalesce("status", F.lit(""))
    return scan.agg(*[F.count_if(status == s).alias(n) for s, n in names.items()], F.count_if(~status.isin(*names)).alias("other_files"))


def is_fast_unchanged(mtime: Column, size: Column, was_mtime: Column, was_size: Column, was_hash: Column) -> Column:
    """Same mtime text and size and a previous hash: the content need not be read."""
    return F.coalesce((mtime == was_mtime) & (size == was_size) & (F.length(was_hash) >= 2), F.lit(False))


def two_phase(current: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are unchanged by their metadata, and those whose content must be read."""
    before = previous.select("path", F.col("mtime").alias("was_mtime"), F.col("size").alias("was_size"), F.col("content_hash").alias("was_hash"))
    joined = current.join(before, "path", "left").withColumn("fast", is_fast_unchanged(F.col("mtime"), F.col("size"), F.col("was_mtime"), F.col("was_size"), F.col("was_hash")))
    return joined.where("fast").drop("fast"), joined.where("not fast").drop("fast")


def deleted(current: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.join(current.select("path"), "path", "left_anti")


def status_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def snapshot_stats(classified: DataFrame) -> DataFrame:
    """One row: the counters of a manifest and the share of unchanged files."""
    of = lambda s: F.count_if(F.col("status") == s)
    here = F.col("status") != "deleted"
    new_bytes = F.coalesce(F.sum(F.when(F.col("status").isin("new", "changed"), F.col("size"))), F.lit(0))
    seen = of("new") + of("changed") + of("unchanged")
    return classified.agg(
        F.count_if(here).alias("file_count"), F.coalesce(F.sum(F.when(here, F.col("size"))), F.lit(0)).alias("total_size"),
        of("new").alias("new_files"), of("changed").alias("changed_files"), of("unchanged").alias("unchanged_files"), of("deleted").alias("deleted_files"),
        new_bytes.alias("new_bytes"), F.coalesce(of("unchanged") / F.nullif(seen, F.lit(0)), F.lit(0.0)).alias("dedup_ratio"),
    )


def directory_children(paths: DataFrame) -> DataFrame:
    """Per directory, every ancestor included: number of files in it and of distinct child directories."""
    files = paths.groupBy(dir_name(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("files"))
    dirs = paths.select(F.explode(ancestors(F.col("path"))).alias("dir")).distinct()
    children = dirs.where("dir <> ''").groupBy(dir_name(F.col("dir")).alias("parent")).agg(F.count(F.lit(1)).alias("subdirs"))
    joined = dirs.join(files, "dir", "left").join(children, dirs.dir == children.parent, "left")
    return joined.select("dir", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("subdirs", F.lit(0)).alias("subdirs"))


def empty_directories(scan: DataFrame) -> DataFrame:
    """Directories without a file below them and without a child directory; rows rel_path, is_dir."""
    dirs = scan.where("is_dir").select(F.col("rel_path").alias("dir")).distinct()
    filled = scan.where("not is_dir").select(F.explode(ancestors(F.col("rel_path"))).alias("dir"))
    parents = dirs.select(dir_name(F.col("dir")).alias("dir"))
    return dirs.join(filled.unionByName(parents).distinct(), "dir", "left_anti")


def directory_documents(entries: DataFrame) -> DataFrame:
    """Per directory its files as an array of structs and its child directories; the nested form of a manifest."""
    files = entries.groupBy(dir_name(F.col("path")).alias("dir")).agg(F.array_sort(F.collect_list(F.struct(base_name(F.col("path")).alias("name"), F.col("content_hash").alias("contentHash"), "size", "mtime"))).alias("files"))
    dirs = entries.select(F.explode(ancestors(F.col("path"))).alias("dir")).distinct()
    subdirs = dirs.where("dir <> ''").groupBy(dir_name(F.col("dir")).alias("dir")).agg(F.array_sort(F.collect_list(base_name(F.col("dir")))).alias("subdirs"))
    return dirs.join(files, "dir", "left").join(subdirs, "dir", "left")
