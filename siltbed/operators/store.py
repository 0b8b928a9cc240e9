"""The content-addressed store: what is referenced, what is garbage, what has to be uploaded."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.paths import is_hash
from siltbed.operators.chunking import reassemble
from siltbed.session import materialise, parallelism


#: An entry that has contents to restore.
RESTORABLE = "coalesce(status, '') NOT IN ('locked', 'error') AND coalesce(content_hash, '') <> ''"


def references(entries: DataFrame) -> DataFrame:
    """hash, one row per reference, repetitions kept: a file's chunks if it has any, else its content hash. Empty and
    null hashes are no references."""
    chunked = F.size(F.coalesce("chunks", F.array().cast("array<struct<hash:string,size:bigint>>"))) > 0
    listed = F.when(chunked, F.col("chunks.hash")).otherwise(F.array("content_hash"))
    return entries.select(F.explode(listed).alias("hash")).where("hash <> ''")


def row_references(entries: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """The same where chunks are rows of a table of their own: ``chunks`` (key, hash), ``entries`` (key, content_hash),
    each row once. No list is built, so a file may have any share of the chunks."""
    whole = entries.select(key, F.col("content_hash").alias("hash")).join(chunks.select(key).distinct(), key, "left_anti")
    return chunks.select("hash").unionByName(whole.select("hash")).where("hash <> ''")


def alive_set(entries: DataFrame) -> DataFrame:
    return references(entries).distinct()


def garbage(listing: DataFrame, alive: DataFrame) -> DataFrame:
    """Stored blobs that nothing refers to."""
    return listing.join(alive.select("hash"), "hash", "left_anti")


def new_blobs(candidates: DataFrame, store: DataFrame) -> DataFrame:
    """One candidate per valid hash that the store does not hold; the smallest by the other columns."""
    rest = [c for c in candidates.columns if c != "hash"]
    once = candidates.where(is_hash(F.col("hash"))).groupBy("hash").agg(F.min(F.struct(*rest)).alias("c")).select("hash", "c.*")
    return once.join(store.select("hash"), "hash", "left_anti")


def all_present(chunks: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """key, present: whether every chunk of the key is stored."""
    held = store.select("hash", F.lit(True).alias("held")).distinct()
    return chunks.join(held, "hash", "left").groupBy(key).agg(F.bool_and(F.col("held").isNotNull()).alias("present"))


def changed_chunks(chunks: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Chunks of a file that the same file did not have before; those of other files do not count."""
    return chunks.join(previous.select(key, "hash").distinct(), [key, "hash"], "left_anti")


def list_blobs(listing: DataFrame, prefix: str) -> DataFrame:
    """Blobs of the shards that begin with ``prefix``; shards have two letters, so a longer prefix lists nothing."""
    return listing.where(is_hash(F.col("hash")) & F.substring("hash", 1, 2).startswith(prefix))


def shard_of(hash_: Column) -> Column:
    return F.substring(hash_, 1, 2)


#: Bytes of payload wanted in one file of the store.
FILE_BYTES = 256 << 20


class BlobStore:
    """Blobs by hash at ``path``, parquet by shard; the interface that any other store would have, too. Hashes that are
    not 64 lower-case hex digits are never there."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "hash string, payload binary, shard string"):
        self.spark, self.path, self.schema = spark, path, schema
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if self._fs.exists(self._at) else self.spark.createDataFrame([], self.schema)

    def put(self, blobs: DataFrame) -> int:
        return put(blobs, self.path)

    def get(self, hash_: str) -> DataFrame:
        """The one blob, read from its shard alone; an invalid hash is an error."""
        if not re.fullmatch("[0-9a-f]{64}", hash_):
            raise ValueError(f"{hash_!r} is no hash")
        return self.rows().where((F.col("shard") == hash_[:2]) & (F.col("hash") == hash_))

    def exists(self, wanted: DataFrame) -> DataFrame:
        return exists(wanted, self.rows())

    def delete(self, hashes: DataFrame) -> int:
        """Remove blobs; how many there were. What is not there is no error. Each shard that holds one is written anew
        beside the old one and put in its place; the others are not touched."""
        doomed = hashes.where(is_hash(F.col("hash"))).select("hash").distinct()
        hit = self.rows().select("hash", "shard").join(doomed, "hash", "left_semi").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 256
        if not hit:
            return 0
        shards, temp = [r.shard for r in hit], f"{self.path}.rewrite-{uuid.uuid4().hex}"
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.rows().where(F.col("shard").isin(shards)).join(doomed, "hash", "left_anti").write.partitionBy("shard").parquet(temp)
        for shard in shards:
            old, new = path(f"{self.path}/shard={shard}"), path(f"{temp}/shard={shard}")
            self._fs.delete(old, True)
            if self._fs.exists(new):
                self._fs.rename(new, old)
        self._fs.delete(path(temp), True)
        self.spark.catalog.refreshByPath(self.path)
        return sum(r.n for r in hit)


def exists(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """``wanted`` with ``there``: whether its hash is stored; an invalid or null hash is not, without an error."""
    held = stored.where(is_hash(F.col("hash"))).select(F.col("hash").alias("__hash")).distinct()
    return wanted.join(held, F.col("hash") == F.col("__hash"), "left").withColumn("there", F.col("__hash").isNotNull()).drop("__hash")


def listing(blobs: DataFrame, prefix: str = "") -> DataFrame:
    """hash, mod_time and stored_size (0 where unknown) of the blobs that :func:`list_blobs` lists."""
    return list_blobs(blobs, prefix).select("hash", "mod_time", F.coalesce("stored_size", F.lit(0)).alias("stored_size"))


def put(blobs: DataFrame, path: str) -> int:
    """Append to the store at ``path`` (parquet by shard) what it does not hold yet; returns how many were new. Doing it
    twice adds nothing. New blobs are written once to the shared folder; a shard is then spread over as many tasks as its
    share of the bytes asks for."""
    spark = blobs.sparkSession
    kept = BlobStore(spark, path, "hash string, shard string")
    fresh = materialise(new_blobs(blobs, kept.rows().select("hash")), "fresh-blobs")
    size = [F.octet_length(c) for c, kind in fresh.dtypes if kind == "binary"] or [F.lit(0)]
    added, total = fresh.agg(F.count(F.lit(1)), F.coalesce(F.sum(reduce(lambda a, b: a + b, size).cast("bigint")), F.lit(0))).first()
    if added or not kept._fs.exists(kept._at):
        salts = max(1, -(-total // (256 * FILE_BYTES)))
        spread = fresh.withColumn("shard", shard_of(F.col("hash"))).repartition(min(256, parallelism(spark)) * salts, "shard", F.pmod(F.xxhash64("hash"), F.lit(salts)))
        spread.write.partitionBy("shard").mode("append").parquet(path)
    return added


def restore_parts(entries: DataFrame) -> DataFrame:
    """path, seq, hash of what makes up each entry's content: its chunks in order, or the one blob."""
    listed = F.when(F.size("chunks") > 0, F.col("chunks.hash")).otherwise(F.array("content_hash"))
    return entries.select("path", F.posexplode(listed).alias("seq", "hash"))


def restore(entries: DataFrame, chunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """path, content of every entry that can be restored; a missing blob is an error. ``chunks``: path, seq, hash. For
    contents that fit a row; ``plans.backup.restore`` writes files of any size."""
    wanted = entries.where(RESTORABLE)
    parts = wanted.select("path").join(chunks, "path")
    whole = wanted.join(chunks.select("path").distinct(), "path", "left_anti").select("path", F.lit(0).alias("seq"), F.col("content_hash").alias("hash"))
    joined = parts.select("path", "seq", "hash").unionByName(whole).join(blobs.select("hash", "payload"), "hash", "left")
    checked = joined.withColumn("payload", F.when(F.col("payload").isNull(), F.raise_error(F.concat(F.lit("missing blob "), "hash"))).otherwise(F.col("payload")))
    return reassemble(checked, "path", "seq", "payload")
