"""The two end-to-end flows: take a snapshot of a directory tree into a content-addressed store, and restore one.

    <repo>/blobs/shard=ab/...                hash, payload, is_compressed, is_sealed; one row per distinct content
    <repo>/entries/<source>/<random>/        one row per file of a snapshot, with its ordered chunk list
    <repo>/commits/<source>/<seconds>.json   counters and the folder of entries; only a committed snapshot is ever read
    <repo>/manifests/, <repo>/manifests/_sources/   the checksummed manifest document and the source's registry

Metadata is compared first, so unchanged files are not opened. What is opened is read once, piece by piece, into a staged
table from which hashes, chunk lists and stored payloads are all taken; a file that changes meanwhile cannot make them
differ. Blobs are stored before the snapshot that needs them, and it is committed only when all that it refers to is there.
"""

from __future__ import annotations

import hashlib
import json
import os
import secrets
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import codecs, frames
from siltbed.functions.paths import safe_relative
from siltbed.operators import chunking, snapshot, store
from siltbed.session import broadcast_if_small, materialise, ship
from siltbed.sources import manifests
from siltbed.sources.files import create_atomic
from siltbed.sources.sealed import opened_pieces
from siltbed.sources.tree import TreeSource, is_lock_error, open_with_retry

ENTRY = "path string, content_hash string, size bigint, mtime string, mode int, status string, chunks array<struct<hash:string,size:bigint>>"
PIECES = "path string, seq int, piece binary, hash string, size bigint, content_hash string, status string"
#: Payloads travel to and from Python in batches of so many bytes.
BATCH_BYTES = 64 << 20


@dataclass
class Repository:
    spark: SparkSession
    folder: str
    chunk_bytes: int = chunking.CHUNK_BYTES
    compress_from: int = codecs.COMPRESS_FROM
    #: 32 bytes to seal payloads with, or None.
    key: bytes | None = None
    excludes: list[str] = field(default_factory=list)
    #: Whose manifests these are.
    device: str = "local"

    def __post_init__(self) -> None:
        ship(self.spark)
        self.spark.dataSource.register(TreeSource)
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def snapshots(self, source: str) -> list[int]:
        folder = f"{self.folder}/commits/{source}"
        names = [n.removesuffix(".json") for n in os.listdir(folder)] if os.path.isdir(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def commit(self, source: str, seconds: int) -> dict:
        with open(f"{self.folder}/commits/{source}/{seconds}.json") as f:
            return json.load(f)

    def entries(self, source: str, seconds: int | None = None) -> DataFrame:
        """Files of one snapshot, the latest unless told which; none before the first."""
        known = self.snapshots(source)
        if seconds is not None and seconds not in known:
            raise LookupError(f"{source} has no snapshot {seconds}")
        if not known:
            return self.spark.createDataFrame([], ENTRY)
        commit = self.commit(source, known[-1] if seconds is None else seconds)
        return self.spark.read.schema(ENTRY).parquet(f"{self.folder}/entries/{source}/{commit['entries']}")

    def blobs(self) -> DataFrame:
        return store.BlobStore(self.spark, f"{self.folder}/blobs", "hash string, payload binary, is_compressed boolean, is_sealed boolean, shard string").rows()


def _pieces(files: DataFrame, size: int) -> DataFrame:
    """Pieces of ``size`` bytes of each file (path, abs_path), read in order where the task runs, and after them one row
    with seq -1 that has the whole file's hash and length. Memory holds one piece. A file that cannot be read, or not to
    its end, has a status instead of a hash."""
    schema = pa.schema([("path", pa.string()), ("seq", pa.int32()), ("piece", pa.binary()), ("hash", pa.string()), ("size", pa.int64()), ("content_hash", pa.string()), ("status", pa.string())])
    row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    def work(batches):
        for batch in batches:
            for path, place in zip(batch.column("path").to_pylist(), batch.column("abs_path").to_pylist()):
                whole, total, seq = hashlib.sha256(), 0, 0
                try:
                    with open_with_retry(place) as f:
                        while (piece := f.read(size)) or seq == 0:
                            whole.update(piece)
                            yield row(path, seq, piece, hashlib.sha256(piece).hexdigest(), len(piece), None, None)
                            total, seq = total + len(piece), seq + 1
                except OSError as e:
                    yield row(path, -1, None, None, None, None, "locked" if is_lock_error(e) else "error")
                    continue
                yield row(path, -1, None, None, total, whole.hexdigest(), None)

    return files.select("path", "abs_path").mapInArrow(work, PIECES)


def _payloads(repo: Repository, pieces: DataFrame) -> DataFrame:
    """hash, payload and its flags of new pieces (path, hash, piece): compressed where useful, then sealed."""
    packed = codecs.compress_if_useful(pieces.select("hash", "path", "piece"), "path", "piece", repo.compress_from)
    if repo.key is None:
        return packed.select("hash", F.col("stored").alias("payload"), "is_compressed", F.lit(False).alias("is_sealed"))
    sealed = frames.small_frame(F.col("stored"), F.lit(repo.key), frames.random_iv(F.col("hash"), small=True))
    return packed.select("hash", sealed.alias("payload"), "is_compressed", F.lit(True).alias("is_sealed"))


def _referred(entries: DataFrame) -> DataFrame:
    return store.references(entries).select("hash")


def backup(repo: Repository, root: str, source: str, now: int | None = None, progress=None) -> dict:
    """Take a snapshot of ``root``; returns its counters. A second snapshot in one second gets the next free second.
    ``progress``, if given, is called with the counters when the phase changes."""
    spark = repo.spark
    tell = progress or (lambda **_: None)
    tell(phase="scanning")
    scan = spark.read.format("tree").option("excludes", "\n".join(repo.excludes)).load(root)
    files = materialise(scan.where("not is_dir").select(F.col("rel_path").alias("path"), "abs_path", "size", "mtime", "mode"), "scan")
    before = repo.entries(source)
    held = repo.blobs().select("hash").distinct()

    # Unchanged by metadata, and every blob that the previous row refers to is still stored.
    wanted = before.select("path", F.explode(F.when(F.size("chunks") > 0, F.col("chunks.hash")).otherwise(F.array("content_hash"))).alias("hash"))
    whole = store.all_present(wanted, held, "path").where("present").select("path")
    fast, _ = snapshot.two_phase(files, before)
    fast = materialise(fast.join(whole, "path", "left_semi").select("path"), "fast")
    kept = files.join(fast, "path").join(before.select("path", "content_hash", "chunks"), "path").select("path", "content_hash", "size", "mtime", "mode", F.lit("unchanged").alias("status"), "chunks")

    tell(phase="uploading")
    # The one time that contents are read; everything below is taken from this table.
    staged = materialise(_pieces(files.join(fast, "path", "left_anti"), repo.chunk_bytes), "pieces")
    facts = staged.where("seq < 0").select("path", "content_hash", F.col("size").alias("read_size"), F.col("status").alias("failed"))
    pieces = staged.where("seq >= 0").join(broadcast_if_small(facts.where("failed is not null").select("path")), "path", "left_anti")
    # J2: contents that are not stored yet are packed, each once; which row stands for a content is told by narrow columns.
    chosen = pieces.select("path", "seq", "hash").join(held, "hash", "left_anti").groupBy("hash").agg(F.min(F.struct("path", "seq")).alias("at")).select("at.path", "at.seq")
    fresh = pieces.join(broadcast_if_small(materialise(chosen, "chosen")), ["path", "seq"])
    uploaded = store.put(_payloads(repo, fresh), f"{repo.folder}/blobs")

    listed = pieces.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "hash", "size"))).alias("c"))
    chunk = F.when(F.col("read_size") >= repo.chunk_bytes, F.transform("c", lambda p: F.struct(p["hash"].alias("hash"), p["size"].alias("size"))))
    was = before.select("path", F.coalesce("content_hash", F.lit("")).alias("was_hash"))
    status = F.coalesce("failed", snapshot.status_of(F.col("was_hash").isNotNull(), F.col("content_hash"), F.col("was_hash")))
    slow = files.join(facts, "path").join(listed, "path", "left").join(was, "path", "left")
    slow = slow.select("path", "content_hash", F.coalesce("read_size", "size").alias("size"), "mtime", "mode", status.alias("status"), chunk.alias("chunks"))
    name = secrets.token_hex(8)
    target = f"{repo.folder}/entries/{source}/{name}"
    kept.unionByName(slow).write.parquet(target)

    written = spark.read.schema(ENTRY).parquet(target)
    lost = _referred(written).distinct().join(repo.blobs().select("hash"), "hash", "left_anti").count()
    if lost:
        raise RuntimeError(f"{lost} contents of the snapshot are not in the store; it is not committed")
    counts = {r.status: (r["count"], r.bytes) for r in written.groupBy("status").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("bytes")).collect()}
    result = {"source": source, "entries": name, "blobs": uploaded, "deleted": snapshot.deleted(written, before).count(), "bytes": sum(b or 0 for _, b in counts.values())}
    result |= {s: counts.get(s, (0, 0))[0] for s in ("new", "changed", "unchanged", "error", "locked")}
    os.makedirs(f"{repo.folder}/commits/{source}", exist_ok=True)
    seconds = int(time.time()) if now is None else now
    while not create_atomic(f"{repo.folder}/commits/{source}/{seconds}.json", json.dumps(result | {"seconds": seconds}).encode()):
        seconds += 1
    result["seconds"] = seconds
    _publish(repo, source, seconds, written, result)
    tell(phase="complete", **{k: v for k, v in result.items() if isinstance(v, int)})
    return result


def _publish(repo: Repository, source: str, seconds: int, entries: DataFrame, result: dict) -> None:
    """The snapshot's manifest document with its checksum, and the source's registry."""
    stamp = datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    total = sum(result[s] for s in ("new", "changed", "unchanged", "error", "locked"))
    stats = {"fileCount": total, "totalSize": result["bytes"], "newFiles": result["new"], "changedFiles": result["changed"], "unchangedFiles": result["unchanged"], "newBytes": 0}
    header = {"version": 2, "cloudId": source, "deviceId": repo.device, "timestamp": stamp, "stats": stats}
    manifests.write_manifest(repo.folder, header, manifests.folder_documents(entries))
    known = manifests.load_registry(repo.folder, repo.device, source) or {"cloudId": source, "deviceId": repo.device, "createdAt": stamp, "snapshotCount": 0}
    manifests.save_registry(repo.folder, known | {"lastSnapshot": stamp, "snapshotCount": known["snapshotCount"] + 1})


def opened_blobs(repo: Repository, wanted: DataFrame | None = None) -> DataFrame:
    """hash, payload as plain content, of the hashes in ``wanted`` only: their shards are read, the others pruned, and only
    what matches is opened. A payload that does not open or whose hash differs is an error."""
    blobs = repo.blobs()
    if wanted is not None:
        shards = [r[0] for r in wanted.select(store.shard_of(F.col("hash"))).distinct().collect()]  # at most 256
        blobs = blobs.where(F.col("shard").isin(shards)).join(broadcast_if_small(wanted.select("hash").distinct()), "hash", "left_semi")
    key = F.lit(repo.key if repo.key is not None else b"\x00" * 32)
    data = F.when(F.col("is_sealed"), frames.open_frame(F.col("payload"), key, repo.chunk_bytes)).otherwise(F.col("payload"))
    plain = blobs.withColumn("data", data)
    plain = plain.withColumn("data", F.when(F.col("is_compressed"), codecs.decompressed(F.when(F.col("is_compressed"), F.col("data")))).otherwise(F.col("data")))
    good = F.coalesce(F.sha2("data", 256) == F.col("hash"), F.lit(False))
    return plain.select("hash", F.when(good, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("damaged blob "), "hash"))).alias("payload"))


def _existing(entries: DataFrame, target: str) -> DataFrame:
    """Entries (path, safe, ...) with ``there``: whether the file is below ``target`` already."""

    def look(batches):
        for batch in batches:
            found = [os.path.exists(os.path.join(target, p)) for p in batch.column("safe").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.bool_())], names=["path", "there"])

    return entries.select("path", "safe").mapInArrow(look, "path string, there boolean")


def write_files(pieces: DataFrame, target: str) -> DataFrame:
    """Write pieces (safe, seq, payload, mode, content_hash) below ``target``, each file by one task in the order of seq;
    gives the path of each. A file is checked against its hash, where it has one, before it gets its name."""
    ordered = pieces.select("safe", "seq", "payload", "mode", "content_hash").repartition("safe").sortWithinPartitions("safe", "seq")

    def write(batches):
        open_ = None  # path, temporary file, its handle, running hash, mode, wanted hash

        def close():
            path, temp, handle, whole, mode, expected = open_
            handle.close()
            if expected is not None and whole.hexdigest() != expected:
                os.unlink(temp)
                raise ValueError(f"damaged file {path}")
            if mode:
                os.chmod(temp, mode)
            os.replace(temp, path)
            return pa.RecordBatch.from_pydict({"path": pa.array([path], pa.string())})

        for batch in batches:
            for row in range(len(batch)):
                path = os.path.join(target, batch.column("safe")[row].as_py())
                if open_ is None or open_[0] != path:
                    if open_ is not None:
                        yield close()
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    temp = f"{path}.{secrets.token_hex(4)}.tmp"
                    open_ = (path, temp, open(temp, "wb"), hashlib.sha256(), batch.column("mode")[row].as_py(), batch.column("content_hash")[row].as_py())
                payload = batch.column("payload")[row].as_buffer()
                open_[2].write(payload)
                open_[3].update(payload)
        if open_ is not None:
            yield close()

    return ordered.mapInArrow(write, "path string")


def decrypt_files(files: DataFrame, key: bytes, target: str, piece: int = chunking.CHUNK_BYTES) -> int:
    """Open sealed files (path, abs_path) of any size below ``target``; how many. An unsafe path is an error."""
    named = files.withColumn("safe", safe_relative(F.col("path")))
    if unsafe := named.where(F.col("safe").isNull()).limit(1).collect():
        raise ValueError(f"unsafe path {unsafe[0].path!r}")
    pieces = opened_pieces(files, key, piece).join(named.select("path", "safe"), "path")
    return write_files(pieces.withColumns({"mode": F.lit(None).cast("int"), "content_hash": F.lit(None).cast("string")}), target).count()


def restore(repo: Repository, source: str, target: str, seconds: int | None = None, overwrite: bool = False) -> dict:
    """Write a snapshot's files below ``target``. Every path is validated before anything is written; existing files
    stay unless ``overwrite``; rows that were not stored are skipped. A file is written piece by piece, checked against
    its hash and only then given its name; a missing or damaged blob of the snapshot is an error, one of another is not
    looked at."""
    entries = repo.entries(source, seconds).withColumn("safe", safe_relative(F.col("path")))
    unsafe = entries.where(F.col("safe").isNull()).limit(1).collect()
    if unsafe:
        raise ValueError(f"unsafe path {unsafe[0].path!r}")
    wanted = entries.where(store.RESTORABLE)
    there = materialise(_existing(wanted, target), "there")
    todo = wanted if overwrite else wanted.join(there.where("there").select("path"), "path", "left_anti")
    parts = materialise(store.restore_parts(todo).join(todo.select("path", "safe", "mode", "content_hash"), "path"), "parts")
    pieces = parts.join(opened_blobs(repo, parts), "hash", "left")
    lost = F.raise_error(F.concat(F.lit("missing blob "), "hash"))
    pieces = pieces.withColumn("payload", F.when(F.col("payload").isNull(), lost).otherwise(F.col("payload")))
    restored = write_files(pieces, target).count()
    existing = 0 if overwrite else there.where("there").count()
    return {"restored": restored, "existing": existing, "skipped": entries.count() - restored - existing}
