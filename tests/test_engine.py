"""Snapshot comparison, chunks, store, manifests, the tree source and streaming."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltbed.operators import chunking, snapshot, store
from siltbed.sources import manifests as mf
from siltbed.sources.tree import TreeSource, is_lock_error, read_with_retry
from siltbed.streaming.intake import intake, windowed_counts
from tests.conftest import rows

FILES = "path string, size long, mtime string, content_hash string"


def test_classification(spark):
    now = spark.createDataFrame([("new", 1, "t", "hash"), ("same", 1, "t", "hash"), ("changed", 1, "t", "hash2"), ("was failed", 1, "t", "hash")], FILES)
    before = spark.createDataFrame([("same", 1, "t", "hash"), ("changed", 1, "t", "hash1"), ("was failed", 1, "t", ""), ("gone", 3, "t", "hash")], FILES)
    assert rows(snapshot.classify(now, before).select("path", "status")) == [("changed", "changed"), ("gone", "deleted"), ("new", "new"), ("same", "unchanged"), ("was failed", "changed")]
    fast, slow = snapshot.two_phase(now, before)
    assert {r.path for r in fast.collect()} == {"changed", "same"}
    assert {r.path for r in slow.collect()} == {"new", "was failed"}
    stats = snapshot.snapshot_stats(snapshot.classify(now, before)).first()
    assert (stats.file_count, stats.new_files, stats.changed_files, stats.unchanged_files, stats.deleted_files, stats.new_bytes, stats.dedup_ratio) == (4, 1, 2, 1, 1, 3, 0.25)
    empty = snapshot.snapshot_stats(snapshot.classify(now.where("false"), before.where("false"))).first()
    assert (empty.file_count, empty.dedup_ratio) == (0, 0.0)
    assert rows(snapshot.deleted(now, before).select("path")) == [("gone",)]


def test_directories(spark):
    scan = spark.createDataFrame([("empty", True), ("parent", True), ("parent/child_empty", True), ("has", True), ("has/f", False), ("root", False)], "rel_path string, is_dir boolean")
    assert rows(snapshot.empty_directories(scan)) == [("empty",), ("parent/child_empty",)]
    tree = snapshot.directory_children(spark.createDataFrame([("a/b/c",), ("a/d",), ("e",)], "path string"))
    assert rows(tree) == [("", 1, 1), ("a", 1, 1), ("a/b", 1, 0)]
    docs = snapshot.directory_documents(spark.createDataFrame([("a/b", 1, "t", "h"), ("c", 1, "t", "h")], FILES)).collect()
    assert {r.dir: (len(r.files), r.subdirs) for r in docs} == {"": (1, ["a"]), "a": (1, None)}


def test_fixed_chunks(spark):
    df = spark.createDataFrame([(1, bytearray(b"a" * 250)), (2, bytearray()), (3, None), (4, bytearray(b"x" * 100))], "id int, c binary")
    got = rows(chunking.fixed_chunks(df, "id", "c", 100).select("id", "seq", "chunk_offset", "size"))
    assert got == [(1, 0, 0, 100), (1, 1, 100, 100), (1, 2, 200, 50), (4, 0, 0, 100)]
    pieces = df.select("id", F.posexplode(chunking.chunk_column(F.col("c"), 100)).alias("seq", "piece"))
    assert {r.id: bytes(r.content) for r in chunking.reassemble(pieces, "id", "seq", "piece").collect()} == {1: b"a" * 250, 4: b"x" * 100}


def test_content_defined_chunks_survive_a_shift(spark):
    data = np.random.default_rng(1).integers(0, 256, 200_000, np.uint8).tobytes()
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"!" + data)), (3, bytearray()), (4, None), (5, bytearray(b"short"))], "id int, c binary")
    got = chunking.cdc_chunks(df, "id", "c", least=1024, average=4096, most=16384).collect()
    chunks = {i: sorted((r.seq, r.chunk_offset, r.size, r.hash) for r in got if r.id == i) for i in range(1, 6)}
    assert sum(c[2] for c in chunks[1]) == len(data) and all(1024 <= c[2] <= 16384 for c in chunks[1][:-1])
    assert {r.file_hash for r in got if r.id == 1} == {hashlib.sha256(data).hexdigest()}
    old = {c[3] for c in chunks[1]}
    assert sum(c[2] for c in chunks[2] if c[3] not in old) < len(data) / 2
    assert not chunks[3] and not chunks[4] and len(chunks[5]) == 1


def test_rolling_prints_are_local():
    tables = chunking._tables(chunking.POLYNOMIAL)
    data = np.random.default_rng(2).integers(0, 256, 5000, np.uint8).tobytes()
    ends = chunking.cut_points(data, tables, 64, 256, 1024)
    assert ends[-1] == 5000 and all(a < b for a, b in zip(ends, ends[1:]))
    assert chunking.cut_points(b"", tables, 64, 256, 1024) == []


def test_store_is_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    h = [hashlib.sha256(bytes([i])).hexdigest() for i in range(5)]
    blobs = spark.createDataFrame([(x, bytearray(b"p")) for x in [*h, *h, "bad", None]], "hash string, payload binary")
    assert (store.put(blobs, path), store.put(blobs, path)) == (5, 0)
    stored = spark.read.parquet(path)
    assert stored.count() == 5
    assert rows(store.list_blobs(stored, h[0][:1]).select("hash")) == sorted((x,) for x in h if x[0] == h[0][0])
    assert store.list_blobs(stored, h[0][:3]).count() == 0
    entries = spark.createDataFrame([("a", h[0], None), ("b", "ignored", [(h[1], 1), ("", 1)]), ("c", "", []), ("d", h[0], [])], "path string, content_hash string, chunks array<struct<hash:string,size:bigint>>")
    assert rows(store.references(entries)) == sorted([(h[0],), (h[0],), (h[1],)])
    assert rows(store.garbage(stored.select("hash"), store.alive_set(entries))) == sorted((x,) for x in h[2:])
    chunks = spark.createDataFrame([("f", h[0]), ("f", h[1]), ("g", h[0]), ("g", "missing"), ("n", None)], "path string, hash string")
    assert rows(store.all_present(chunks, stored, "path")) == [("f", True), ("g", False), ("n", False)]


def test_restore(spark):
    h = lambda b: hashlib.sha256(b).hexdigest()
    blobs = spark.createDataFrame([(h(x), bytearray(x)) for x in (b"one", b"two", b"all")], "hash string, payload binary")
    entries = spark.createDataFrame([("f", "w", "new"), ("g", h(b"all"), None), ("bad", h(b"all"), "locked"), ("no", "", "new")], "path string, content_hash string, status string")
    chunks = spark.createDataFrame([("f", 1, h(b"two")), ("f", 0, h(b"one"))], "path string, seq int, hash string")
    assert {r.path: bytes(r.content) for r in store.restore(entries, chunks, blobs).collect()} == {"f": b"onetwo", "g": b"all"}
    with pytest.raises(Exception, match="missing blob"):
        store.restore(entries, chunks, blobs.limit(0)).collect()


V1 = '{"version":1,"timestamp":"2026-01-01T00:00:00Z","files":[{"path":"/root.txt","contentHash":"h1","size":10},{"path":"a/b/deep.txt","contentHash":"h3","size":30}],"emptyDirs":[{"relPath":"e","name":"e"}]}'
V2 = '{"version":2,"dirs":{"":{"files":[{"name":"x","contentHash":"1","mtime":1700000000},{"name":"x","contentHash":"2"}],"subdirs":["d"]},"d":{"files":null}}}'


def test_manifest_documents(spark):
    docs = spark.createDataFrame([(1, V1), (2, V2), (3, "{}"), (4, "no json"), (5, None)], "id int, doc string")
    read = mf.parsed(docs, "doc")
    assert {r.id: r.bad for r in read.collect()} == {1: False, 2: False, 3: False, 4: True, 5: False}
    files = mf.files_of(read, ["id"])
    assert rows(files.select("id", "path", "content_hash")) == [(1, "a/b/deep.txt", "h3"), (1, "root.txt", "h1"), (2, "x", "1"), (2, "x", "2")]
    assert rows(mf.last_wins(files, ["id"]).where("id = 2").select("content_hash")) == [("2",)]
    assert mf.find_file(files.where("id = 2"), "x").first().content_hash == "1"
    assert rows(files.where("id = 2").select("mtime")) == [("1700000000",), (None,)]
    wanted = spark.createDataFrame([(1, "A/B/DEEP.txt"), (1, ".root.txt"), (1, "none")], "id int, wanted string")
    assert rows(mf.find_tolerant(files, wanted, ["id"]).select("wanted", "path")) == [(".root.txt", "root.txt"), ("A/B/DEEP.txt", "a/b/deep.txt")]


def test_manifest_files(spark, tmp_path):
    meta = str(tmp_path)
    doc = {"version": 2, "cloudId": "dev/src", "deviceId": "dev", "timestamp": "2026-01-01T00:00:00Z", "dirs": {}}
    first, second = mf.save_manifest(meta, doc), mf.save_manifest(meta, doc | {"note": "second"})
    assert first.endswith("1767225600_dev.json.zst") and second != first
    with pytest.raises(ValueError):
        mf.save_manifest(meta, doc | {"deviceId": ""})
    third = mf.save_manifest(meta, doc | {"timestamp": "2026-01-02T00:00:00Z"})
    fourth = mf.save_manifest(meta, doc | {"timestamp": "2026-01-03T00:00:00Z"})
    with open(third, "ab") as f:
        f.write(b"tampered")
    os.remove(fourth + ".sha256")
    sealed = mf.save_manifest(meta, doc | {"timestamp": "2026-01-04T00:00:00Z"}, seal=lambda b: b"GKM1" + b[::-1])
    read = {r.file_name: (r.doc is not None, r.problem) for r in mf.load_manifests(spark, mf.manifest_dir(meta, "dev/src"), unseal=lambda b: b[4:][::-1]).collect()}
    base = os.path.basename
    assert read == {base(first): (True, None), base(second): (True, None), base(third): (False, "checksum mismatch"), base(fourth): (False, "no checksum"), base(sealed): (True, None)}
    listing = spark.createDataFrame([("s", n) for n in read] + [("s", "x.txt"), ("s", "1_d.alive.json")], "k string, file_name string").where(mf.is_manifest_name(F.col("file_name")))
    assert mf.latest(listing, ["k"]).first().file_name == base(sealed)
    assert mf.by_second(listing, ["k"], F.lit(1767225600)).first().file_name == base(first)
    assert [r.seconds for r in mf.timestamps(listing).orderBy("seconds").collect()] == [1767225600, 1767225600, 1767312000, 1767398400, 1767484800]
    moved = mf.trash_manifest(meta, "dev/src", base(first))
    assert os.path.exists(moved) and os.path.exists(moved + ".sha256") and not os.path.exists(first)
    assert mf.delete_manifest(meta, "dev/src", "2026-01-01T00:00:00Z", "dev") and not os.path.exists(second)
    assert not mf.delete_manifest(meta, "dev/src", "2026-01-01T00:00:00Z", "dev")
    mf.save_registry(meta, {"cloudId": "dev/src", "deviceId": "dev", "snapshotCount": 2, "pins": [{"repoPath": "r", "snapshotTime": 5}]})
    assert mf.load_registries(spark, meta).select("cloudId", "snapshotCount", "pins.snapshotTime").first() == ("dev/src", 2, [5])


def test_tree_source(spark, tmp_path):
    for name in ("a/b.txt", "a/skip/c.txt", "a/.hidden", "_u/zero", "top.log", "big"):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name.endswith("zero") else b"x" * (2000 if name == "big" else 3))
    os.makedirs(tmp_path / "empty")
    spark.dataSource.register(TreeSource)
    read = spark.read.format("tree").option("excludes", "skip\n*.log\nsize:>1kb").option("content", "true").load(str(tmp_path))
    got = {r.rel_path: (r.is_dir, r.size, None if r.content is None else bytes(r.content)) for r in read.collect()}
    assert got == {"a": (True, 0, None), "a/b.txt": (False, 3, b"xxx"), "a/.hidden": (False, 3, b"xxx"), "_u": (True, 0, None), "_u/zero": (False, 0, b""), "empty": (True, 0, None)}
    assert is_lock_error(OSError(32, "x")) and is_lock_error(OSError(5, "Sharing Violation")) and not is_lock_error(OSError(2, "x"))
    with pytest.raises(OSError):
        read_with_retry(str(tmp_path / "none"), sleep=lambda _: None)


def test_streaming_intake(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string").write.parquet(str(source))
    stream = spark.readStream.schema("text string").parquet(str(source))
    for _ in range(2):
        intake(stream, "text", f"file://{tmp_path}/store", f"file://{tmp_path}/check").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/store").count() == 2
    spark.createDataFrame([("c",), ("a",)], "text string").write.mode("append").parquet(str(source))
    intake(stream, "text", f"file://{tmp_path}/store", f"file://{tmp_path}/check").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/store").count() == 3


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", 1), ("2024-01-01 00:50:00", 1), ("2024-01-01 01:00:00", 1)], "t string, k int").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r.n for r in windowed_counts(df, "t", "k", "1 hour", "1 hour").collect()) == [1, 2]
