import hashlib
import os
import shutil

import pytest
from pyspark.sql import functions as F

from siltbed.functions import frames
from siltbed.operators import chunking, store
from siltbed.plans.backup import Repository, backup, decrypt_files, restore
from siltbed.sources import manifests as mf


def tree(root, files):
    for name, data in files.items():
        os.makedirs(os.path.dirname(root / name), exist_ok=True)
        (root / name).write_bytes(data)


@pytest.mark.parametrize("key", [None, b"k" * 32])
def test_backup_increment_and_restore(spark, tmp_path, key):
    root, repo = tmp_path / "src", Repository(spark, str(tmp_path / "repo"), chunk_bytes=1000, compress_from=200, key=key, excludes=["*.tmp", "cache"])
    files = {"file1.txt": b"hello world", "sub/nested.txt": b"nested file", "big.bin": bytes(range(256)) * 10, "copy.txt": b"hello world", "empty": b"", "x.tmp": b"no", "cache/c": b"no", "text.md": b"z" * 900}
    tree(root, files)
    first = backup(repo, str(root), "s", now=100)
    assert (first["new"], first["changed"], first["unchanged"], first["deleted"]) == (6, 0, 0, 0)
    assert first["blobs"] == 4 + 3  # equal contents once, the big one in three pieces
    again = backup(repo, str(root), "s", now=100)
    assert (again["seconds"], again["unchanged"], again["new"], again["blobs"]) == (101, 6, 0, 0)

    tree(root, {"file1.txt": b"hello there, longer", "added": b"a"})
    os.remove(root / "sub/nested.txt")
    os.utime(root / "copy.txt", (1, 1))  # new mtime, same content
    third = backup(repo, str(root), "s", now=200)
    assert (third["new"], third["changed"], third["unchanged"], third["deleted"], third["blobs"]) == (1, 1, 4, 1, 2)

    target = tmp_path / "out"
    assert restore(repo, "s", str(target), 100) == {"restored": 6, "existing": 0, "skipped": 0}
    got = {str(p.relative_to(target)): p.read_bytes() for p in target.rglob("*") if p.is_file()}
    assert got == {k: v for k, v in files.items() if not k.endswith(".tmp") and not k.startswith("cache")}
    assert restore(repo, "s", str(target), 200)["existing"] == 5
    assert (target / "file1.txt").read_bytes() == b"hello world"
    restore(repo, "s", str(target), 200, overwrite=True)
    assert (target / "file1.txt").read_bytes() == b"hello there, longer"
    with pytest.raises(LookupError):
        restore(repo, "s", str(target), 5)
    if key:
        with pytest.raises(Exception, match="damaged blob"):
            restore(Repository(spark, repo.folder, chunk_bytes=1000, key=b"w" * 32), "s", str(tmp_path / "none"), 100)


def test_lost_blobs_are_stored_again(spark, tmp_path):
    root, repo = tmp_path / "src", Repository(spark, str(tmp_path / "repo"))
    tree(root, {"a": b"content"})
    backup(repo, str(root), "s", now=1)
    shutil.rmtree(tmp_path / "repo/blobs")
    spark.catalog.clearCache()
    assert backup(repo, str(root), "s", now=2)["blobs"] == 1
    assert restore(repo, "s", str(tmp_path / "out"))["restored"] == 1


def _restored(target):
    return {str(p.relative_to(target)): p.read_bytes() for p in target.rglob("*") if p.is_file()}


def test_a_file_that_changes_while_it_is_backed_up(spark, tmp_path, monkeypatch):
    root, repo = tmp_path / "src", Repository(spark, str(tmp_path / "repo"), chunk_bytes=100)
    tree(root, {"a": b"1" * 250, "b": b"2"})
    put = store.put

    def late(blobs, path):
        tree(root, {"a": b"3" * 250, "b": b"other"})  # after the read, before anything is stored
        return put(blobs, path)

    monkeypatch.setattr(store, "put", late)
    backup(repo, str(root), "s", now=1)
    restore(repo, "s", str(tmp_path / "out"))
    assert _restored(tmp_path / "out") == {"a": b"1" * 250, "b": b"2"}


def test_nothing_is_committed_that_is_not_stored(spark, tmp_path, monkeypatch):
    root, repo = tmp_path / "src", Repository(spark, str(tmp_path / "repo"))
    tree(root, {"a": b"content", "b": b"more"})
    put = store.put
    monkeypatch.setattr(store, "put", lambda blobs, path: put(blobs.limit(1), path))
    with pytest.raises(RuntimeError, match="not in the store"):
        backup(repo, str(root), "s", now=1)
    assert repo.snapshots("s") == [] and repo.entries("s").count() == 0


def test_damage_to_another_source_does_not_matter(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "repo"))
    for source, data in (("a", b"alpha"), ("b", b"beta")):
        tree(tmp_path / source, {"f": data})
        backup(repo, str(tmp_path / source), source, now=1)
    broken = repo.blobs().withColumn("payload", F.when(F.col("payload") == F.lit(b"beta"), F.lit(b"bent")).otherwise(F.col("payload"))).collect()
    shutil.rmtree(tmp_path / "repo/blobs")
    spark.createDataFrame(broken, repo.blobs().schema).write.partitionBy("shard").parquet(str(tmp_path / "repo/blobs"))
    spark.catalog.clearCache()
    assert restore(repo, "a", str(tmp_path / "out"))["restored"] == 1
    with pytest.raises(Exception, match="damaged blob"):
        restore(repo, "b", str(tmp_path / "out2"))


def test_backup_publishes_a_manifest_and_the_registry(spark, tmp_path):
    root, repo = tmp_path / "src", Repository(spark, str(tmp_path / "repo"), chunk_bytes=4, device="dev")
    tree(root, {"x": b"12345678", "d/e/y": b"abc"})
    seen = []
    backup(repo, str(root), "src", now=1767225600, progress=lambda **k: seen.append(k["phase"]))
    backup(repo, str(root), "src", now=1767225601)
    good, bad = mf.list_manifests(spark, repo.folder, "src")
    assert [r.timestamp for r in good.collect()] == ["2026-01-01T00:00:01Z", "2026-01-01T00:00:00Z"] and bad.count() == 0
    assert good.select("stats.fileCount", "stats.unchangedFiles").first() == (2, 2) and seen == ["scanning", "uploading", "complete"]
    files = {r.path: len(r.chunks or []) for r in mf.files_of(good.where("stats.newFiles = 2"), ["timestamp"]).collect()}
    assert files == {"x": 2, "d/e/y": 0}
    assert {k: sorted(v.subdirs) for k, v in good.first().dirs.items()} == {"": ["d"], "d": ["e"], "d/e": []}
    assert mf.load_registry(repo.folder, "dev", "src")["snapshotCount"] == 2
    assert {r.hash for r in mf.alive_hashes(spark, mf.manifest_dir(repo.folder, "src")).collect()} == {r.hash for r in repo.blobs().collect()}


def test_the_life_of_a_source(spark, tmp_path):
    meta = str(tmp_path)
    for day in (1, 2):
        mf.save_manifest(meta, {"version": 2, "cloudId": "dev/src", "deviceId": "dev", "timestamp": f"2026-01-0{day}T00:00:00Z"})
    mf.save_manifest(meta, {"version": 2, "cloudId": "dev/other", "deviceId": "dev", "timestamp": "2026-01-01T00:00:00Z"})
    mf.save_registry(meta, {"cloudId": "dev/src", "deviceId": "dev"})
    assert len(mf.listing(meta)) == 3
    assert mf.trash_all(meta, "dev/src") == 2 and len(mf.listing(meta)) == 1 and mf.trash_ids(meta) == ["dev"]
    good, bad = mf.list_manifests(spark, meta, "dev/src", trash=True)
    assert (good.count(), bad.count()) == (2, 0)  # with their sidecars
    assert mf.load_registry(meta, "dev", "dev/src") is None and mf.load_registry(meta, "dev", "dev/src", trash=True) and mf.load_registries(spark, meta, trash=True).count() == 1
    now = os.path.getmtime(next((tmp_path / "trash/dev/src").iterdir()))
    assert mf.clean_trash(meta, now, 10) == 0 and mf.clean_trash(meta, now + 1000, 10, "dev/none") == 0
    assert mf.clean_trash(meta, now + 1000, 10, "dev/src") == 4 and mf.load_registry(meta, "dev", "dev/src", trash=True) is None
    assert mf.delete_all(meta, "dev/other") == 1 and mf.listing(meta) == [] and mf.delete_all(meta, "dev/other") == 0
    assert not mf.delete_registry(meta, "dev", "x") and mf.list_manifests(spark, meta, "dev/other")[0].count() == 0


def test_a_shard_larger_than_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FILE_BYTES", 1)
    kept = store.BlobStore(spark, str(tmp_path / "s"))
    data = [(hashlib.sha256(bytes([i])).hexdigest(), bytearray(1000)) for i in range(40)]
    assert kept.put(spark.createDataFrame(data, "hash string, payload binary")) == 40 == kept.rows().count()
    assert kept.get(data[3][0]).count() == 1 and kept.get("0" * 64).count() == 0
    with pytest.raises(ValueError):
        kept.get("x")
    doomed = spark.createDataFrame([(data[0][0],), (data[1][0],), ("bad",), (None,)], "hash string")
    assert (kept.delete(doomed), kept.delete(doomed), kept.rows().count()) == (2, 0, 38)
    assert {r.there for r in kept.exists(doomed).collect()} == {False}


def test_sealed_files_open_as_streams(spark, tmp_path):
    key, lit = b"k" * 32, F.lit(b"k" * 32)
    df = spark.createDataFrame([("small", bytearray(b"abc")), ("large", bytearray(bytes(range(250)))), ("d/second", bytearray(b"z" * 250 + b"y"))], "path string, data binary")
    pieces = chunking.chunk_column(F.col("data"), 100)
    ivs = F.transform(pieces, lambda p, i: F.unhex(F.substring(F.sha2(F.concat(p, F.hex(i).cast("binary")), 256), 9, 24)))
    flagged = frames.gb2_pieces(F.col("data"), 100, 50)
    framed = df.select("path", "data", F.when(F.col("path") == "small", frames.small_frame(F.col("data"), lit, frames.random_iv(F.col("path"), small=True)))
                       .when(F.col("path") == "large", frames.large_frame(pieces, ivs, lit)).otherwise(frames.gb2_frame(flagged, ivs, lit)).alias("frame")).collect()
    for r in framed:
        (tmp_path / r.path.replace("/", "_")).write_bytes(bytes(r.frame))
    files = spark.createDataFrame([(r.path, str(tmp_path / r.path.replace("/", "_"))) for r in framed], "path string, abs_path string")
    assert decrypt_files(files, key, str(tmp_path / "out"), 100) == 3
    assert _restored(tmp_path / "out") == {r.path: bytes(r.data) for r in framed}
    with pytest.raises(Exception, match="does not open"):
        decrypt_files(files, b"x" * 32, str(tmp_path / "out2"), 100)
    cut = tmp_path / "large"
    cut.write_bytes(cut.read_bytes()[:150])
    with pytest.raises(Exception, match="ends within a piece|does not open"):
        decrypt_files(files.where("path = 'large'"), key, str(tmp_path / "out3"), 100)
    assert not [p for p in tmp_path.rglob("out3/*") if p.name == "large"]
