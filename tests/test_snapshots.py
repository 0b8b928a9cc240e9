import random

import pytest

from pyspark.sql import functions as F

from siltbed.operators.history import attribute_log, combine_logs, file_versions
from siltbed.operators.snapdiff import diff_tables, snapshot_changes
from siltbed.operators.snapshots import normal_path, number_rows, ordered_snapshots
from tests.conftest import rows


def store(spark, manifests, files, registry=(("c", None, None),)):
    m = spark.createDataFrame(manifests, "manifest_id long, cloud_id string, ts string")
    f = spark.createDataFrame(files, "entry_id long, manifest_id long, pos int, path string, content_hash string, mtime string, status string")
    r = spark.createDataFrame(list(registry), "cloud_id string, time_zone string, date_locale string")
    return f, ordered_snapshots(m, r)


MANIFESTS = [(1, "c", "2024-01-01T00:00:00Z"), (3, "c", "1704153600"), (2, "c", "2024-01-03 00:00:00"), (2, "c", "2024-01-03 00:00:00"), (4, "c", "2024-01-04T00:00:00Z")]
FILES = [
    (1, 1, 0, "/a\\b", "h1", "1", None), (2, 1, 1, "a/b", "h0", "1", None), (3, 1, 2, "gone", "g", "1", "new"), (3, 1, 2, "gone", "g", "1", "new"),
    (4, 3, 0, "a/b", None, None, "locked"), (5, 3, 1, "late", "l", "x", None),
    (6, 4, 0, "a/b", "h2", "1", None), (7, 4, 1, "late", "l", "y", None), (8, 4, 2, None, "n", "1", None), (9, None, 0, "lost", "n", "1", None),
]


def test_order_and_numbers(spark):
    _, snaps = store(spark, MANIFESTS, FILES)
    assert [r.manifest_id for r in snaps.orderBy("snap").collect()] == [1, 3, 2, 4]
    got = number_rows(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")), ["x"], "n")
    assert got.where("x <> n").count() == 0 and got.count() == 1000


def test_changes(spark):
    files, snaps = store(spark, MANIFESTS, FILES)
    # the locked entry keeps h0, the third snapshot (manifest 2) is empty
    assert rows(snapshot_changes(files, snaps)) == [
        (2, "a/b", "removed"), (2, "late", "removed"), (3, "gone", "removed"), (3, "late", "added"), (4, "a/b", "added"), (4, "late", "added"),
    ]
    assert snapshot_changes(files.where("false"), snaps).count() == 0


def test_deliveries_come_to_the_same(spark, tmp_path):
    r = random.Random(9)
    manifests = [(i, r.choice(["c", "d", None]), f"2024-01-{i:02d}T00:00:00Z") for i in range(1, 13)]
    files = [(100 * m + p, m, p, f"p{r.randrange(12)}", r.choice(["x", "y", None]), "1", r.choice([None, "new", "locked", "error"])) for m, _, _ in manifests for p in range(r.choice([0, 6, 10]))]
    files, snaps = store(spark, manifests, files)
    whole = rows(snapshot_changes(files, snaps, deliveries=1))
    assert rows(snapshot_changes(files, snaps, deliveries=3)) == whole
    snapshot_changes(files, snaps, f"file://{tmp_path}/s")
    with pytest.raises(ValueError, match="taken already"):
        snapshot_changes(files, snaps, f"file://{tmp_path}/s")


def test_versions(spark):
    files, snaps = store(spark, MANIFESTS, FILES)
    got = rows(file_versions(files, snaps).select("path", "content_hash", "from_manifest_id", "to_manifest_id", "versions"))
    assert got == [("a/b", "h0", 1, 2, 2), ("a/b", "h2", 4, 0, 2), ("gone", "g", 1, 3, 1), ("late", "l", 3, 2, 2), ("late", "l", 4, 0, 2)]


def test_logs_combine_to_what_they_came_from(spark):
    r = random.Random(4)
    states = [(k, at, r.choice("xy"), r.choice([None, "1", "2"])) for k in "abc" for at in range(30) if r.random() < 0.8]
    df = spark.createDataFrame(states, "k string, at long, p string, q string")
    log = attribute_log(df, ["k"], "at", ["p", "q"])
    versions = combine_logs(log, ["k"], ["p", "q"]).collect()
    assert {(v.k, at, v.p, v.q) for v in versions for at in range(v.from_at, v.to_at)} == set(states)
    held = {(v.k, v.from_at): v for v in versions}
    assert not any((v.k, v.to_at) in held and (held[v.k, v.to_at].p, held[v.k, v.to_at].q) == (v.p, v.q) for v in versions)


def test_tables_differ(spark):
    before = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3), (None, "n", 1), (5, "r", 1), (5, "r", 1)], "id int, s string, n int")
    after = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (4, "d", 4), (None, "n", 1), (5, "r", 1)], "id int, s string, n int").withColumn("more", F.lit(1))
    assert rows(diff_tables(before, after, ["id"], ["s", "n"])) == [(2, "changed", ["n"]), (3, "removed", None), (4, "added", None)]


def test_paths(spark):
    df = spark.createDataFrame([("/a\\b",), ("//x",), ("",), (None,), ("a/",)], "p string").select(normal_path(F.col("p")).alias("p"))
    assert [r.p for r in df.collect()] == ["a/b", "/x", "", None, "a/"]
