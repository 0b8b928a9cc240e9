import pytest
from pyspark.sql import functions as F

from siltbed.operators.orphans import missing_blobs, orphan_references
from tests.conftest import rows

REFS = [(1, "a", 1), (2, "a", 9), (3, "a", None), (4, None, 9), (5, None, None), (6, "z", None), (7, None, 2)]
TARGETS = [("a", 1), ("b", 2), ("b", 2), (None, 9), ("c", None)]


@pytest.mark.parametrize(("match", "orphans"), [("simple", [2]), ("partial", [2, 4, 6]), ("full", [2, 3, 4, 6, 7])])
def test_match_semantics(spark, match, orphans):
    refs = spark.createDataFrame([(*r, "mine") for r in REFS], "id int, k string, n int, hash string")
    targets = spark.createDataFrame([(*t, "theirs") for t in TARGETS], "k string, m int, hash string").withColumnRenamed("m", "n")
    found = orphan_references(refs, targets, [("k", "k"), ("n", "n")], match)
    got = sorted(r.id for r in found.collect())
    # (null, 9) is stored, but nulls of the targets match nothing: 9 is known with a null k only
    want = {"partial": [2, 6]}.get(match, orphans)
    assert got == want
    assert found.columns == refs.columns


def test_empty_sides(spark):
    refs = spark.createDataFrame([(1, "a")], "id int, k string")
    none = refs.where("false")
    assert rows(orphan_references(refs, none, [("k", "k")])) == [(1, "a")]
    assert rows(orphan_references(none, refs, [("k", "k")])) == []
    with pytest.raises(ValueError):
        orphan_references(refs, refs, [("k", "k")], "loose")


def test_unknown_match_of_time(spark):
    refs = spark.createDataFrame([(1, "a", 10), (2, "a", 4), (3, "b", 10), (4, "c", 10), (5, "a", None)], "id int, k string, at int")
    targets = spark.createDataFrame([("a", 5, None), ("a", 1, 7), ("b", 1, 3), ("c", 5, 6), ("c", 20, None)], "k string, since int, gone int")
    found = orphan_references(refs, targets, [("k", "k")], as_of="at", valid_from="since", removed_at="gone")
    # two rows of a key may meet the two conditions apart: 'a' lives since 1 and is stored, and so is 'c' since 5
    assert sorted(r.id for r in found.collect()) == [3, 5]


def test_store_references(spark):
    ts = "2024-01-01 00:00:00"
    manifests = spark.createDataFrame([(1, "c", ts), (1, "c", ts)], "manifest_id long, cloud_id string, r string").withColumn("received_at", F.col("r").cast("timestamp_ntz"))
    entries = spark.createDataFrame([(10, 1, "h1"), (10, 1, "h1"), (11, 1, ""), (12, 1, None), (13, 1, "big"), (14, 1, "late")], "entry_id long, manifest_id long, content_hash string")
    chunks = spark.createDataFrame([(100, 13, "c1"), (100, 13, "c1"), (101, 13, "c2"), (102, 13, ""), (103, 13, None), (104, 999, "c1")], "ref_id long, entry_id long, hash string")
    blobs = spark.createDataFrame([("c1", 0, None), ("late", 1704067201, None), ("h1", 0, 5)], "hash string, mod_time long, removed_at long")
    found = missing_blobs(entries, chunks, manifests, blobs).select("ref_table", "ref_id")
    assert rows(found) == [("file_chunks", 101), ("file_chunks", 104), ("manifest_files", 10), ("manifest_files", 14)]


def test_hot_key(spark):
    refs = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    targets = spark.createDataFrame([("hot",)] * 50, "k string")
    assert orphan_references(refs, targets, [("k", "k")]).count() == 1000
