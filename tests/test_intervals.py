import random

import pytest
from pyspark.sql import functions as F

from siltbed.operators import intervals as iv
from siltbed.operators.incremental import pending_files
from siltbed.plans.problems import QUERIES
from tests.conftest import rows

SCHEMA = "k string, seq long"


def numbers(spark, mapping):
    return spark.createDataFrame([(k, n) for k, ns in mapping.items() for n in ns], SCHEMA)


def spread(df):
    return {(r.k, n) for r in df.collect() for n in range(r.lo, r.hi + 1)}


@pytest.mark.parametrize("seed", range(3))
def test_against_sets(spark, monkeypatch, seed):
    monkeypatch.setattr(iv, "BLOCK", 8)
    r = random.Random(seed)
    sets = [{k: {r.randrange(-20, 60) for _ in range(40)} for k in ("a", "b", None)} for _ in range(2)]
    one, two = (iv.to_intervals(numbers(spark, s), "k", "seq") for s in sets)
    flat = [{(k, n) for k, ns in s.items() for n in ns} for s in sets]
    assert spread(one) == flat[0]
    assert spread(iv.merge_intervals(one, two, "k")) == flat[0] | flat[1]
    assert spread(iv.subtract_intervals(one, two, "k")) == flat[0] - flat[1]
    whole = iv.across_blocks(one, "k")
    assert spread(whole) == flat[0]
    ends = {(x.k, x.hi) for x in whole.collect()}
    assert not any((x.k, x.lo - 1) in ends for x in whole.collect())
    marked = iv.rows_in(numbers(spark, sets[1]), one, "k", "seq")
    assert {(x.k, x.seq) for x in marked.where("in_gap").collect()} == flat[0] & flat[1]


def test_empty_and_null_numbers(spark):
    some = spark.createDataFrame([("a", 1), ("a", None), ("a", 1)], SCHEMA)
    none = some.where("false")
    assert rows(iv.to_intervals(some, "k", "seq").select("k", "lo", "hi")) == [("a", 1, 1)]
    assert iv.subtract_intervals(iv.to_intervals(none, "k", "seq"), iv.to_intervals(some, "k", "seq"), "k").count() == 0
    assert iv.rows_in(some, iv.to_intervals(none, "k", "seq"), "k", "seq").where("in_gap").count() == 0


def test_ledger_neither_skips_nor_repeats(spark, tmp_path):
    ledger = iv.Ledger(spark, f"file://{tmp_path}/ledger", "k", "seq")
    first = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("b", 1)], SCHEMA)
    ledger.run(first, lambda new: new)

    def crash(new):
        raise RuntimeError("died")

    late = first.unionByName(spark.createDataFrame([("a", 3), ("b", 9), ("a", 5), (None, 4)], SCHEMA))
    with pytest.raises(RuntimeError):
        ledger.run(late, crash)
    assert ledger.commits() == [1]
    ledger.run(late, lambda new: new)
    ledger.run(late, lambda new: new)
    assert rows(ledger.output()) == [("a", 1), ("a", 2), ("a", 3), ("a", 5), ("b", 1), ("b", 9), (None, 4)]
    assert spread(ledger.processed()) == {("a", 1), ("a", 2), ("a", 3), ("a", 5), ("b", 1), ("b", 9), (None, 4)}


def test_a_source_that_grows_during_a_run(spark, tmp_path):
    source = str(tmp_path / "source")
    put = lambda *ns: spark.createDataFrame([("a", n) for n in ns], SCHEMA).write.mode("append").parquet(source)
    put(1, 3)
    scan = lambda: spark.read.schema(SCHEMA).parquet(source)
    ledger = iv.Ledger(spark, f"file://{tmp_path}/ledger", "k", "seq")

    def process(new):
        put(2, 4)  # after the gaps were fixed, before the output is written
        return new

    ledger.run(scan(), process)
    held = spread(ledger.processed())
    assert held == set(map(tuple, rows(ledger.output()))) >= {("a", 1), ("a", 3)}
    ledger.run(scan(), lambda new: new)
    assert rows(ledger.output()) == [("a", 1), ("a", 2), ("a", 3), ("a", 4)] and spread(ledger.processed()) == {("a", n) for n in (1, 2, 3, 4)}


def test_two_runs_at_once_both_commit(spark, tmp_path):
    one, two = (iv.Ledger(spark, f"file://{tmp_path}/ledger", "k", "seq") for _ in range(2))
    rows_of = lambda *ns: spark.createDataFrame([("a", n) for n in ns], SCHEMA)
    turns = []

    def interrupted(new):
        if not turns:
            turns.append(two.run(rows_of(2, 3), lambda x: x))  # takes the number that the outer run wants
        return new

    assert one.run(rows_of(1, 2), interrupted) == 2 and turns == [1]
    assert rows(one.output()) == [("a", 1), ("a", 2), ("a", 3)] and spread(two.processed()) == {("a", 1), ("a", 2), ("a", 3)}
    assert not one.log.commit(2, {}) and one.log.sweep() == 1 and one.commits() == [1, 2]


def test_differing_rows_of_one_number_and_rows_without_a_number(spark, tmp_path):
    ledger = iv.Ledger(spark, f"file://{tmp_path}/ledger", "k", "seq")
    scan = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y"), ("a", None, "z")], SCHEMA + ", lo string")
    ledger.run(scan, lambda new: new)
    assert rows(ledger.output()) == [("a", 1, "x"), ("a", 1, "y")] and ledger.log.latest()[1]["unnumbered"] == 1
    ledger.run(scan.where("false"), lambda new: new)
    assert ledger.output(2).count() == 0


def test_masks_of_ragged_intervals(spark):
    numbers_ = {n for n in range(-200, 400) if n % 2 and n % 7} | set(range(1000, 1300)) | {(1 << 40) + 63, (1 << 40) + 64}
    parts = iv.to_intervals(numbers(spark, {"a": numbers_}), "k", "seq")
    probe = set(range(-210, 1310)) | {(1 << 40) + n for n in (62, 63, 64, 65)}
    marked = iv.rows_in(numbers(spark, {"a": probe, "b": {1}}), parts, "k", "seq").where("in_gap").collect()
    assert {(r.k, r.seq) for r in marked} == {("a", n) for n in numbers_}


def test_the_ledger_of_the_query_holds_the_whole_scan(spark, data):
    numbers = {(r[0], r[1]) for r in spark.read.parquet(f"{data}/files_scan.parquet").select("cloud_id", "rev").collect() if r[1] is not None}
    got = QUERIES["p2_committed"](spark, data).collect()
    held = [(r.cloud_id, n) for r in got for n in range(r.first_rev, r.last_rev + 1)]
    assert len(held) == len(set(held)) and set(held) == numbers
    assert not any((r.cloud_id, r.last_rev + 1) in numbers for r in got)


def test_pending_files(spark):
    at = lambda h: f"2025-02-01 {h:02d}:00:00"
    scan = [
        ("c", "same", 1, "2025-01-01T00:00:00Z", "new", 1, at(1)), ("c", "same", 1, "1735689600", "changed", 5, at(9)),  # one instant in two forms
        ("c", "moved", 1, "2025-01-01T00:00:00Z", "new", 2, at(1)), ("c", "moved", 1, "2025-01-01T00:00:01Z", "unchanged", 6, at(9)),
        ("c", "late", 1, "x", "new", 3, at(9)), ("c", "late", 1, "x", "new", 4, at(1)),  # overtaken: the greatest number is processed
        ("c", "locked", 7, "x", "locked", 7, at(9)), ("c", None, 1, "x", None, 8, at(9)), ("c", "null size", None, None, None, 9, at(9)), ("c", "null size", None, "n/a", None, 10, at(1)),
        ("d", "no run", 1, None, None, 1, at(1)), ("d", "no run", 1, None, None, 1, at(1)), (None, "no source", 1, None, None, 1, at(1)), ("c", "twice", 2, "5", "new", 11, at(1)), ("c", "twice", 2, "5", "new", 11, at(9)),
    ]
    scan = spark.createDataFrame(scan, "cloud_id string, rel_path string, size long, mtime string, status string, rev long, a string").withColumn("arrived_at", F.col("a").cast("timestamp_ntz"))
    runs = spark.createDataFrame([("c", at(5), "ok"), ("c", at(10), "failed"), ("c", at(11), None), ("c", at(2), "ok")], "cloud_id string, c string, outcome string").withColumn("cutoff_at", F.col("c").cast("timestamp_ntz"))
    registry = spark.createDataFrame([("c", None, None), ("c", None, None)], "cloud_id string, time_zone string, date_locale string")
    assert rows(pending_files(scan, runs, registry)) == [("c", "moved"), ("d", "no run"), (None, "no source")]
    assert pending_files(scan.where("false"), runs, registry).count() == 0
    assert pending_files(scan, runs.where("false"), registry.where("false")).count() == 7
