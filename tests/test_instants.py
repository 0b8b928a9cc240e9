import pytest
from pyspark.sql import functions as F

from siltbed.functions.instants import InstantDictionary, normalise_instants, with_instant
from siltbed.plans.problems import QUERIES
from tests import brute

NY, BERLIN = "America/New_York", "Europe/Berlin"
CASES = [
    ("2024-01-09T00:42:43Z", None, None, 1704760963000000),
    ("2024-05-08t01:38:22z", None, None, 1715132302000000),
    ("  2024-01-21T08:26:30Z\t", None, None, 1705825590000000),
    ("1715339890343000", NY, "en-US", 1715339890343000),
    ("1715339890343", NY, "en-US", 1715339890343000),
    ("100000000000", None, None, 100000000000000000),
    ("0", None, None, 0),
    ("1732424785.3789999", None, None, 1732424785378999),
    ("20240527T075926Z", None, None, 1716796766000000),
    ("17.08.2024 03:38:35", BERLIN, "de-DE", 1723858715000000),
    ("11/22/2024 05:42:18 PM", NY, "en-US", 1732315338000000),
    ("11/22/2024 12:42:18 AM", NY, "en-US", 1732254138000000),
    ("22/05/2024 15:52:22", "Europe/London", "en-GB", 1716389542000000),
    ("05/06/2024 00:00:00", None, "en-US", 1714953600000000),
    ("05/06/2024 00:00:00", None, "en-GB", 1717545600000000),
    ("Sun, 30 Oct 2022 02:49:00 +0200", BERLIN, "de-DE", 1667090940000000),
    ("Mon Aug  5 21:08:11 2024", NY, "en-US", 1722906491000000),
    ("Mon Aug 12 07:34:52 CEST 2024", BERLIN, None, 1723440892000000),
    ("2 Sep 2024 21:31:24", "America/Los_Angeles", "en-US", 1725337884000000),
    ("Aug 5, 2024 3:04:05 PM", "Asia/Tokyo", None, 1722837845000000),
    ("2024-06-27 14:59:02 CEST", BERLIN, "de-DE", 1719493142000000),
    ("2024-05-01 10:00:00 IST", "Asia/Kolkata", None, 1714537800000000),
    ("2024-05-01 10:00:00 IST", "Europe/Berlin", None, None),
    ("2024-05-01 10:00:00 EDT", BERLIN, None, 1714572000000000),
    ("2024-03-31 02:30:00", BERLIN, None, None),  # skipped by the clock change
    ("2024-10-27 02:30:00", BERLIN, None, 1729989000000000),  # the first of two
    ("2024-05-01 10:00:00", "No/Such", None, None),
    ("2024-05-01 10:00:00Z", "No/Such", None, 1714557600000000),
    ("2024-02-30 10:00:00", None, None, None),
    ("2024-05-01T24:00:00Z", None, None, None),
    ("13/13/2024 10:00:00", None, "en-US", None),
    ("11/22/2024 13:42:18 PM", NY, "en-US", None),
    ("2024-05-01", None, None, None),
    ("2024-01-15T23:00:22.665000622+05:45", None, None, 1705338922665000),
    ("99999999999999999999999", None, None, None),
    ("not-a-date 7", None, None, None),
    ("", None, None, None),
    (None, None, None, None),
    ("x" * 5000 + "1", None, None, None),
]


def test_each_form(spark):
    df = spark.createDataFrame([c[:3] for c in CASES], "raw string, zone string, locale string")
    got = {(r.raw, r.zone, r.locale): r.us for r in with_instant(df, "raw", "zone", "locale", "us").collect()}
    assert {c[:3]: c[3] for c in CASES} == got


def test_rows_keep_their_other_columns(spark):
    rows = spark.createDataFrame([(1, "2024-01-01T00:00:00Z", "a", "b", 9), (2, "null", "a", None, 9), (3, None, None, None, None)], "id int, raw string, zone string, locale string, utc_us int")
    got = normalise_instants(rows, "raw", "zone", "locale")
    assert sorted(got.columns) == sorted(rows.columns)
    assert {r.id: r.utc_us for r in got.collect()} == {1: 1704067200000000, 2: None, 3: None}
    assert normalise_instants(rows.where("false"), "raw", "zone", "locale").count() == 0


def test_dictionary_grows_by_new_values_only(spark, tmp_path):
    path = f"file://{tmp_path}/dictionary"
    one = spark.createDataFrame([("1", "UTC", "")] * 50, "raw string, zone string, locale string")
    two = one.unionByName(spark.createDataFrame([("2", "UTC", "")], one.schema))
    assert InstantDictionary(spark, path).extend(one).count() == 1
    assert {r.raw: r.utc_us for r in InstantDictionary(spark, path).extend(two).collect()} == {"1": 1000000, "2": 2000000}
    assert InstantDictionary(spark, path).extend(two).count() == 2


def test_a_dictionary_that_another_run_extends(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/kept"
    values = lambda *raws: spark.createDataFrame([(r, "UTC", "") for r in raws], "raw string, zone string, locale string")
    mine, other = InstantDictionary(spark, path), InstantDictionary(spark, path)
    stage = mine.log.stage
    monkeypatch.setattr(mine.log, "stage", lambda: (other.extend(values("1", "2")) if not other.log.numbers() else None, stage())[1])
    assert {r.raw for r in mine.extend(values("1", "3")).collect()} == {"1", "2", "3"} and mine.stored().count() == 3


def test_large_tables_are_not_broadcast(spark):
    from siltbed.session import broadcast_if_small, memory_bytes

    some = spark.range(50).select(F.lit("x" * 100).alias("s"))
    assert 5000 < memory_bytes(some) < 10000
    hinted = lambda limit: "ResolvedHint" in str(broadcast_if_small(some, limit)._jdf.queryExecution().analyzed())
    assert hinted(1 << 20) and not hinted(3000)


def test_the_query_keeps_its_dictionary(spark, data, tmp_path):
    path = f"file://{tmp_path}/kept"
    want = {tuple(r) for r in QUERIES["p7_found"](spark, data).collect()}
    spark.conf.set("spark.siltbed.instants", path)
    try:
        sizes = []
        for _ in range(2):
            assert {tuple(r) for r in QUERIES["p7_found"](spark, data).collect()} == want
            kept = InstantDictionary(spark, path).stored()
            sizes.append((kept.count(), kept.distinct().count()))
    finally:
        spark.conf.unset("spark.siltbed.instants")
    assert sizes[0] == sizes[1] and sizes[0][0] == sizes[0][1] > 0


def test_dictionary_works_on_the_rows_of_a_hot_value(spark):
    rows = spark.range(2000).select(F.lit("17.08.2024 03:38:35").alias("raw"), F.lit(BERLIN).alias("zone"), F.lit("de").alias("locale"))
    assert normalise_instants(rows, "raw", "zone", "locale").agg(F.count("utc_us"), F.countDistinct("utc_us")).first() == (2000, 1)


@pytest.mark.parametrize("problem", ["p2", "p3", "p6", "p7"])
def test_problem_against_brute_force(spark, data, problem):
    got = [tuple(r) for r in QUERIES[f"{problem}_found"](spark, data).collect()]
    want = getattr(brute, problem)(data)
    assert set(got) == want
    assert len(got) == len(want)
