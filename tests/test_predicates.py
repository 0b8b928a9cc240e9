import re

import pytest
from pyspark.sql import functions as F

from siltbed.functions.paths import ancestors, cloud_key, is_cloud_id, is_dense, is_hash, safe_relative, toggle_leading_dot
from siltbed.operators import predicates as p

PATHS = ["build", "build/x.o", "src/build/x.o", "src/build", "rebuild/x", "a/b/c.log", "c.log", "x/raw/y/deep.bin", "x/raw", "z/xa/q/t.txt", "x/q/t.txt", "x/t.txt", "[odd]/n", ".git/config", "a.b/c", ""]
TRUTH = [
    ("build", {"build", "build/x.o", "src/build/x.o", "src/build"}),
    ("build/", {"build", "build/x.o", "src/build/x.o", "src/build"}),
    ("*.log", {"a/b/c.log", "c.log"}),
    ("a/*/c.log", {"a/b/c.log"}),
    ("a/*.log", set()),
    ("?.log", {"a/b/c.log", "c.log"}),
    ("[a-c].log", {"a/b/c.log", "c.log"}),
    ("[^a-b].log", {"a/b/c.log", "c.log"}),
    ("[", set()),
    ("\\[odd\\]/?", {"[odd]/n"}),
    ("**", set(PATHS)),
    ("**/raw", {"x/raw/y/deep.bin", "x/raw"}),
    ("**/*.txt", {"z/xa/q/t.txt", "x/q/t.txt", "x/t.txt"}),
    ("x/**", {"x/raw/y/deep.bin", "x/raw", "x/q/t.txt", "x/t.txt"}),
    ("x/**/t.txt", {"x/q/t.txt", "x/t.txt", "z/xa/q/t.txt"}),  # the head counts as text after a slash
    ("a**b", set()),
]


@pytest.fixture(scope="module")
def paths(spark):
    return spark.createDataFrame([(x,) for x in PATHS], "path string")


@pytest.mark.parametrize(("pattern", "want"), TRUTH)
def test_pattern(paths, pattern, want):
    got = {r.path for r in paths.where(p.match_pattern(F.col("path"), pattern)).collect()}
    assert got == want
    regex = p.exclusion_regex([pattern])
    assert {x for x in PATHS if regex and re.search(regex, x)} == want


def test_classes_and_lists_in_both_engines(spark, paths):
    tricky = [(x,) for x in ["a/c", "a-c", "a]c", "a\nc", "zz", "é", "&&", "a^c", ""]]
    for patterns in (["a[^b]c"], ["a[]]c"], ["[]a]"], ["[z-a]"], ["[^z-a]"], ["a[\\]-]c"], ["[é]"], ["&&", "zz"], ["a*c", "["], ["a[^^]c"], ["x\\"], [""], ["/"]):
        regex = p.exclusion_regex(patterns)
        got = {r.x for r in spark.createDataFrame(tricky, "x string").where(p.is_excluded(F.col("x"), patterns)).collect()}
        assert got == {x for (x,) in tricky if regex and re.search(regex, x)}, patterns
    only = lambda pattern: {x for (x,) in tricky if (r := p.exclusion_regex([pattern])) and re.search(r, x)}
    assert only("a[^b]c") == {"a/c", "a-c", "a]c", "a\nc", "a^c"}  # a class, unlike a star, may match a slash
    assert only("[]a]") == only("[z-a]") == only("x\\") == set() and only("[^z-a]") == {"é", "a/c"}  # the base name alone is matched as well


def test_negation_case_and_skipping(spark, paths):
    keep = lambda c: {r.path for r in paths.where(c).collect()}
    assert keep(p.is_excluded(F.col("path"), ["*.log", "x/**"], ["t.txt"])) == {"a/b/c.log", "c.log", "x/raw/y/deep.bin", "x/raw"}
    assert keep(p.is_excluded(F.col("path"), ["BUILD"], ignore_case=True)) == {"build", "build/x.o", "src/build/x.o", "src/build"}
    assert keep(p.under_skipped(F.col("path"), ["raw", "build"], ["src"])) == {"build/x.o", "x/raw/y/deep.bin"}
    assert keep(p.is_excluded(F.col("path"), [])) == set()


def test_loose_matcher(paths):
    keep = lambda *x: {r.path for r in paths.where(p.match_exclude(F.col("path"), x)).collect()}
    assert keep("buil") == {"build", "build/x.o"}  # any raw prefix
    assert keep("**/raw") == {"x/raw", "x/raw/y/deep.bin"}
    assert keep("z/**.txt") == {"z/xa/q/t.txt"}
    assert keep() == set()


@pytest.mark.parametrize(
    ("text", "want"),
    [("size:>100", (">", 100)), ("size:>=2KB", (">=", 2048)), ("size: <= 3 mb", ("<=", 3 << 20)), ("size:<1Gb", ("<", 1 << 30)), ("size:>-5b", (">", -5)), ("SIZE:>1", None), ("size:5", None), ("size:>1tb", None), ("size:>", None), ("", None)],
)
def test_size_filter(text, want):
    assert p.parse_size_filter(text) == want


def test_splitting_and_merging(spark):
    assert p.split_excludes(["a", "!b", "!!c", "size:>1", "size:x", "!size:>2"]) == (["a", "size:x"], ["b", "!c", "size:>2"], [(">", 1)])
    assert p.merge_excludes(["a", "b"], ["b", "c", "a"]) == ["a", "b", "c"]
    assert p.parse_ignore_lines(["# c", "", "  a ", "b"]) == ["a", "b"]
    df = spark.createDataFrame([(5,), (100,), (101,), (None,)], "size long")
    assert [r.size for r in df.where(p.size_excluded(F.col("size"), [(">", 100), ("<=", 10)])).collect()] == [5, 101]


def test_identifiers(spark):
    df = spark.createDataFrame([(x,) for x in ["a" * 64, "A" * 64, "a" * 63, "", None]], "x string")
    assert [r[0] for r in df.select(is_hash(F.col("x"))).collect()] == [True, False, False, False, False]
    ids = ["ok", "dev/src", "", None, "/abs", "\\abs", "C:x", "a/../b", "a\\ .. \\b", "a..b"]
    df = spark.createDataFrame([(x,) for x in ids], "x string")
    assert [r[0] for r in df.select(is_cloud_id(F.col("x"))).collect()] == [True, True, False, False, False, False, False, False, False, True]
    df = spark.createDataFrame([("d", "s"), ("", "s"), (None, "s")], "d string, s string")
    assert [r[0] for r in df.select(cloud_key(F.col("d"), F.col("s"))).collect()] == ["d/s", "s", "s"]


def test_paths_to_restore(spark):
    cases = {"a/b": "a/b", "a/../b": "b", ".": ".", "./a//b/": "a/b", "": None, None: None, "/a": None, "\\a": None, "C:\\a": None, "..": None, "a/../../b": None, "a\\b": "a/b", "...": "..."}
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    assert {r.x: r.y for r in df.select("x", safe_relative(F.col("x")).alias("y")).collect()} == cases


def test_names(spark):
    df = spark.createDataFrame([("a/B.JPG",), ("x/pagefile.SYS",), ("jpg",), (".zip",), ("a.zip/b",), ("",)], "x string")
    assert [r[0] for r in df.select(is_dense(F.col("x"))).collect()] == [True, True, False, True, False, False]
    df = spark.createDataFrame([("a/b/c",), ("c",)], "x string")
    assert [r[0] for r in df.select(ancestors(F.col("x"))).collect()] == [["a/b", "a", ""], [""]]
    df = spark.createDataFrame([(".a/b",), ("a/b",), ("",), ("x",)], "x string")
    assert [r[0] for r in df.select(toggle_leading_dot(F.col("x"))).collect()] == ["a/b", ".a/b", "", ".x"]
