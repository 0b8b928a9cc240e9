import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltbed.functions import codecs, frames
from siltbed.functions.progress import Progress, ThrottledReader, ThrottledWriter, TokenBucket, Tracker



@pytest.mark.parametrize("name", ["none", "zstd", "deflate", "s2", "unknown"])
@settings(max_examples=25, deadline=None)
@given(data=st.one_of(st.binary(max_size=2000), st.binary(min_size=1, max_size=20).map(lambda b: b * 8000)))
def test_codec_roundtrip(name, data):
    c = codecs.codec(name)
    packed = c.compress(data)
    assert c.decompress(packed) == data
    assert name == "none" or c.recognises(packed)


def test_limits_and_levels():
    for name in ("zstd", "deflate", "s2"):
        small = codecs.codec(name, limit=1000)
        with pytest.raises(ValueError):
            small.decompress(small.compress(b"x" * 1001))
        assert small.decompress(small.compress(b"x" * 1000)) == b"x" * 1000
    assert codecs.Zstd(99).level == 1 and codecs.Deflate(99).level == 9 and codecs.codec("what").name == "zstd"
    with pytest.raises(ValueError):
        codecs.codec("s2").decompress(codecs.codec("s2").compress(b"hello")[:-1])


def test_compress_if_useful(spark):
    df = spark.createDataFrame([("a.txt", b"x" * 5000), ("a.jpg", b"x" * 5000), ("b.txt", b"x"), ("c.txt", bytes(range(256)) * 4), ("n.txt", None)], "path string, data binary")
    got = {r.path: (r.is_compressed, r.stored and len(r.stored)) for r in codecs.compress_if_useful(df, "path", "data", 1000).collect()}
    assert got["a.txt"][0] and got["a.txt"][1] < 100
    assert got["a.jpg"] == (False, 5000) and got["b.txt"] == (False, 1) and got["n.txt"] == (False, None)


def test_frames(spark):
    key, wrong = F.expr("X'" + "11" * 32 + "'"), F.expr("X'" + "22" * 32 + "'")
    df = spark.createDataFrame([(i, bytearray(b"abc" * i)) for i in range(5)], "id int, data binary")
    sealed = df.withColumn("f", frames.small_frame(F.col("data"), key, frames.random_iv(F.col("id"), small=True))).cache()
    out = sealed.select("id", "data", "f", frames.open_frame(F.col("f"), key, 4).alias("p"), frames.open_frame(F.col("f"), wrong, 4).alias("w")).collect()
    assert all(bytes(r.p) == bytes(r.data) and r.w is None and bytes(r.f[:4]) == b"GB1\x00" and len(r.f) == 4 + 12 + 16 + len(r.data) for r in out)
    cut = sealed.withColumn("f", F.expr("substring(f, 1, length(f) - 1)"))
    assert cut.where(frames.open_frame(F.col("f"), key, 4).isNotNull()).count() == 0
    # a small frame whose nonce reads as a count is still opened as a small one
    odd = df.withColumn("f", frames.small_frame(F.col("data"), key, F.expr("X'000000010000000000000000'")))
    assert all(bytes(r.p) == bytes(r.data) for r in odd.select("data", frames.open_frame(F.col("f"), key, 4).alias("p")).collect())
    counts = spark.createDataFrame([(b"\x00\x01\x86\x9f",), (b"\x00\x01\x86\xa0",), (b"\x00\x00\x00\x00",), (b"\x00",)], "b binary")
    assert [r[0] for r in counts.select(frames.is_count(F.col("b"))).collect()] == [True, False, False, False]


def test_gb2_rejects_damage(spark):
    key = F.expr("X'" + "11" * 32 + "'")
    df = spark.createDataFrame([(bytearray(b"a" * 100 + b"b" * 50),)], "data binary").withColumn("p", frames.gb2_pieces(F.col("data"), 60, 20))
    framed = df.withColumn("f", frames.gb2_frame(F.col("p"), F.transform("p", lambda _: F.expr("X'0102030405060708090A0B0C'")), key))
    row = framed.select("data", "p", frames.open_gb2(F.col("f"), key).alias("o"), frames.open_gb2(F.expr("substring(f, 1, length(f) - 1)"), key).alias("cut"), frames.open_gb2(F.col("data"), key).alias("none")).first()
    assert bytes(row.o) == bytes(row.data) and row.cut is None and row.none is None
    assert [p.flag for p in row.p] == [1, 1, 1]


def test_hkdf_vector():
    # RFC 5869, test case 3 has neither salt nor info
    okm = "8da4e775a563c18f715f802a063c5a31b8a11f5c5ee1879ec3454e5f3c738d2d9d201395faa4b61a96c8"
    assert frames.hkdf_sha256(b"\x0b" * 22, b"", 42).hex() == okm
    assert frames.hkdf_sha256(b"k" * 32, b"a") != frames.hkdf_sha256(b"k" * 32, b"b")


class Clock:
    now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def test_token_bucket():
    clock = Clock()
    bucket = TokenBucket(1000, clock, clock.sleep)
    bucket.wait(1000)
    assert clock.now == 0
    bucket.wait(500)
    assert 0.45 <= clock.now <= 0.6
    clock.now += 100
    bucket.wait(2000)
    before = clock.now
    bucket.wait(1)
    assert clock.now > before
    bucket.set_rate(0)
    bucket.wait(10**9)
    out = io.BytesIO()
    assert ThrottledReader(io.BytesIO(b"abc"), TokenBucket(0)).read() == b"abc" and ThrottledWriter(out, TokenBucket(0)).write(b"abc") == 3


def test_progress():
    clock, seen = Clock(), []
    tracker = Tracker(1, "s", seen.append, clock)
    tracker.set_total(2, 100)
    tracker.set_phase("uploading")
    clock.now = 2.0
    assert tracker.file_processed("a", 50, True) == Progress(1, "s", "uploading", 2, 1, 1, 0, 100, 50, 25.0, 2.0, "a")
    last = tracker.file_processed("b", 50, False)
    assert (last.eta_seconds, last.unchanged_files, last.processed_files) == (2.0, 1, 2) and tracker.get() == last and len(seen) == 4
