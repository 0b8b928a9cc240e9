import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltbed.llm import near, seen
from siltbed.llm.elias_fano import EliasFano
from siltbed.llm.queries import ORACLE, QUERIES
from tests.conftest import rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 20) - 1), max_size=300), st.lists(st.integers(0, (1 << 20) - 1), max_size=50), st.sampled_from([20, 30, 56]))
def test_elias_fano(values, probes, bits):
    ordered = np.sort(np.array(values, np.uint64))
    coded = EliasFano.encode(ordered, bits)
    assert (coded.decode() == ordered).all()
    probe = np.array(probes, np.uint64)
    assert (coded.successor(probe) == np.searchsorted(ordered, probe, side="left")).all()
    if values:
        at = np.arange(len(values))
        assert (coded.values_at(at) == ordered).all()
    again = EliasFano(coded.n, coded.low_bits, coded.highs.tobytes(), coded.lows.tobytes())
    assert (again.decode() == ordered).all()


def test_elias_fano_size():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 10000, dtype=np.uint64))
    assert EliasFano.encode(values, 40).nbytes() * 8 / 10000 < 2.2 + 40 - np.log2(10000) + 1.5


def sha(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def test_seen_keys(spark, monkeypatch):
    monkeypatch.setattr(seen, "BATCH_KEYS", 3)  # many sequential merges
    r = random.Random(5)
    known = [sha(i) for i in range(400)]
    lists = spark.createDataFrame([(known[:300] + [None, "bad", known[0].upper()],), (known[250:],), ([],), (None,)], "hashes array<string>")
    keys = [r.choice([sha(r.randrange(900)), "hot", "bad", None, sha("x")]) for _ in range(1500)]
    keys = [sha("hot") if k == "hot" else k for k in keys]
    batch = spark.createDataFrame(list(enumerate(keys)), "put_id long, hash string").withColumn("part", F.lit("clash"))
    flat, total = seen.list_keys(lists, "hashes")
    assert total == 453
    store = seen.build_store(flat, "key", total)
    answers = seen.probe_store(store, batch, "hash", "put_id", total).cache()
    got = {x.put_id for x in seen.seen_rows(batch, "hash", "put_id", answers).collect()}
    before, want = set(known), set()
    for i, k in enumerate(keys):
        if k and len(k) == 64:
            if k in before:
                want.add(i)
            before.add(k)
    assert got == want
    assert seen.seen_rows(batch, "hash", "put_id", answers).columns == batch.columns
    rate = seen.wrong_rate(answers).first()
    assert (rate.wrong, rate.wrong_rate) == (0, 0.0)


@pytest.mark.parametrize(("portion", "span"), [(2, 40), (1 << 16, 100), (1 << 16, 1)])
def test_keys_of_earlier_turns_are_found_in_the_merged_code(spark, monkeypatch, portion, span):
    monkeypatch.setattr(seen, "BATCH_KEYS", portion)
    r = random.Random(8)
    keys = [sha("hot") if r.random() < 0.2 else sha(r.randrange(250)) for _ in range(600)]
    store = seen.build_store(spark.createDataFrame([(sha(i),) for i in range(60)], "key string"), "key", 60)
    batch = spark.createDataFrame(list(enumerate(keys)), "put_id long, hash string")
    answers = seen.probe_store(store, batch, "hash", "put_id", 60, span=span).cache()
    known, want = {sha(i) for i in range(60)}, {i for i, k in enumerate(keys) if k in keys[:i]}
    assert {x.put_id for x in seen.seen_rows(batch, "hash", "put_id", answers, span).collect()} == want | {i for i, k in enumerate(keys) if k in known}
    found = {(bytes(x.key).hex(), x.turn) for x in answers.where("repeated").collect()}
    assert found == {(k, i // span) for i, k in enumerate(keys) if k not in known and k in keys[: i // span * span]}


def test_short_fingerprints_err_and_the_rate_tells(spark):
    flat = spark.createDataFrame([(sha(i),) for i in range(3000)], "key string")
    batch = spark.createDataFrame([(i, sha(-i - 1)) for i in range(2000)], "put_id long, hash string")
    store = seen.build_store(flat, "key", 3000, bits=14)
    answers = seen.probe_store(store, batch, "hash", "put_id", 3000, bits=14).cache()
    rate = seen.wrong_rate(answers).first()
    stored = {int(sha(i)[:4], 16) >> 2 for i in range(3000)}
    wrong = sum(int(sha(-i - 1)[:4], 16) >> 2 in stored for i in range(2000))
    assert (rate.keys, rate.seen, rate.wrong, rate.wrong_rate) == (2000, 0, wrong, wrong / 2000) and wrong > 100
    assert seen.seen_rows(batch, "hash", "put_id", answers).count() == 0


@pytest.mark.parametrize("portion", [3, 1 << 16])
def test_the_rate_counts_fingerprints_of_earlier_keys_of_the_batch(spark, monkeypatch, portion):
    monkeypatch.setattr(seen, "BATCH_KEYS", portion)
    keys = [sha(-i - 1) for i in range(1500)] + [sha(i) for i in range(100)]
    random.Random(6).shuffle(keys)
    store = seen.build_store(spark.createDataFrame([(sha(i),) for i in range(500)], "key string"), "key", 500, bits=14)
    batch = spark.createDataFrame(list(enumerate(keys)), "put_id long, hash string")
    rate = seen.wrong_rate(seen.probe_store(store, batch, "hash", "put_id", 500, bits=14), earlier=True).first()
    known, prints, wrong = {sha(i) for i in range(500)}, {int(sha(i)[:4], 16) >> 2 for i in range(500)}, 0
    alone = sum(k not in known and int(k[:4], 16) >> 2 in prints for k in keys)
    for k in keys:
        wrong += k not in known and int(k[:4], 16) >> 2 in prints
        prints.add(int(k[:4], 16) >> 2)
    assert (rate.keys, rate.seen, rate.wrong, rate.wrong_rate) == (1600, 100, wrong, wrong / 1500) and wrong > alone


def test_p4_rate_against_a_plain_count(spark, data):
    known = {k for r in spark.read.parquet(f"{data}/alive_index.parquet").select("hashes").collect() for k in r[0] or [] if k}
    puts = [r[1] for r in sorted(spark.read.parquet(f"{data}/blobs.parquet").select("put_id", "hash").where(F.col("hash").rlike(seen.VALID)).collect())]
    wrong, before, prints = 0, set(known), {k[:6] for k in known if len(k) == 64}
    for k in puts:
        wrong += k not in before and k[:6] in prints
        before.add(k)
        prints.add(k[:6])
    got = QUERIES["p4_rate"](spark, data).where("bits = 24").first()
    assert (got.keys, got.wrong) == (len(set(puts)), wrong)


def test_merged_store_equals_one_built_at_once(spark):
    one, two = (spark.createDataFrame([(sha(i),) for i in some] + [("bad",), (None,)], "key string") for some in (range(200), range(100, 320)))
    merged = seen.merge_store(seen.build_store(one, "key", 300), two, "key", 300)
    whole = seen.build_store(one.unionByName(two), "key", 300)
    assert rows(merged) == rows(whole)
    empty = seen.build_store(one.where("false"), "key", 0)
    assert empty.count() == 0
    assert seen.probe_store(empty, two.withColumn("n", F.lit(1)), "key", "n", 0).where("in_store").count() == 0


def test_a_store_that_outgrows_its_partitions(spark):
    keys = spark.createDataFrame([(sha(i),) for i in range(50)], "key string")
    store = seen.build_store(keys, "key", 50)
    large = seen.merge_store(store, keys, "key", seen.PARTITION_KEYS * 256 + 1)
    assert large.agg(F.sum("n")).first()[0] == 50 and {r.digits for r in large.select("digits").collect()} == {3}
    assert {bytes(r.key).hex() for r in seen.stored_keys(large).collect()} == {sha(i) for i in range(50)}
    batch = spark.createDataFrame([(i, sha(i)) for i in range(40, 60)], "put_id long, hash string")
    assert {bytes(r.key).hex() for r in seen.probe_store(large, batch, "hash", "put_id", 7).where("in_store").collect()} == {sha(i) for i in range(40, 50)}
    assert seen.store_size(store).first().rest_bytes == 25  # 7 of 32 bytes are told by the partition and the code
    keys = seen._sorted(np.random.default_rng(2).integers(0, 256, (20_000, 32), np.uint8) & np.array([0] + [255] * 31, np.uint8))
    row = seen._coded("00", keys, 2, 56)
    assert (seen._keys(row) == keys).all() and sum(len(row.column(c)[0].as_py()) for c in ("highs", "lows", "rest")) / 20_000 < 25 + 4.5


def test_seen_keys_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "PARTITION_KEYS", 1)  # more than 256 keys want three digits
    known = seen.SeenKeys(spark, f"file://{tmp_path}/s")
    known.add(spark.createDataFrame([(sha(i),) for i in range(100)], "key string"), "key", 100)
    batch = lambda *some: spark.createDataFrame([(i, sha(i)) for i in some], "put_id long, hash string")
    held = lambda answers: {bytes(r.key).hex() for r in answers.where("in_store").collect()}
    commit = known.log.commit
    monkeypatch.setattr(known.log, "commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        known.take(batch(*range(90, 400)), "hash", "put_id", 100)
    monkeypatch.setattr(known.log, "commit", commit)
    assert held(known.take(batch(*range(90, 400)), "hash", "put_id", 100)) == {sha(i) for i in range(90, 100)}
    assert {r.digits for r in known.store().select("digits").collect()} == {3}
    assert held(known.take(batch(5, 399, 400), "hash", "put_id", 100)) == {sha(5), sha(399)} and known.log.latest()[1]["keys"] == 401


# ---- near-duplicates ------------------------------------------------------------------------------------------

INTAKE = "intake_id long, batch_no int, content_hash string, chunks array<struct<hash:string,size:bigint>>"


def brute(files):
    out, before = set(), []
    for i, _, content, chunks in sorted(files):
        mine = {c[0] for c in chunks or [] if c[0] is not None}
        for j, other_content, other in before:
            union = len(mine | other)
            if (content is not None and content == other_content) or (mine and other and len(mine & other) * 10 >= 7 * union):
                out.add((i, j))
                break
        before.append((i, content, mine))
    return out


def family(r, files, hot=0.0):
    """Random files, edited copies of earlier ones, exact copies, and hot chunks."""
    out = []
    for i in range(1, files + 1):
        kind = r.random()
        if out and kind < 0.55:
            chunks = [c for c in (r.choice(out)[3] or [])]
            for _ in range(r.randrange(0, 4)):
                if chunks and r.random() < 0.6:
                    chunks.pop(r.randrange(len(chunks)))
                else:
                    chunks.insert(r.randrange(len(chunks) + 1), (f"n{r.random()}", 1))
        else:
            chunks = [(f"c{r.randrange(10**6)}", 1) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 8, 12, 30]))]
        if r.random() < hot:
            chunks += [("hot", 1), ("warm", 1)]
        if r.random() < 0.05:
            chunks.append((None, None))
        out.append((i, 1 + i // 50, r.choice([None, f"h{r.randrange(files)}", f"u{i}"]), chunks if r.random() < 0.95 else None))
    return out


@pytest.mark.parametrize(("seed", "hot", "anchors"), [(1, 0.0, 64), (2, 0.6, 64), (3, 0.5, 2)])
def test_matches_against_brute_force(spark, monkeypatch, seed, hot, anchors):
    monkeypatch.setattr(near, "ANCHORS", anchors)  # few anchors: large buckets go round by round
    monkeypatch.setattr(near, "HOT_LEAST", 20)
    files = family(random.Random(seed), 350, hot)
    df = spark.createDataFrame(files, INTAKE).withColumn("cid", F.lit("clash"))
    assert {(r.intake_id, r.earlier_id) for r in near.earliest_matches(df).collect()} == brute(files)


def test_no_pair_is_lost_between_block_tables():
    """Every pair of similar sets shares a signature, whatever is called frequent."""
    r = random.Random(9)
    for hot_share in (0.0, 0.3, 1.0):
        sets = []
        for _ in range(300):
            a = [r.getrandbits(63) for _ in range(r.choice([3, 4, 5, 7, 10, 17, 40]))]
            b = list(a)
            for _ in range(r.randrange(0, 1 + len(a) // 3)):
                if r.random() < 0.5 and len(b) > 3:
                    b.pop(r.randrange(len(b)))
                else:
                    b.append(r.getrandbits(63))
            sets.append((set(a), set(b)))
        flat = [x for pair in sets for x in pair]
        hot = np.sort(np.array(sorted({e for s in flat for e in s if r.random() < hot_share}), np.uint64))
        sizes = np.array([len(s) for s in flat])
        out = near.signatures(np.arange(len(flat)), sizes, np.array([e for s in flat for e in s], np.int64), hot)
        by = {}
        for sig, cid in zip(out["sig"].tolist(), out["cid"].tolist()):
            by.setdefault(cid, set()).add(sig)
        for i, (a, b) in enumerate(sets):
            if a != b and len(a & b) * 10 >= 7 * len(a | b):
                assert by[2 * i] & by[2 * i + 1], (a, b)


def test_history_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near, "HOT_LEAST", 20)
    monkeypatch.setattr(near, "GROWTH", 1)  # a new epoch with every batch
    files = family(random.Random(4), 180, 0.3)
    history = near.History(spark, f"file://{tmp_path}/history")
    crash, got = history.log.commit, set()
    for start in range(0, 180, 60):
        batch = spark.createDataFrame(files[start : start + 60], INTAKE)
        if start == 60:  # dies between its last write and the commit
            monkeypatch.setattr(history.log, "commit", lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                history.take(batch)
            monkeypatch.setattr(history.log, "commit", crash)
        got |= {(r.intake_id, r.earlier_id) for r in history.take(batch).collect()}
    assert got == brute(files) == {tuple(r) for r in history.answers().collect()}
    assert len(history.log.latest()[1]["epochs"]) == 3
    with pytest.raises(ValueError, match="taken already"):
        history.take(spark.createDataFrame(files[:5], INTAKE))
    assert history.take(spark.createDataFrame([], INTAKE)).count() == 0 and history.log.sweep() == 1


@pytest.mark.parametrize("numbers", ["copies", "backwards", "missing"])
def test_batch_numbers_that_run_against_the_ids(spark, monkeypatch, numbers):
    """Batches 1 to 6 come once more with every copy of the table, backwards, or early files have no number."""
    number = {"copies": lambda i: 1 + i // 10 % 6, "backwards": lambda i: 20 - i // 10, "missing": lambda i: None if i < 5 else 1 + i // 10}[numbers]
    files = [(i, number(i), content, chunks) for i, _, content, chunks in family(random.Random(6), 180)]
    taken, plain = [], near.History.take
    monkeypatch.setattr(near.History, "take", lambda self, batch: taken.append(batch.count()) or plain(self, batch))
    got = near.earliest_matches(spark.createDataFrame(files, INTAKE), "batch_no", 3)
    assert {(r.intake_id, r.earlier_id) for r in got.collect()} == brute(files)
    assert sum(taken) == 180 and len(taken) == 3 and min(taken) > 50


def test_elements_that_become_frequent_later_make_no_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near, "HOT_LEAST", 20)
    monkeypatch.setattr(near, "ANCHORS", 5)
    sets = [[f"{k}-{i}" for k in "abc"] + ["late"] * (i > 60 or i == 30) for i in range(1, 161)]
    sets += [[*sets[29], "x"], [*sets[99], "y"], [*sets[99], "z"]]
    files = [(i, 1, None, [(h, 1) for h in chunks]) for i, chunks in enumerate(sets, 1)]
    calls, plain = [], near._similar
    monkeypatch.setattr(near, "_similar", lambda *a: calls.append(1) or plain(*a))
    history = near.History(spark, f"file://{tmp_path}/history")
    for start, end in ((0, 60), (60, 160), (160, 163)):
        history.take(spark.createDataFrame(files[start:end], INTAKE))
    assert {tuple(r) for r in history.answers().collect()} == brute(files) == {(161, 30), (162, 100), (163, 100)}
    assert len(history.log.latest()[1]["epochs"]) == 2 and len(calls) == 3


@pytest.mark.parametrize("anchors", [64, 2])
def test_history_pairs_no_old_sets_with_old_ones(spark, tmp_path, monkeypatch, anchors):
    monkeypatch.setattr(near, "ANCHORS", anchors)
    files = [(i, 1, None, [(f"c{k}", 1) for k in range(12)] + [(f"n{i}", 1)]) for i in range(1, 10)]
    compared, plain = [], near._similar

    def spy(pairs, sets):
        compared.extend(r.late for r in pairs.collect())
        return plain(pairs, sets)

    monkeypatch.setattr(near, "_similar", spy)
    history, got = near.History(spark, f"file://{tmp_path}/history"), set()
    for start in (0, 6):
        compared.clear()
        got |= {(r.intake_id, r.earlier_id) for r in history.take(spark.createDataFrame(files[start : start + (6 if not start else 3)], INTAKE)).collect()}
    assert got == brute(files)
    assert compared and min(compared) > 6


def test_a_match_is_verified_on_the_hashes_themselves(spark, monkeypatch):
    files = [(1, 1, None, [(f"a{k}", 1) for k in range(9)]), (2, 1, None, [(f"b{k}", 1) for k in range(9)] + [("x", 1)])]
    # The last character alone decides a 64-bit hash: the two sets look nearly equal.
    monkeypatch.setattr(near.F, "xxhash64", lambda c: F.conv(F.hex(F.substring(F.hex(c), -2, 2)), 16, 10).cast("bigint") * 1000003)
    assert near.earliest_matches(spark.createDataFrame(files, INTAKE)).count() == 0


def test_empty_and_single(spark):
    none = spark.createDataFrame([], INTAKE)
    assert near.earliest_matches(none).count() == 0
    one = spark.createDataFrame([(1, 1, None, None), (2, 1, None, []), (3, 1, None, [(None, 1)])], INTAKE)
    assert near.earliest_matches(one).count() == 0


def test_queries_against_sql(spark, data):
    import duckdb

    connection = duckdb.connect()
    for name in ("blobs", "alive_index", "intake_files"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    for name in ("p4_found", "p5_found"):
        df = QUERIES[name](spark, data)
        got = connection.execute(ORACLE[name])
        order = [[c[0] for c in got.description].index(c) for c in df.columns]
        assert rows(df) == sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=str)
    assert [r.wrong for r in QUERIES["p4_rate"](spark, data).orderBy("bits").collect()][-1] == 0
