import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltbed.llm import bpe, packing
from siltbed.llm.abuse import UNKNOWN, Scorer, abuse_scores, train
from siltbed.llm.gru import BiGru, char_slots
from siltbed.llm.queries import QUERIES
from siltbed.llm.words import WIDTH, Words, hash_strings, windows
from tests.conftest import rows

HARD = [
    "it's 'select don't we'll 'llama x''s '' 's'd 't 'S", "  \n\n  a\t\tb \n", "", "<|endoftext|> hi", " " * 500 + "x", "a" * 3000, "=" * 701, "漢字" * 300, " ' 's   x　y", "'", "'r", "'l", "x'",
    "\x1c\x1d \x85a", "𝔘𝔫𝔦 ½²x", " 'sx", "ab" * 400 + "'ve", "\r\n\r\n  if", "1234 5678 ١٢", "é́ 👩‍👩‍👧", "\x00\x01", "aA" * 2000 + "0" * 999, "﻿int x;", "a" * 191 + "b", "ab" * 96, "ab" * 97,
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/{bpe.NAME}.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load())


def encode(encoder, texts):
    ids, sizes, _ = encoder.encode(*bpe.text_bytes(pa.array(texts, pa.string())))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_hard_texts(encoder, reference):
    assert encode(encoder, HARD) == reference(HARD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n\t'sdmtlverLL0a=")))), max_size=6))
def test_any_text(encoder, reference, texts):
    assert encode(encoder, texts) == reference(texts)


def test_forgetting_changes_nothing(monkeypatch, reference):
    monkeypatch.setattr(bpe, "REMEMBER", 20)
    small = bpe.Encoder(bpe.load())
    texts = [" ".join(str(random.Random(i).random()) for _ in range(8)) for i in range(30)]
    assert [encode(small, [t])[0] for t in texts] == reference(texts)


def test_whole_corpus(spark, data, reference):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    got = {r.doc_id: list(r.ids) for r in QUERIES["p8_ids"](spark, data).collect()}
    assert got == dict(zip(texts, reference(list(texts.values()))))


def test_encoding_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "", 6), (2, "hi", None)], "doc_id long, text string, ids int")
    got = bpe.encode_texts(df)
    assert rows(got) == sorted([(1, []), (1, []), (None, []), (2, [5303])], key=str)
    assert bpe.encode_texts(df.where("false")).count() == 0


def test_a_long_text_is_worked_whole(spark, reference, monkeypatch):
    long = "".join(random.Random(3).choices("abc defgh\n漢1", k=400_000))
    got = bpe.encode_texts(spark.createDataFrame([(1, long), (2, "x")], "doc_id long, text string"))
    assert {r.doc_id: list(r.ids) for r in got.collect()} == {1: reference([long])[0], 2: reference(["x"])[0]}


# ---- packing --------------------------------------------------------------------------------------------------


def test_hilbert_curve_visits_neighbours():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = packing.hilbert_key(cells, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_every_token_in_one_container(spark, monkeypatch, seed):
    monkeypatch.setattr(packing, "WINDOW", 50)
    r = random.Random(seed)
    sizes = {i: r.choice([1, 2, 7, 8, 9, 16, 100, 16, r.randrange(1, 60)]) for i in range(300)}
    items = spark.createDataFrame([(i, n, r.randrange(1000) if i % 3 else 7) for i, n in sizes.items()], "doc_id long, tokens long, curve long")
    placed = packing.pack(items, [("small", 16), ("large", 64)], 3).collect()
    for kind, capacity in (("small", 16), ("large", 64)):
        mine = [p for p in placed if p.container_kind == kind]
        for i, n in sizes.items():
            spans = sorted((p.token_start, p.token_count) for p in mine if p.doc_id == i)
            assert sum(c for _, c in spans) == n and all(a + c == b for (a, c), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
            assert len(spans) == 1 or n > capacity
        containers = {}
        for p in mine:
            containers.setdefault(p.container_id, []).append((p.position, p.token_count))
        for spans in containers.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a + c == b for (a, c), (b, _) in zip(spans, spans[1:])) and sum(c for _, c in spans) <= capacity
        assert sum(sizes.values()) / (len(containers) * capacity) > 0.9


def test_packing_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    items = packing.measured(docs)
    assert items.count() == 0 and packing.pack(items, [("k", 8)], 2).count() == 0
    same = packing.measured(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")).collect()
    assert same[0].curve == same[1].curve and same[0].tokens == 3


def test_corpus_fits(spark, data):
    rates = {r.container_kind: r for r in QUERIES["p9_rates"](spark, data).collect()}
    tokens = sum(len(r.ids) for r in QUERIES["p8_ids"](spark, data).collect())
    assert len(rates) == 3 and all(r.tokens == tokens and r.containers <= r.least * 1.02 + 2 for r in rates.values())


# ---- words and scores -----------------------------------------------------------------------------------------

SPELLINGS = {
    "wh3r3 you l1v3, h05p1+4l": "where you live hospital",
    "never h.i.r.e them, t-h-e-y v e r m i n": "never hire them they vermin",
    "hi­re nit​wit": "hire nitwit",
    "BEHInD bArS camelCaseName HTTPServer": "behind bars camel case name htp server",
    "t*ke n*591": "t*ke",
    "proooooud énorme ｆｕｌｌ": "proud enorme ful",
    "snake_case x 0x5bfb 12 sha256": "snake case sha",
    "": "",
}


def test_spellings():
    texts = list(SPELLINGS)
    words = Words(*bpe.text_bytes(pa.array(texts)))
    strings = words.strings(np.arange(len(words.starts)))
    got = [" ".join(s for s, t in zip(strings, words.text) if t == i) for i in range(len(texts))]
    assert got == list(SPELLINGS.values())
    assert (hash_strings(strings) == words.hashes()).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("aA1$*._ \n")))), max_size=5))
def test_words_of_a_batch_are_those_of_each_text(texts):
    whole = Words(*bpe.text_bytes(pa.array(texts, pa.string())))
    strings = whole.strings(np.arange(len(whole.starts)))
    for i, text in enumerate(texts):
        alone = Words(*bpe.text_bytes(pa.array([text], pa.string())))
        assert alone.strings(np.arange(len(alone.starts))) == [s for s, t in zip(strings, whole.text) if t == i]


@given(st.lists(st.integers(1, 60), max_size=8))
def test_windows_cover_every_word(sizes):
    lines = np.repeat(np.arange(len(sizes)), sizes)
    start, size = windows(lines)
    covered = {i for s, n in zip(start, size) for i in range(s, s + n)}
    assert covered == set(range(len(lines)))
    assert all(lines[s] == lines[s + n - 1] and n <= WIDTH for s, n in zip(start, size))


def test_gradients():
    net = BiGru(10)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    grid = np.array([[0, 1, 2, 3], [2, 3, 0, 0], [1, 1, 0, 0]])
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    words = (np.array([1, 3, 4, 2]), np.array([5, 6, 7, 9, 11]), np.array([0, 2, 2, 1]))
    call = lambda: net.gradients(words, grid, mask, np.array([1.0, 0, 1]), np.array([1.0, 2, 1]))
    _, g = call()
    for k in ("Uf", "Ub", "Xf", "Xb", "bf", "A", "va", "vo", "bo"):
        at = tuple(min(1, s - 1) for s in net.p[k].shape)
        kept = net.p[k][at]
        net.p[k][at] = kept + 1e-3
        above = call()[0]
        net.p[k][at] = kept - 1e-3
        below = call()[0]
        net.p[k][at] = kept
        assert abs((above - below) / 2e-3 - g[k][at]) < 1e-4


def bags(r, n):
    """Documents of lines; the labelled ones hold one line of insult or, as a trap, coarse words at code."""
    noun = lambda: r.choice("socket ledger tide archive beacon cursor gauge lamp".split())
    plain = lambda: r.choice([f"return {noun()}", f"open the {noun()} before the {noun()}", f"def {noun()}", f"this stupid {noun()} is broken again", f"kill the {noun()} process"])
    bad = lambda: r.choice([f"you are a stupid {r.choice(['moron', 'idiot', 'halfwit'])}", f"go away you {r.choice(['moron', 'idiot', 'halfwit'])}", "nobody likes you idiot"])
    out = []
    for _ in range(n):
        label = r.random() < 0.3
        lines = [plain() for _ in range(r.randrange(3, 12))] + ([bad()] if label else [])
        out.append((lines, int(label if r.random() > 0.03 else not label), int(label)))
    return out


def test_held_out_accuracy():
    r = random.Random(2)
    fit, held = bags(r, 250), bags(r, 150)
    model = train([b for b, _, _ in fit], [y for _, y, _ in fit])
    scorer = Scorer(model)
    got = scorer.score(*bpe.text_bytes(pa.array(["\n".join(b) for b, _, _ in held]))) > 0.5
    assert (got == np.array([y for _, _, y in held], bool)).mean() > 0.97
    # spelled otherwise
    odd = scorer.score(*bpe.text_bytes(pa.array(["x = 1\n// y0u are a stup1d m0r0n", "# go aw­ay you halfw​it", "// this stupid ledger is broken again"])))
    assert odd[0] > 0.5 and odd[1] > 0.5 and odd[2] < 0.5


def test_the_network_alone_decides_on_unknown_words():
    r = random.Random(2)
    fit = bags(r, 250)
    model = train([b for b, _, _ in fit], [y for _, y, _ in fit])
    model.net.p["bo"][:] += 8
    for text in ("idiotface moronic halfwited", "you superidiots halfwitmoron moronish"):  # none known, one among three
        words = text.split()
        ids = model.number(hash_strings(words))
        assert (ids == UNKNOWN).sum() == 3
        table = model.net.vectors(ids, *char_slots(words))
        want = model.net.forward(table, np.arange(len(words))[None, :], np.ones((1, len(words)), bool))[0]
        assert abs(Scorer(model).score(*bpe.text_bytes(pa.array([text])))[0] - want) < 1e-4 and want > 0.5


def test_long_words_are_cut_and_scored():
    r = random.Random(4)
    letters = "".join(r.choice("bcdfghjklm") + r.choice("aeiou") for _ in range(60))
    words = Words(*bpe.text_bytes(pa.array([f"open {letters[:40]} {letters[:41]} gate", letters])))
    pieces = words.strings(np.arange(len(words.starts)))
    assert pieces[:3] == ["open", letters[:40], letters[:20]] and pieces[5:7] == [letters[30:41], "gate"]
    assert [p for p, t in zip(pieces, words.text) if t] == [letters[i : i + 20] for i in range(0, 101, 10)]
    assert (hash_strings(pieces) == words.hashes()).all()
    insult = "goawayyoumoronyouareastupididiotgoawayyouhalfwit"  # 48 letters between two signs
    fit = bags(r, 250) + [([f"return ledger {insult}"], 1, 1)] * 10

    def cut(line):
        words = Words(*bpe.text_bytes(pa.array([line])))
        return " ".join(words.strings(np.arange(len(words.starts))))

    model = train([[cut(line) for line in b] for b, _, _ in fit], [y for _, y, _ in fit])
    got = Scorer(model).score(*bpe.text_bytes(pa.array([f"x = 1\nopen the {insult}", "open the ledger"])))
    assert got[0] > 0.5 > got[1]


def test_training_without_one_kind():
    model = train([["a b"], ["c d"]], [0, 0])
    assert (Scorer(model).score(*bpe.text_bytes(pa.array(["a b", "", "zz"]))) < 0.5).all()
    assert (Scorer(train([], [])).score(*bpe.text_bytes(pa.array(["a b"]))) < 0.5).all()


def test_scores_of_odd_rows(spark):
    r = random.Random(3)
    docs = [(i, "\n".join(b), y) for i, (b, y, _) in enumerate(bags(r, 120))]
    df = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(900, None), (901, ""), (902, "x" * 200_000 + "\ngo away you idiot"), (None, "hi"), (902, "twice")], "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, "r", y) for i, _, y in docs] + [(900, "r", 1), (7777, "r", 1), (1, "q", None), (2, "r", 1), (2, "q", 0)], "doc_id long, rater string, abusive int")
    got = abuse_scores(df, labels).collect()
    assert len(got) == 125
    by = {(r.doc_id, r.score > 0.5) for r in got if r.doc_id in (900, 901, None)}
    assert by == {(900, False), (901, False), (None, False)}
    assert max(r.score for r in got if r.doc_id == 902) > 0.5
    assert abuse_scores(df.where("false"), labels).count() == 0


def _library(texts):
    import json

    from tokenizers import Tokenizer

    model = json.loads(open(f"{bpe.TOKENIZERS}/{bpe.NAME}.json", encoding="utf-8").read()) | {"added_tokens": []}
    return [Tokenizer.from_str(json.dumps(model)).encode(t, add_special_tokens=False).ids if t else [] for t in texts]


def _encoded(encoder, texts):
    ids, sizes, _ = encoder.encode(*bpe.text_bytes(pa.array(texts)))
    return [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]


def test_words_that_polynomial_hashes_confuse():
    row = np.zeros(1, np.uint8)
    while len(row) < 2048:
        row = np.concatenate([row, 1 - row])
    one, other = (bytes((97 + r).tolist()).decode() for r in (row, 1 - row))
    texts = [one, other, one + other, f"{one} {other}"]
    encoder = bpe.Encoder(bpe.load())
    assert _encoded(encoder, texts[:1]) + _encoded(encoder, texts[1:]) == _library(texts)


def test_equal_hashes_of_different_pieces(monkeypatch):
    plain = bpe.Encoder.pieces

    def poor(self, data, bounds):
        starts, lengths, hashes = plain(self, data, bounds)
        return starts, lengths, hashes % np.uint64(3)

    monkeypatch.setattr(bpe.Encoder, "pieces", poor)
    texts = ["def main(): return 1", "", "int main() { return 12345; }", "x" * 300 + " " + "y" * 300, "main main"]
    encoder = bpe.Encoder(bpe.load())
    assert [_encoded(encoder, [t])[0] if t else [] for t in texts] == _library(texts) == _encoded(encoder, texts)


def test_long_pieces_of_any_length():
    r = np.random.default_rng(4)
    texts = ["a" * n for n in (191, 192, 193, 385, 5000)] + ["-" * 700 + "=" * 77, "ab" * 500 + "a", "é" * 999 + "漢字" * 700, "".join(chr(97 + c) for c in r.integers(0, 4, 3000)), bytes(r.integers(97, 123, 2000).tolist()).decode()]
    assert _encoded(bpe.Encoder(bpe.load()), texts) == _library(texts)


def test_two_capacities_of_one_kind(spark):
    items = spark.createDataFrame([(1, 30, 0), (2, 50, 1), (3, 7, 2)], "doc_id long, tokens long, curve long")
    placed = packing.pack(items, [("k", 40), ("k", 100)], 1).groupBy("capacity").sum("token_count").collect()
    assert {tuple(r) for r in placed} == {(40, 87), (100, 87)}
