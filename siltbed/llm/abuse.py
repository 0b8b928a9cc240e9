"""Scores for abusive, hateful or sexual content.

A document's words (see ``words``) fall into lines and overlapping windows; a bidirectional gated recurrent network with
attention pooling over word and character inputs scores each window, and the document's score is its greatest. Labels
are given per document, some of them wrong, so training finds the telling windows: it starts from words that are
frequent in abusive documents only, then alternates between fitting windows and choosing them anew by their scores.

Words that are common in harmless documents and rare in abusive ones are one neutral word, and runs of it count once;
so most windows of a corpus are the same few, and each distinct window is scored once per batch.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.bpe import portions, text_bytes
from siltbed.llm.gru import Adam, BiGru, char_slots
from siltbed.llm.words import WIDTH, Words, hash_strings, run_hashes, windows

#: Most labelled documents that are used for training, the ones of least hash. This and the next bound what comes to the
#: driver; neither touches scoring.
MOST_LABELLED = 6000
#: Most distinct lines of one of them, those of least hash.
MOST_LINES = 2000
#: From this score on a document counts as abusive.
THRESHOLD = 0.5
NEUTRAL, UNKNOWN, FIRST_WORD = 1, 2, 3
REMEMBER = 400_000
#: Windows of harmless documents, and unchosen ones of abusive documents, that a round of training uses: half of them
#: the highest scored, half drawn at random.
MOST_WINDOWS = 8000
#: How many times as often abusive documents must have a window as harmless ones before it can be a telling one.
TELLING = 4.0
#: Windows of random letters among the harmless ones.
NOISE_WINDOWS = 3000


class Model:
    """The network with its vocabulary: hashes of known words (sorted) and their numbers, neutral words included."""

    def __init__(self, net: BiGru, vocabulary: dict[str, int], neutral: set[str]):
        self.net = net
        words = [*vocabulary, *neutral]
        numbers = np.array([*vocabulary.values(), *([NEUTRAL] * len(neutral))], np.int64)
        hashes = hash_strings(words) if words else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], numbers[order]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), UNKNOWN)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], UNKNOWN)


class Scorer:
    """Scores texts; remembers the input vectors of words and the scores of windows it has met."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        #: Row 0 is padding, row 1 the neutral word; the keys are word hashes (0 and 1 stand for these two).
        self.words = pd.Index(np.array([0, 1], np.uint64))
        self.table = self.model.net.vectors(np.array([0, NEUTRAL]), np.zeros(0, np.int64), np.zeros(2, np.int64))
        self.seen, self.scores = pd.Index(np.zeros(0, np.uint64)), np.zeros(0, np.float32)

    def _rows(self, words: Words) -> np.ndarray:
        """The row of each word in the table."""
        local, distinct = pd.factorize(words.hashes())
        first = np.zeros(len(distinct), np.int64)
        first[local[::-1]] = np.arange(len(local))[::-1]
        number = self.model.number(distinct)
        row = np.where(number == NEUTRAL, 1, self.words.get_indexer(distinct))
        fresh = np.flatnonzero(row < 0)
        if len(fresh):
            slots, sizes = char_slots(words.strings(first[fresh]))
            row[fresh] = len(self.words) + np.arange(len(fresh))
            self.words = pd.Index(np.concatenate([self.words.to_numpy(), distinct[fresh]]))
            self.table = np.concatenate([self.table, self.model.net.vectors(number[fresh], slots, sizes)])
        return row[local]

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The greatest window score of each text; 0 for one without words."""
        if len(self.words) > REMEMBER or len(self.seen) > 4 * REMEMBER:
            self._forget()
        words = Words(data, bounds)
        out = np.zeros(words.texts)
        if not len(words.starts):
            return out
        row = self._rows(words)
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != 1) | (row[:-1] != 1) | (words.line[1:] != words.line[:-1])
        row, line, text = row[keep], words.line[keep], words.text[keep]
        start, size = windows(line)
        keys = run_hashes(self.words.to_numpy()[row], start, size)
        local, distinct = pd.factorize(keys)
        at = self.seen.get_indexer(distinct)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            first = np.zeros(len(distinct), np.int64)
            first[local[::-1]] = np.arange(len(local))[::-1]
            at[fresh] = len(self.seen) + np.arange(len(fresh))
            self.scores = np.concatenate([self.scores, self._score_windows(row, start[first[fresh]], size[first[fresh]])])
            self.seen = pd.Index(np.concatenate([self.seen.to_numpy(), distinct[fresh]]))
        np.maximum.at(out, text[start], self.scores[at[local]])
        return out

    def _score_windows(self, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.float32)
        order = np.argsort(size, kind="stable")
        for some in np.array_split(order, max(1, len(order) // 4096)):
            width = int(size[some].max())
            mask = np.arange(width)[None, :] < size[some][:, None]
            rows = np.where(mask, row[np.minimum(start[some][:, None] + np.arange(width), len(row) - 1)], 0)
            distinct, local = np.unique(rows, return_inverse=True)
            out[some] = self.model.net.forward(self.table[distinct], local.reshape(rows.shape), mask)
        return out


def text_lines(documents: DataFrame, most: int) -> DataFrame:
    """(doc_id, lines): the distinct lines of each text as words set apart by blanks, at most ``most`` of them, those of
    least hash; for the labelled sample only."""

    def work(batches):
        for part in portions(batches, "text"):
            words = Words(*text_bytes(part.column("text")))
            strings = words.strings(np.arange(len(words.starts)))
            first = np.flatnonzero(np.concatenate([[True], words.line[1:] != words.line[:-1]])) if len(words.line) else np.zeros(0, np.int64)
            found: list[set[str]] = [set() for _ in range(words.texts)]
            for s, e in zip(first.tolist(), [*first[1:].tolist(), len(strings)]):
                found[words.text[s]].add(" ".join(strings[s:e]))
            kept = [sorted(f if len(f) <= most else sorted(f, key=lambda line: (zlib.crc32(line.encode()), line))[:most]) for f in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(kept, pa.list_(pa.string()))], names=["doc_id", "lines"])

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id bigint, lines array<string>")


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[list[list[str]], list[int]]:
    """Lines and label of up to ``most`` labelled documents. A document's raters are averaged; an undecided one, a
    null label and a label of no document are left out."""
    voted = labels.where(F.col("abusive").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("abusive").cast("double")).alias("share")).where("share <> 0.5")
    chosen = voted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = text_lines(texts.select("doc_id", "text"), MOST_LINES).join(F.broadcast(chosen), "doc_id").select("doc_id", "lines", "share").collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.lines for r in rows], [int(r.share > 0.5) for r in rows]


def _noise(r: np.random.Generator) -> list[tuple[str, ...]]:
    """Harmless windows of random letters, Latin and not, as keys, digests and binary rubbish have them."""
    out = []
    for _ in range(NOISE_WINDOWS):
        high = 255 if r.random() < 0.5 else 123
        longest = int(r.choice([4, 8, 24]))
        sizes = r.integers(2, longest + 1, int(r.integers(1, WIDTH + 1)))
        codes = [np.where((c := r.integers(97, high, n)) < 128, 97 + c % 26, c) for n in sizes]
        words = [bytes(c.astype(np.uint8).tolist()).decode("latin-1") for c in codes]
        if r.random() < 0.5:  # with code between
            words = [x for w in words for x in (w, "")]
        out.append(tuple(words[:WIDTH]))
    return out


def train(bags: list[list[str]], labels: list[int], seed: int = 3, rounds: int = 4, epochs: int = 4) -> Model:
    """Fit the network to documents given as bags of lines, cut into windows as scoring cuts them: after runs of neutral
    words have become one. Without documents of both kinds every score is low."""
    positives, negatives = Counter(), Counter()
    for bag, label in zip(bags, labels):
        (positives if label else negatives).update({w for line in bag for w in line.split()})
    p, n = sum(labels), len(labels) - sum(labels)
    odds = {w: np.log((positives[w] + 0.3) / (p + 1)) - np.log((negatives[w] + 0.3) / (n + 1)) for w in positives | negatives}
    neutral = {w for w in odds if negatives[w] >= 2 and odds[w] < 1.0}
    telling = sorted(w for w in odds if w not in neutral and positives[w] + negatives[w] > 1)
    vocabulary = {w: FIRST_WORD + i for i, w in enumerate(telling)}
    net = BiGru(FIRST_WORD + len(telling), seed)
    net.p["bo"][:] = -2
    model = Model(net, vocabulary, neutral)
    if not p or not n:
        net.p["bo"][:] = -8
        net.p["vo"][:] = 0
        return model

    def cut(line: str) -> list[tuple[str, ...]]:
        out: list[str] = []
        for w in line.split():
            w = "" if w in neutral else w
            if w or not out or out[-1]:
                out.append(w)
        return [tuple(out[s : s + n]) for s, n in zip(*(x.tolist() for x in windows(np.zeros(len(out), np.int64))))]

    in_bag = [sorted({w for line in bag for w in cut(line)} - {("",)}) for bag in bags]
    stats: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for bag, label in zip(in_bag, labels):
        for window in bag:
            stats[window][label] += 1
    for window in _noise(r := np.random.default_rng(seed)):
        stats[window][0] += 1
    every = sorted(stats)
    index = {w: i for i, w in enumerate(every)}
    counts = np.array([stats[w] for w in every], np.float64).reshape(-1, 2)
    bags_at = [np.array([index[w] for w in bag], np.int64) for bag in in_bag]

    words = sorted({w for window in every for w in window if w})
    slots, sizes = char_slots(words)
    slot_start = np.cumsum(sizes) - sizes
    word_row = {w: i + 1 for i, w in enumerate(words)} | {"": 0}
    ids = np.array([NEUTRAL] + [vocabulary.get(w, UNKNOWN) for w in words])
    row_sizes, row_starts = np.concatenate([[0], sizes]), np.concatenate([[0], slot_start])
    lengths = np.array([len(w) for w in every])
    grid = np.zeros((len(every), WIDTH), np.int64)
    for i, window in enumerate(every):
        grid[i, : len(window)] = [word_row[w] for w in window]

    def prepared(some: np.ndarray, drop: float):
        width = int(lengths[some].max())
        distinct, local = np.unique(grid[some, :width], return_inverse=True)
        own = ids[distinct].copy()
        own[(own >= FIRST_WORD) & (r.random(len(own)) < drop)] = UNKNOWN
        take = row_sizes[distinct]
        picks = slots[np.repeat(row_starts[distinct] - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))]
        return (own, picks, take), local.reshape(len(some), width), np.arange(width)[None, :] < lengths[some][:, None]

    def drawn(some: np.ndarray, by: np.ndarray) -> np.ndarray:
        if len(some) <= MOST_WINDOWS:
            return some
        ranked = some[np.argsort(-by[some], kind="stable")]
        return np.concatenate([ranked[: MOST_WINDOWS // 2], r.choice(ranked[MOST_WINDOWS // 2 :], MOST_WINDOWS // 2, replace=False)])

    def scores() -> np.ndarray:
        out = np.zeros(len(every), np.float32)
        for some in np.array_split(np.argsort(lengths, kind="stable"), max(1, len(every) // 2048)):
            if len(some):
                word, local, mask = prepared(some, 0.0)
                out[some] = net.forward(net.vectors(*word), local, mask)
        return out

    # The first choice: windows whose words lean to abusive documents and that harmless ones hardly have.
    lean = np.array([sum(max(0.0, min(odds.get(w, 0.0), 4.0)) * (positives[w] > 1) for w in window if w) / np.sqrt(len(window)) for window in every])
    rate = (counts[:, 1] + 0.2) / (p + 1) / ((counts[:, 0] + 0.2) / (n + 1))
    quality = np.where(rate > TELLING, lean + 0.3 * np.log(rate), 0.0)
    adam = Adam(net)
    for turn in range(rounds):
        chosen = np.zeros(len(every), bool)
        for bag, label in zip(bags_at, labels):
            if label and len(bag):
                # A document without a telling window is taken for wrongly labelled.
                chosen[bag[quality[bag] >= (max(0.9 * quality[bag].max(), 2.0) if turn == 0 else 0.5)]] = True
        chosen &= rate > TELLING
        # Neither taken for abusive nor for harmless: only what harmless documents hardly have.
        doubtful = ~chosen & (rate > TELLING) & (quality > (2.5 if turn == 0 else 0.5)) & (counts[:, 1] > 0)
        harmless = np.flatnonzero(~chosen & ~doubtful & (counts[:, 0] > 0))
        other = np.flatnonzero(~chosen & ~doubtful & (counts[:, 0] == 0))
        good = np.flatnonzero(chosen)
        harmless, other = drawn(harmless, quality), drawn(other, quality)
        if not len(good):
            break
        use = np.concatenate([good, harmless, other])
        weight = np.concatenate([np.sqrt(counts[good, 1]) * 2, np.minimum(3, np.sqrt(counts[harmless, 0])), np.full(len(other), 0.5)])
        target = np.concatenate([np.ones(len(good)), np.zeros(len(use) - len(good))])
        for epoch in range(epochs):
            adam.rate = 0.015 * (0.5 if turn == rounds - 1 and epoch >= epochs // 2 else 1)
            turn_order = np.argsort(lengths[use] + r.random(len(use)) * 1.5, kind="stable")
            slices = np.array_split(turn_order, max(1, len(use) // 384))
            for k in r.permutation(len(slices)):
                some = slices[k]
                _, g = net.gradients(*prepared(use[some], 0.25), target[some], weight[some])
                adam.step(g)
        quality = scores().astype(np.float64)
    return model


def document_scores(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document, whole texts; 0 for a null or empty text or one without words. Rows come out as
    they go in, repeated ones too. The model is of a bounded size: its vocabulary comes from the bounded sample."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        scorer = Scorer(shared.value)
        for part in portions(batches, "text"):
            scores = scorer.score(*text_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(scores)], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id bigint, score double")


def abuse_scores(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """Train on the labelled sample, then score every document."""
    return document_scores(documents, train(*labelled_sample(documents, labels, most)))
