"""Byte-level BPE in numpy over whole batches of texts.

Texts are cut into pieces by the tokenizer's pattern, worked out from character classes on the UTF-8 bytes of a whole
batch; each distinct piece is encoded once per task, where two pieces are the same only if all of their bytes are.
Pieces are grouped by length into padded matrices of token ids, whatever that length is; each round looks up the ranks of
new neighbouring pairs in a hash table, and every row merges its leftmost pair of the least rank and closes up; rows
without a pair leave the matrix. Where the rows of a matrix hold their least pair twice or more on average, a round merges
all of its occurrences, which is the same: a merged token only forms pairs of greater rank than the one it came from.

The vocabulary file is a parameter and never copied; the driver reads it and ships arrays of a fixed size (some 4 MB).
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public tokenizers lie, unless told otherwise.
TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Bytes of text that are worked on at a time.
BATCH_BYTES = 3 << 20
#: Distinct pieces, and bytes of them, that a task remembers; beyond it the memory starts anew, at no change of the result.
REMEMBER, REMEMBER_BYTES = 1_500_000, 64 << 20
NONE = np.uint32(0xFFFF)
NO_RANK = np.int32(0x7FFFFFFF)
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
_SLOTS = 1 << 18
_FACTOR = np.uint32(2654435769)


@dataclass
class Vocabulary:
    """byte_ids: the token of each byte. keys, ranks: open-addressing table from (left << 16 | right) to the token it
    merges to, which is also the pair's rank. classes: the class of each code point."""

    byte_ids: np.ndarray
    keys: np.ndarray
    merged: np.ndarray
    classes: np.ndarray


def _printable_bytes() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 bytes stand for themselves, the
    others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    return table | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def char_classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, everything):
            points = np.frombuffer(run.group().encode("utf-32-le"), np.uint32)
            out[points] = kind
    return out


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key * _FACTOR) >> np.uint32(14)).astype(np.int64)


@functools.lru_cache
def load(folder: str = TOKENIZERS, name: str = NAME) -> Vocabulary:
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    byte_ids = np.zeros(256, np.uint32)
    for shown, byte in _printable_bytes().items():
        byte_ids[byte] = ids[shown]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left = np.array([ids[a] for a, _ in pairs], np.uint32)
    right = np.array([ids[b] for _, b in pairs], np.uint32)
    tokens = np.array([ids[a + b] for a, b in pairs], np.int32)
    if (np.diff(tokens) <= 0).any():
        raise ValueError("ids of merged tokens must rise with the order of merges")
    keys, merged = np.full(_SLOTS, 0xFFFFFFFF, np.uint32), np.full(_SLOTS, NO_RANK, np.int32)
    key, at = (left << np.uint32(16)) | right, None
    at, open_ = _slot(key), np.arange(len(key))
    while len(open_):
        spot = at[open_]
        free = keys[spot] == 0xFFFFFFFF
        keys[spot[free]] = key[open_[free]]  # of several that want a slot, the last one written has it
        won = keys[spot] == key[open_]
        merged[spot[won]] = tokens[open_[won]]
        open_ = open_[~won]
        at[open_] = (at[open_] + 1) & (_SLOTS - 1)
    return Vocabulary(byte_ids, keys, merged, char_classes())


def pair_ranks(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The token that each pair merges to, NO_RANK where it doesn't."""
    key = (left << np.uint32(16)) | right
    at = _slot(key)
    found = v.keys[at]
    out = np.where(found == key, v.merged[at], NO_RANK)
    flat_key, flat_at, flat_out = key.ravel(), at.ravel(), out.ravel()
    open_ = np.flatnonzero((found != key).ravel() & (found != 0xFFFFFFFF).ravel())
    while len(open_):
        flat_at[open_] = (flat_at[open_] + 1) & (_SLOTS - 1)
        got = v.keys[flat_at[open_]]
        hit = got == flat_key[open_]
        flat_out[open_[hit]] = v.merged[flat_at[open_[hit]]]
        open_ = open_[~hit & (got != 0xFFFFFFFF)]
    return flat_out.reshape(out.shape)


def _merge_all(v: Vocabulary, rows: np.ndarray, ranks: np.ndarray, least: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge every occurrence of each row's least pair and close up; of touching ones (a run of one token) every second."""
    place = np.arange(rows.shape[1])
    first = hit.copy()
    first[:, 1:] &= ~hit[:, :-1]
    hit &= (place - np.maximum.accumulate(np.where(first, place, 0), axis=1)) % 2 == 0
    keep = np.ones(rows.shape, bool)
    keep[:, 1:] = ~hit[:, :-1]
    keep &= rows != NONE
    to = np.cumsum(keep, axis=1) - 1
    row, at = np.nonzero(keep)
    closed = np.full((len(rows), max(2, int(to[:, -1].max()) + 1)), NONE, np.uint32)
    moved = np.full(closed.shape, NO_RANK, np.int32)
    closed[row, to[row, at]] = np.where(hit[row, at], least[row].astype(np.uint32), rows[row, at])
    moved[row, to[row, at]] = ranks[row, at]
    row, at = np.nonzero(hit)
    at, last = to[row, at], closed.shape[1] - 1
    for r, c in ((row, at), (row[at > 0], at[at > 0] - 1)):
        moved[r, c] = np.where(c < last, pair_ranks(v, closed[r, c], closed[r, np.minimum(c + 1, last)]), NO_RANK)
    return closed, moved


def _encode_matrix(v: Vocabulary, rows: np.ndarray, fill: np.ndarray, out: list) -> None:
    """``rows``: padded token ids (n, length) of the pieces ``fill``. Appends (pieces, matrix, lengths) to ``out``."""
    ranks = np.full(rows.shape, NO_RANK, np.int32)
    ranks[:, :-1] = pair_ranks(v, rows[:, :-1], rows[:, 1:])
    while len(rows):
        best = ranks.argmin(axis=1)
        index = np.arange(len(rows))
        least = ranks[index, best]
        done = least == NO_RANK
        if done.any():
            ended = rows[done]
            out.append((fill[done], ended, (ended != NONE).sum(axis=1)))
            keep = ~done
            rows, ranks, fill, best, least = rows[keep], ranks[keep], fill[keep], best[keep], least[keep]
            if not len(rows):
                return
            index = np.arange(len(rows))
        hit = ranks == least[:, None]
        if np.count_nonzero(hit) >= 2 * len(rows):
            rows, ranks = _merge_all(v, rows, ranks, least, hit)
            continue
        rows[index, best] = least.astype(np.uint32)
        width = rows.shape[1]
        if width == 2:
            out.append((fill, rows[:, :1], np.ones(len(rows), np.int64)))
            return
        # The token behind best is gone and the others move up; the pairs on both sides of the merged one are new.
        gather = np.arange(width - 1)[None, :] + (np.arange(width - 1)[None, :] > best[:, None])
        rows = np.take_along_axis(rows, gather, axis=1)
        ranks = np.take_along_axis(ranks, gather, axis=1)
        inner = best < width - 2
        a, b = index[inner], best[inner]
        ranks[index[~inner], best[~inner]] = NO_RANK
        ranks[a, b] = pair_ranks(v, rows[a, b], rows[a, b + 1])
        a, b = index[best > 0], best[best > 0]
        ranks[a, b - 1] = pair_ranks(v, rows[a, b - 1], rows[a, b])


def encode_pieces(v: Vocabulary, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces end to end, and how many each has. ``data``: bytes; the pieces are not empty."""
    counts = np.ones(len(starts), np.int64)
    parts: list = []
    single = lengths == 1
    parts.append((np.flatnonzero(single), v.byte_ids[data[starts[single]]][:, None], np.ones(int(single.sum()), np.int64)))
    edges = [2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32]
    while edges[-1] < lengths.max(initial=0):
        edges.append(edges[-1] * 2)
    low = 1
    for high in edges:
        which = np.flatnonzero((lengths > low) & (lengths <= high))
        low = high
        for some in np.array_split(which, max(1, len(which) * high // 2_000_000)):
            if not len(some):
                continue
            at = starts[some][:, None] + np.arange(high)
            inside = np.arange(high)[None, :] < lengths[some][:, None]
            rows = np.where(inside, v.byte_ids[data[np.minimum(at, len(data) - 1)]], NONE)
            _encode_matrix(v, rows, some, parts)
    for which, _, n in parts:
        counts[which] = n
    ends = np.cumsum(counts)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint16)
    begin = ends - counts
    for which, rows, n in parts:
        if not len(which):
            continue
        inside = np.arange(rows.shape[1])[None, :] < n[:, None]
        flat[(begin[which][:, None] + np.arange(rows.shape[1]))[inside]] = rows[inside]
    return flat, counts


def split_pieces(classes: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte positions where pieces start, for texts end to end in ``data`` that begin at ``bounds[:-1]``.

    The pattern: one of 's 't 're 've 'm 'll 'd, else an optional blank and a run of letters, of numbers, or of other
    signs, else white space, of which the last sign before something else is left to what follows.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[lead].astype(np.uint32)
    wide = np.flatnonzero(points >= 0x80)
    if len(wide):
        at, first = lead[wide], points[wide]
        tail = [(data[np.minimum(at + k, len(data) - 1)] & 0x3F).astype(np.uint32) for k in (1, 2, 3)]
        two, three = ((first & 0x1F) << 6) | tail[0], ((first & 0x0F) << 12) | (tail[0] << 6) | tail[1]
        four = ((first & 0x07) << 18) | (tail[0] << 12) | (tail[1] << 6) | tail[2]
        points[wide] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    kind = classes[points]
    n = len(points)
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(lead, bounds)] = True  # where a text begins; the end counts as one
    run = head.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run[:n].copy()
    # A run after white space of the same text takes a blank before it along; else the last white sign stands alone.
    after = np.flatnonzero(run[:n] & ~head[:n] & (np.concatenate([[OTHER], kind[:-1]]) == SPACE))
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    quote = np.flatnonzero(start & run[1:] & (points == 0x27))
    quote = quote[quote + 1 < n]
    quote = quote[~head[quote + 1] & (kind[quote + 1] == LETTER)]
    one, beyond = points[quote + 1], quote + 2 < n
    two = np.where(beyond, points[np.minimum(quote + 2, n - 1)], 0)
    two = np.where(beyond & ~head[np.minimum(quote + 2, n)], two, 0)
    short = np.isin(one, [ord(c) for c in "sdmt"])
    pair = ((one == ord("l")) & (two == ord("l"))) | (np.isin(one, [ord("v"), ord("r")]) & (two == ord("e")))
    for some, size in ((quote[short], 2), (quote[pair & ~short], 3)):
        start[some + 1] = False
        rest = some + size
        rest = rest[rest < n]
        start[rest] |= True
    return lead[start]


def _random_words(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _same_bytes(one: np.ndarray, at: np.ndarray, other: np.ndarray, to: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``one[at : at + size]`` equals ``other[to : to + size]``, for each."""
    if not len(sizes):
        return np.zeros(0, bool)
    before = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
    return np.logical_and.reduceat(one[np.repeat(at, sizes) + place] == other[np.repeat(to, sizes) + place], before)


class Encoder:
    """Encodes batches of texts; remembers the pieces it has met, with their bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        #: Hashes of the remembered pieces, the entry that each has, and of every entry: its ids, its bytes.
        self.index, self.entry = pd.Index(np.zeros(0, np.uint64)), none
        self.flat, self.counts, self.begin = np.zeros(0, np.uint16), none, none
        self.bytes, self.sizes, self.starts = np.zeros(0, np.uint8), none, none

    def pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and 64-bit hashes of the pieces of texts end to end: sums of pseudo-random numbers, one for each
        byte and its place in the piece."""
        starts = split_pieces(self.v.classes, data, bounds)
        ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
        lengths = ends - starts
        sums = np.zeros(len(data) + 1, np.uint64)
        place = np.arange(len(data)) - np.repeat(starts, lengths)
        np.cumsum(_mix(((place << 8) | data).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
        return starts, lengths, (sums[ends] - sums[starts]) ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def _learn(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Encode pieces as new entries; returns their numbers."""
        flat, counts = encode_pieces(self.v, data, starts, lengths)
        new = len(self.counts) + np.arange(len(counts))
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(counts) - counts])
        self.starts = np.concatenate([self.starts, len(self.bytes) + np.cumsum(lengths) - lengths])
        self.flat, self.counts, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts]), np.concatenate([self.sizes, lengths])
        self.bytes = np.concatenate([self.bytes, data[np.repeat(starts, lengths) + place]])
        return new

    def codes(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The entry of each piece; new ones are encoded first. A piece that has another one's hash, but not its bytes,
        gets an entry of its own."""
        local, distinct = pd.factorize(hashes)
        first = np.zeros(len(distinct), np.int64)
        first[local[::-1]] = np.arange(len(local))[::-1]
        at = self.index.get_indexer(distinct)
        fresh = np.flatnonzero(at < 0)
        if len(self.index) and (len(self.index) + len(fresh) > REMEMBER or len(self.bytes) > REMEMBER_BYTES):
            self._forget()
            at, fresh = np.full(len(distinct), -1), np.arange(len(distinct))
        entry = np.zeros(len(distinct), np.int64)
        known = np.flatnonzero(at >= 0)
        entry[known] = self.entry[at[known]]
        if len(fresh):
            entry[fresh] = self._learn(data, starts[first[fresh]], lengths[first[fresh]])
            self.index = pd.Index(np.concatenate([self.index.to_numpy(), distinct[fresh]]))
            self.entry = np.concatenate([self.entry, entry[fresh]])
        code = entry[local]
        same = self.sizes[code] == lengths
        same[same] = _same_bytes(data, starts[same], self.bytes, self.starts[code[same]], lengths[same])
        if not same.all():
            code[~same] = self._learn(data, starts[~same], lengths[~same])
        return code

    def encode(self, data: np.ndarray, bounds: np.ndarray, want_ids: bool = True) -> tuple[np.ndarray | None, np.ndarray, tuple]:
        """Token ids of all texts end to end (None unless wanted), how many each text has, and (first piece of each
        text, hashes of the pieces)."""
        starts, lengths, hashes = self.pieces(data, bounds)
        code = self.codes(data, starts, lengths, hashes)
        counts = self.counts[code]
        ends = np.concatenate([[0], np.cumsum(counts)])
        first = np.searchsorted(starts, bounds)
        sizes = np.diff(ends[first])
        ids = None
        if want_ids:
            ids = self.flat[np.repeat(self.begin[code] - ends[:-1], counts) + np.arange(ends[-1])].astype(np.int32)
        return ids, sizes, (first, hashes)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end and the bounds of its values; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def portions(batches, column: str):
    """Slices of record batches of about ``BATCH_BYTES`` of text each; a longer text comes alone, and whole."""
    for batch in batches:
        _, bounds = text_bytes(batch.column(column))
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + BATCH_BYTES, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def encode_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, without special tokens; what looks like one is ordinary text.
    A null or empty text gives an empty list. Rows come out as they go in, repeated ones too; other columns are not read."""
    shared = documents.sparkSession.sparkContext.broadcast(load(folder, name))

    def work(batches):
        encoder = Encoder(shared.value)
        for part in portions(batches, "text"):
            ids, sizes, _ = encoder.encode(*text_bytes(part.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "ids"])

    return documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text")).mapInArrow(work, "doc_id bigint, ids array<int>")
