"""Words of texts for content scoring: spelling tricks undone, in numpy over whole batches.

Zero-width characters, soft hyphens and combining marks vanish; letters are folded to lower case without accents and
look-alikes of other scripts to Latin; digits and signs inside a word stand for the letters they resemble; letters set
apart one by one are joined; repeated letters count once; names are cut at underscores and at humps.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd

from siltbed.llm.bpe import _random_words

SEPARATOR, DELETED, LINE, DIGIT, SIGN = 0, 1, 2, 3, 4
#: Letters that digits and signs stand for.
STAND_FOR = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "*": "*", "|": "l", "€": "e"}
#: Letters of other scripts that look like Latin ones.
LOOK_ALIKE = dict(zip("аеорсухіјѕкмтвнԁɡӏαοντυρικηı", "aeopcyxijskmtbhdglaovtupikni"))
#: Words per window, and how far the next window of a line begins.
WIDTH, STRIDE = 16, 8
#: A word of more letters, as in scripts without blanks, is cut into overlapping pieces of PIECE letters every PIECE_STEP.
LONGEST_WORD, PIECE, PIECE_STEP = 40, 20, 10


@functools.lru_cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its kind or folded letter (from 32 on), what a digit or sign stands for, 1 for upper and
    2 for lower case."""
    kind, stands, case = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    for point in [*range(0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x20000)]:
        c = chr(point)
        category = unicodedata.category(c)
        if c in "\n\r  \u0085":
            kind[point] = LINE
        elif category in ("Mn", "Me", "Cf"):
            kind[point] = DELETED
        elif category[0] == "L" or 0x1F130 <= point <= 0x1F189:
            case[point] = 1 if category == "Lu" else 2
            folded = unicodedata.normalize("NFKD", c).casefold()[:1] or c
            folded = LOOK_ALIKE.get(folded, folded)
            kind[point] = ord(folded) if "a" <= folded <= "z" else 128 + ord(folded) % 127
        elif category == "Nd":
            kind[point] = DIGIT
            stands[point] = ord(STAND_FOR[str(unicodedata.digit(c))])
    kind[0x3400:0xA000] = 128 + np.arange(0x3400, 0xA000) % 127
    for sign, letter in STAND_FOR.items():
        if not sign.isdigit():
            kind[ord(sign)], stands[ord(sign)] = SIGN, ord(letter)
    return kind, stands, case


def code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the bounds of the texts among them."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[lead].astype(np.uint32)
    wide = np.flatnonzero(points >= 0x80)
    if len(wide):
        at, first = lead[wide], points[wide]
        tail = [(data[np.minimum(at + k, len(data) - 1)] & 0x3F).astype(np.uint32) for k in (1, 2, 3)]
        two, three = ((first & 0x1F) << 6) | tail[0], ((first & 0x0F) << 12) | (tail[0] << 6) | tail[1]
        four = ((first & 0x07) << 18) | (tail[0] << 12) | (tail[1] << 6) | tail[2]
        points[wide] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    return points, np.searchsorted(lead, bounds)


class Words:
    """The words of a batch: letters end to end, start and length of each, its line (numbered through the batch) and text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        kinds, stand, cases = tables()
        points, ends = code_points(data, bounds)
        n = len(points)
        kind = kinds[points]
        keep = kind != DELETED
        if not keep.all():
            before = np.concatenate([[0], np.cumsum(keep)])
            points, kind, ends = points[keep], kind[keep], before[ends]
            n = len(points)
        edge = np.zeros(n + 2, bool)
        edge[ends] = True  # a text begins here
        line_start = edge[:n].copy()
        line_start[1:] |= (kind == LINE)[:-1]
        letter = kind >= 32
        solid = letter | (kind == DIGIT)
        star = points == 0x2A
        sides = lambda mask: np.concatenate([[False], mask[:-1]]) & np.concatenate([mask[1:], [False]]) & ~edge[:n] & ~edge[1 : n + 1]
        word = solid | ((kind == SIGN) & np.where(star, sides(letter | star), sides(solid | star)))
        case = cases[points]
        hump = np.zeros(n, bool)
        if n > 3:
            hump[1:-2] = (case[1:-2] == 1) & (case[:-3] != 0) & (case[2:-1] == 2) & (case[3:] == 2) & ~edge[2 : n - 1] & ~edge[3:n]
        begin = word & (np.concatenate([[True], ~word[:-1]]) | edge[:n] | hump)
        starts = np.flatnonzero(begin)
        stop = word & (np.concatenate([~word[1:], [True]]) | np.concatenate([begin[1:], [True]]) | edge[1 : n + 1])
        stops = np.flatnonzero(stop) + 1
        letters = np.where(letter, kind, np.where(word, stand[points], 0)).astype(np.uint8)
        count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        lettered, digits = count(letter), count(kind == DIGIT)
        has = lettered[stops] - lettered[starts]
        some = has > 0
        starts, stops, has = starts[some], stops[some], has[some]
        # Digits that only end a name number it.
        last = np.maximum.accumulate(np.where(letter, np.arange(n), -1)) if n else np.zeros(0, np.int64)
        bare = last[stops - 1] + 1
        total = digits[stops] - digits[starts]
        strip = (digits[stops] - digits[bare] == total) & (stops - bare == total) & ((total >= 2) | (has <= 3))
        stops = np.where(strip, bare, stops)
        line = np.cumsum(line_start)
        # Single letters set apart by one sign each are one word.
        single = stops - starts == 1
        near = np.zeros(len(starts) + 1, bool)
        near[1:-1] = single[1:] & single[:-1] & (starts[1:] - stops[:-1] == 1) & (line[starts[1:]] == line[starts[:-1]])
        # Another sign between ends the word: t-h-e-y r u n.
        apart = points[np.minimum(stops[:-1], max(n - 1, 0))]
        near[2:-1] &= ~(near[1:-2] & (apart[1:] != apart[:-1]))
        joined = near[:-1].copy()
        long_run = near[:-1] & (near[1:] | np.concatenate([[False], near[:-2]]))
        joined = joined & (long_run | np.concatenate([long_run[1:], [False]]) | np.concatenate([[False], long_run[:-1]]))
        first = np.flatnonzero(~joined)
        size = stops - starts
        # Letters of the words end to end, repeated ones once.
        owner = np.repeat(np.cumsum(~joined) - 1, size)
        at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        chars = letters[at]
        fresh = np.ones(len(chars), bool)
        fresh[1:] = (chars[1:] != chars[:-1]) | (owner[1:] != owner[:-1])
        chars, owner = chars[fresh], owner[fresh]
        sizes = np.bincount(owner, minlength=len(first)).astype(np.int64)
        # Single letters and hexadecimal numbers are no words.
        begins = starts[first]
        after = points[np.minimum(begins + 1, max(n - 1, 0))]
        words = (sizes > 1) & ~((points[begins] == 0x30) & ((after == 0x78) | (after == 0x58)))
        self.letters, first, self.sizes = chars[words[owner]], first[words], sizes[words]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.line = line[starts[first]]
        self.text = np.searchsorted(ends, starts[first], side="right") - 1
        if (self.sizes > LONGEST_WORD).any():
            self._cut()
        self.texts = len(bounds) - 1

    def _cut(self) -> None:
        many = np.where(self.sizes > LONGEST_WORD, -(-(self.sizes - PIECE) // PIECE_STEP) + 1, 1)
        of = np.repeat(np.arange(len(many)), many)
        skip = (np.arange(len(of)) - (np.cumsum(many) - many)[of]) * PIECE_STEP
        self.sizes = np.where(many[of] > 1, np.minimum(PIECE, self.sizes[of] - skip), self.sizes[of])
        self.starts, self.line, self.text = self.starts[of] + skip, self.line[of], self.text[of]

    def hashes(self) -> np.ndarray:
        return word_hashes(self.letters, self.starts, self.sizes)

    def strings(self, index: np.ndarray) -> list[str]:
        raw = self.letters.tobytes()
        return [raw[s : s + n].decode("latin-1") for s, n in zip(self.starts[index].tolist(), self.sizes[index].tolist())]


_WORDS = _random_words(256, 5)
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _CACHE
    if len(_CACHE[0]) < n:
        made = []
        for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
            column = np.full(n, np.uint64(factor), np.uint64)
            column[:1] = 1
            made.append(np.cumprod(column, dtype=np.uint64))
        _CACHE = tuple(made)
    return _CACHE


_CACHE: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def run_hashes(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of 64-bit values."""
    forth, back = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * forth[: len(values)], out=sums[1:])
    return ((sums[starts + sizes] - sums[starts]) * back[starts]) ^ (sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return run_hashes(_WORDS[letters], starts, sizes)


def hash_strings(words: list[str]) -> np.ndarray:
    """The hashes of words given as strings, as :meth:`Words.hashes` gives them."""
    raw = [w.encode("latin-1") for w in words]
    sizes = np.array([len(r) for r in raw], np.int64)
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)


def windows(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each window, for words with the given line numbers: a line of up to WIDTH
    words is one window, a longer one has overlapping windows of WIDTH words every STRIDE words, to its end."""
    if not len(lines):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], lines[1:] != lines[:-1]]))
    size = np.diff(np.concatenate([first, [len(lines)]]))
    many = np.maximum(1, -(-(size - WIDTH) // STRIDE) + 1)
    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    start = np.repeat(first, many) + nth * STRIDE
    return start, np.minimum(WIDTH, np.repeat(first + size, many) - start)


def factorize(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pd.factorize(values)
