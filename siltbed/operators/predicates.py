"""Ignore patterns and size filters. A list of patterns is compiled once to a single regular expression that Java's and
Python's engines read alike, so that columns (one ``rlike`` in Catalyst) and a directory walk share one meaning.

Patterns: without a glob a pattern names a file or a whole directory at any depth; with ``*``, ``?`` or ``[`` it is
matched against the base name, else the full path, and its stars never cross a slash; ``**`` spans directories.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltbed.functions.paths import ancestors

#: Nothing may follow: the one spelling of a strict end that both engines know.
_END = r"(?![\s\S])"
_NEVER = "(?!)"
_TOKEN = re.compile(r"\*+|\?|\\[\s\S]|\[|[^*?\\\[]+")
_ITEM = re.compile(r"(\\[\s\S]|[^\\\]-])(?:-(\\[\s\S]|[^\\\]-]))?")


def _class(body: str, negated: bool) -> str | None:
    """A character class of single characters and ranges; None for a malformed one. A range from high to low is empty."""
    sets, at = [], 0
    while at < len(body):
        item = _ITEM.match(body, at)
        if item is None:
            return None
        low, high = (c and c[-1] for c in item.groups())
        if high is None or low <= high:
            sets.append(re.escape(low) + (f"-{re.escape(high)}" if high else ""))
        at = item.end()
    if not body:
        return None
    if not sets:
        return r"[\s\S]" if negated else _NEVER
    return f"[{'^' * negated}{''.join(sets)}]"


def _glob_body(glob: str) -> str | None:
    """A glob as an expression for a whole name or path; None for a malformed one, which never matches."""
    out, at = [], 0
    while at < len(glob):
        token = _TOKEN.match(glob, at)
        if token is None:  # a backslash at the end
            return None
        text, at = token.group(), token.end()
        if text == "[":
            negated = glob.startswith("^", at)
            close = re.compile(r"(?:\\[\s\S]|[^\\\]])*").match(glob, at + negated).end()
            made = _class(glob[at + negated : close], negated) if close < len(glob) else None
            if made is None:
                return None
            out.append(made)
            at = close + 1
        else:
            out.append("[^/]*" if text[0] == "*" else "[^/]" if text == "?" else re.escape(text[-1] if text[0] == "\\" else text))
    return "".join(out)


def _is_glob(pattern: str) -> bool:
    return bool(set("*?[") & set(pattern))


def _named(name: str) -> str:
    """The file or directory of that name at any depth, with all below it."""
    return f"(?:.*/)?{re.escape(name)}(?:/.*)?"


def _globbed(pattern: str) -> str:
    body = _glob_body(pattern)
    if body is None:
        return _NEVER
    return f"(?:.*/)?{body}" if not set("/[") & set(pattern) else f"(?:(?:.*/)?(?=[^/]*{_END}){body}|{body})"


def _body(pattern: str) -> str:
    if "**" not in pattern:
        return _globbed(pattern) if _is_glob(pattern) else _named(pattern.removesuffix("/"))
    if pattern == "**":
        return ".*"
    if pattern.startswith("**/"):
        return f"(?:.*/)?(?:{_body(pattern[3:])})"
    if pattern.endswith("/**"):
        head = re.escape(pattern[:-3])
        return f"(?:{head}|(?:.*/)?{head}/.*)"
    head, span, rest = pattern.partition("/**/")
    # After a slash the head counts as text: it may begin a longer name.
    return f"(?:{re.escape(head)}|.*/{re.escape(head)}.*)/(?=.)(?:{_body(rest)})" if span else _globbed(pattern)


def _whole(bodies: Iterable[str]) -> str | None:
    kept = [b for b in bodies if b != _NEVER]
    return f"(?s)^(?:{'|'.join(f'(?:{b})' for b in kept)}){_END}" if kept else None


def exclusion_regex(patterns: Iterable[str], ignore_case: bool = False) -> str | None:
    """One expression for paths that any of the patterns matches; None if none can."""
    return _whole(_body(p.lower() if ignore_case else p) for p in dict.fromkeys(patterns))


def _matches(path: Column, regex: str | None) -> Column:
    return path.rlike(regex) if regex else F.lit(False)


def match_pattern(path: Column, pattern: str) -> Column:
    return _matches(path, exclusion_regex([pattern]))


def _any(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def is_excluded(path: Column, positives: list[str], negatives: list[str] = (), ignore_case: bool = False) -> Column:
    """Two expressions in all, however many patterns there are. A null path stays null unless nothing can match."""
    path = F.lower(path) if ignore_case else path
    return _matches(path, exclusion_regex(positives, ignore_case)) & ~_matches(path, exclusion_regex(negatives, ignore_case))


def kept_regex(negatives: list[str]) -> str | None:
    """Directories that a negative pattern names, or that lie below one, are never skipped as a whole."""
    return _whole(f"{re.escape(n)}(?:/.*)?" for n in negatives)


def skips_directory(folder: Column, positives: list[str], negatives: list[str] = ()) -> Column:
    """Whether a scan leaves out the whole directory."""
    return is_excluded(folder, positives, negatives) & ~_matches(folder, kept_regex(list(negatives)))


def under_skipped(path: Column, positives: list[str], negatives: list[str] = ()) -> Column:
    """Whether any proper ancestor directory of a file is left out."""
    return F.exists(F.filter(ancestors(path), lambda a: a != ""), lambda a: skips_directory(a, positives, negatives))


SIZE_UNITS = {"gb": 1 << 30, "mb": 1 << 20, "kb": 1 << 10, "b": 1, "": 1}


def parse_size_filter(text: str) -> tuple[str, int] | None:
    """('>=', bytes) of 'size:>=10MB', None where it is none. The prefix is case-sensitive, the unit is not."""
    m = re.fullmatch(r"size:\s*(>=|<=|>|<)\s*([+-]?\d+)\s*(gb|mb|kb|b)?\s*", text, re.IGNORECASE) if text.startswith("size:") else None
    return (m[1], int(m[2]) * SIZE_UNITS[(m[3] or "").lower()]) if m else None


def size_excluded(size: Column, filters: Iterable[tuple[str, int]]) -> Column:
    compare = {">": size.__gt__, "<": size.__lt__, ">=": size.__ge__, "<=": size.__le__}
    return _any(compare[op](n) for op, n in filters)


def merge_excludes(one: Iterable[str], other: Iterable[str]) -> list[str]:
    return list(dict.fromkeys([*one, *other]))


def split_excludes(patterns: Iterable[str]) -> tuple[list[str], list[str], list[tuple[str, int]]]:
    """Positive patterns, negative ones (after one '!'), and size filters; an invalid filter is a positive pattern."""
    positives, negatives, sizes = [], [], []
    for p in patterns:
        if p.startswith("!"):
            negatives.append(p[1:])
        elif found := parse_size_filter(p):
            sizes.append(found)
        else:
            positives.append(p)
    return positives, negatives, sizes


def merge_excludes_column(one: Column, other: Column) -> Column:
    return F.array_distinct(F.concat(one, other))


def parse_ignore_lines(lines: Iterable[str]) -> list[str]:
    stripped = (line.strip() for line in lines)
    return [line for line in stripped if line and not line.startswith("#")]


def _loose(pattern: str) -> Iterable[str]:
    yield f"{re.escape(pattern)}.*"
    if pattern.startswith("**/"):
        yield _named(pattern[3:]).removesuffix("(?:/.*)?")
        yield f".*/{re.escape(pattern[3:])}/.*"
    if pattern.endswith("/**"):
        yield f"{re.escape(pattern[:-3])}(?:/.*)?"
    head, span, tail = pattern.partition("**")
    if span:
        yield f"(?={re.escape(head)}).*(?<={re.escape(tail)})"
    yield _globbed(pattern)


def match_exclude(path: Column, patterns: Iterable[str]) -> Column:
    """The older, looser matcher: any raw prefix, '**/x' and 'x/**', 'a**b' as prefix and suffix, and globs."""
    return _matches(path, _whole(body for p in patterns for body in _loose(p)))
