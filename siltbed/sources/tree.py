"""A directory tree as a table, by Spark's Python data source interface.

    spark.dataSource.register(TreeSource)
    spark.read.format("tree").option("excludes", "node_modules\n*.tmp\nsize:>1gb").option("content", "true").load(root)

The driver lists the upper ``levels`` of the tree (2 unless told otherwise); every subtree below them is a unit of work,
and units are dealt out to at most ``slices`` partitions, so that one large top-level directory spreads over the cluster.
Rows leave as Arrow batches. A directory that the excludes skip is never opened, on the driver or in a task.
"""

from __future__ import annotations

import os
import re
import stat
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

IGNORE_FILE = ".backupignore"
# How operating systems tell that a file is locked, and the waits before another attempt.
LOCK_ERRNO = (32, 33)
LOCK_PHRASES = ("being used by another process", "locked a portion of the file", "sharing violation")
RETRY_AFTER = (0.2, 0.5, 1.0)
#: A batch ends at so many rows or bytes of content.
BATCH_ROWS, BATCH_BYTES = 4096, 32 << 20

ROW = pa.schema(
    [("rel_path", pa.string()), ("abs_path", pa.string()), ("size", pa.int64()), ("mtime", pa.string()), ("mode", pa.int32()), ("is_dir", pa.bool_()), ("status", pa.string()), ("content", pa.binary())]
)


def is_lock_error(error: OSError) -> bool:
    return error.errno in LOCK_ERRNO or any(p in str(error).lower() for p in LOCK_PHRASES)


def open_with_retry(path: str, sleep=time.sleep):
    """The file opened for reading; a locked one is tried again."""
    for wait in (*RETRY_AFTER, None):
        try:
            return open(path, "rb")
        except OSError as e:
            if wait is None or not is_lock_error(e):
                raise
            sleep(wait)
    raise AssertionError("unreachable")


def read_with_retry(path: str, sleep=time.sleep) -> bytes:
    with open_with_retry(path, sleep) as f:
        return f.read()


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "rel_path string, abs_path string, size bigint, mtime string, mode int, is_dir boolean, status string, content binary"

    def reader(self, schema):
        return TreeReader(dict(self.options))


@dataclass
class Units(InputPartition):
    """Entries to emit alone, and directories to walk with all below them."""

    alone: list[str]
    walked: list[str]


class Rules:
    """The excludes, compiled by ``operators.predicates``."""

    def __init__(self, excludes: list[str]):
        from siltbed.operators import predicates as p

        positives, negatives, self.sizes = p.split_excludes(excludes)
        self.out, self.back, self.kept = (r and re.compile(r) for r in (p.exclusion_regex(positives), p.exclusion_regex(negatives), p.kept_regex(negatives)))
        self.compare = {">": int.__gt__, "<": int.__lt__, ">=": int.__ge__, "<=": int.__le__}

    def excludes(self, path: str) -> bool:
        return bool(self.out and self.out.search(path)) and not (self.back and self.back.search(path))

    def skips(self, folder: str) -> bool:
        return os.path.basename(folder) == IGNORE_FILE or (self.excludes(folder) and not (self.kept and self.kept.search(folder)))

    def too(self, size: int) -> bool:
        return any(self.compare[op](size, n) for op, n in self.sizes)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.content = options["path"], options.get("content", "false") == "true"
        self.excludes = [e for e in options.get("excludes", "").split("\n") if e]
        self.levels, self.slices = int(options.get("levels", 2)), int(options.get("slices", 1024))

    def _children(self, rules: Rules, folder: str) -> Iterator[tuple[str, bool]]:
        """(path below the root, is a directory) of what is not skipped; an unreadable directory has none."""
        try:
            found = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)
        except OSError:
            return
        for entry in found:
            rel = f"{folder}/{entry.name}" if folder else entry.name
            inner = entry.is_dir(follow_symlinks=False)
            if not inner or not rules.skips(rel):
                yield rel, inner

    def partitions(self):
        rules, alone, front = Rules(self.excludes), [], [""]
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        for _ in range(self.levels):
            inner = []
            for rel, is_dir in (child for folder in front for child in self._children(rules, folder)):
                alone.append(rel)
                if is_dir:
                    inner.append(rel)
            front = inner
        n = max(1, min(self.slices, len(front) + -(-len(alone) // BATCH_ROWS)))
        return [Units(alone[i::n], front[i::n]) for i in range(n)]

    def _row(self, rules: Rules, rel: str) -> tuple | None:
        full = os.path.join(self.root, rel)
        try:
            info = os.stat(full, follow_symlinks=False)
        except OSError:
            return None
        folder = stat.S_ISDIR(info.st_mode)
        if not folder and (not stat.S_ISREG(info.st_mode) or rules.excludes(rel) or rules.too(info.st_size)):
            return None
        status, data = None, None
        if self.content and not folder:
            try:
                data = read_with_retry(full)
            except OSError as e:
                status = "locked" if is_lock_error(e) else "error"
        when = datetime.fromtimestamp(int(info.st_mtime), timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        return rel, full, 0 if folder else info.st_size, when, stat.S_IMODE(info.st_mode) & 0o777, folder, status, data

    def _paths(self, rules: Rules, units: Units) -> Iterator[str]:
        yield from units.alone
        pending = list(units.walked)
        while pending:
            for rel, is_dir in self._children(rules, pending.pop()):
                yield rel
                if is_dir:
                    pending.append(rel)

    def read(self, partition):
        rules, rows, held = Rules(self.excludes), [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ROW)], schema=ROW)
        for rel in self._paths(rules, partition):
            row = self._row(rules, rel)
            if row is None:
                continue
            rows.append(row)
            held += len(row[-1] or b"")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()
