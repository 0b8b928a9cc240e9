"""Commits of whole table sets in a folder: all or nothing, one after the other, whatever dies in between.

    <folder>/data/<random>/<table>      parquet, written first and never changed
    <folder>/commits/<number>.json      which data a commit consists of; created only where it does not exist yet

A run that dies before its commit file exists leaves data that nobody reads; one that dies later has committed. Of two
runs that want one number, one gets it and the other is told, and has to work from the new state. The folder must be on
a file system where a rename of a file onto an existing one fails (as on HDFS) or that has hard links (``file:``).
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


class Commits:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.folder = self._fs.makeQualified(path).toString().rstrip("/")
        local = urlparse(self.folder)
        self._local = unquote(local.path) if local.scheme == "file" else None

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def numbers(self) -> list[int]:
        root = self._path("commits")
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit() and n.endswith(".json"))

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"commits/{number}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The last commit's number and content; 0 and nothing before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def stage(self) -> str:
        """A fresh folder for the data of a commit."""
        return f"{self.folder}/data/{uuid.uuid4().hex}"

    def commit(self, number: int, content: dict) -> bool:
        """Make commit ``number``; False where another run has it already."""
        self._fs.mkdirs(self._path("commits"))
        body, temp = json.dumps(content).encode(), f"commits/.{uuid.uuid4().hex}.tmp"
        if self._local is not None:
            source, target = (os.path.join(self._local, n) for n in (temp, f"commits/{number}.json"))
            with open(source, "wb") as f:
                f.write(body)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(source, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(source)
        stream = self._fs.create(self._path(temp), False)
        stream.write(bytearray(body))
        stream.close()
        if self._fs.exists(self._path(f"commits/{number}.json")) or not self._fs.rename(self._path(temp), self._path(f"commits/{number}.json")):
            self._fs.delete(self._path(temp), False)
            return False
        return True

    def tables(self, paths: list[str], schema: str) -> DataFrame:
        """The parquet tables at ``paths`` as one; an empty table of ``schema`` where there are none."""
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def sweep(self) -> int:
        """Remove data that no commit refers to, when nothing else runs; returns how many folders went."""
        root, used = self._path("data"), json.dumps([self.read(n) for n in self.numbers()])
        gone = [s.getPath() for s in self._fs.listStatus(root) if s.getPath().getName() not in used] if self._fs.exists(root) else []
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)
