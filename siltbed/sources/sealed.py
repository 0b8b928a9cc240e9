"""Sealed files of any size, opened piece by piece: a task reads frames off the file and hands on one piece at a time, the
JVM opens them, and the plaintext is written in order. No file ever fits, or has to fit, one row."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.functions import codecs
from siltbed.functions.frames import GB1, GB2, IV_BYTES, MOST_CHUNKS, TAG_BYTES, open_sealed
from siltbed.operators.chunking import CHUNK_BYTES

PIECES = pa.schema([("path", pa.string()), ("seq", pa.int32()), ("compressed", pa.bool_()), ("sealed", pa.binary())])


def _frames(file, piece: int):
    """(compressed, sealed) of each piece of an open file; malformed or cut-off files are errors."""

    def exactly(n: int) -> bytes:
        data = file.read(n)
        if len(data) < n:
            raise ValueError("the file ends within a piece")
        return data

    magic, most = file.read(4), piece + IV_BYTES + TAG_BYTES
    if magic == GB2:
        count = int.from_bytes(exactly(4), "big")
        if count >= MOST_CHUNKS:
            raise ValueError("too many pieces")
        for _ in range(count):
            size, flag = int.from_bytes(exactly(4), "big"), exactly(1)[0]
            if size > most + 1024:
                raise ValueError("a piece is too large")
            yield flag == 1, exactly(size)
        if file.read(1):
            raise ValueError("data after the last piece")
    elif magic == GB1:
        head = exactly(4)
        count = int.from_bytes(head, "big")
        if 0 < count < MOST_CHUNKS:
            for n in range(count):
                data = file.read(most) if n + 1 == count else exactly(most)
                yield False, data
            if file.read(1):
                raise ValueError("data after the last piece")
        else:
            data = head + file.read(most)
            if len(data) > most:
                raise ValueError("a piece is too large")
            yield False, data
    else:
        raise ValueError("no sealed file")


def sealed_pieces(files: DataFrame, piece: int = CHUNK_BYTES) -> DataFrame:
    """path, seq, compressed, sealed of the sealed files in ``files`` (path, abs_path), pieces of ``piece`` plaintext bytes.
    A small frame's nonce never reads as a count, for writers do not draw such ones."""

    def work(batches):
        for batch in batches:
            for path, place in zip(batch.column("path").to_pylist(), batch.column("abs_path").to_pylist()):
                with open(place, "rb") as f:
                    for seq, (flag, data) in enumerate(_frames(f, piece)):
                        yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((path, seq, flag, data), PIECES)], schema=PIECES)

    return files.select("path", "abs_path").mapInArrow(work, "path string, seq int, compressed boolean, sealed binary")


def opened_pieces(files: DataFrame, key: bytes, piece: int = CHUNK_BYTES) -> DataFrame:
    """path, seq, payload: the plaintext; a piece that does not open is an error. What a piece stands for is not checked
    against a hash here, a sealed file does not hold one."""
    plain = sealed_pieces(files, piece).withColumn("data", open_sealed(F.col("sealed"), F.lit(key)))
    failed = F.raise_error(F.concat(F.lit("piece "), F.col("seq").cast("string"), F.lit(" does not open: "), F.col("path")))
    plain = plain.withColumn("data", F.when(F.col("data").isNull(), failed).otherwise(F.col("data")))
    unpacked = codecs.decompressed(F.when(F.col("compressed"), F.col("data")))
    return plain.select("path", "seq", F.when(F.col("compressed"), unpacked).otherwise(F.col("data")).alias("payload"))
