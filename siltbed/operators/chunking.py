"""Cutting contents into chunks: fixed sizes in Catalyst, content-defined borders in numpy over Arrow batches."""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
#: Content-defined chunks: least, average (a power of two) and most bytes.
CDC_LEAST, CDC_AVERAGE, CDC_MOST = 1 << 20, 1 << 22, 1 << 24
CDC_WINDOW = 48


def chunk_column(content: Column, size: int = CHUNK_BYTES) -> Column:
    """The pieces of a binary column; none for empty content."""
    data = content.cast("binary")
    length = F.octet_length(data)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(size)), lambda i: i < length)
    return F.transform(starts, lambda i: F.substring(data, i + 1, F.lit(size)))


def fixed_chunks(files: DataFrame, key: str, content: str, size: int = CHUNK_BYTES) -> DataFrame:
    """key, seq, chunk_offset, size, hash; a null content has no chunks."""
    pieces = files.select(key, F.posexplode(chunk_column(F.col(content), size)).alias("seq", "piece"))
    return pieces.select(key, "seq", (F.col("seq").cast("bigint") * size).alias("chunk_offset"), F.octet_length("piece").cast("bigint").alias("size"), F.sha2("piece", 256).alias("hash"))


def _tables(polynomial: int) -> np.ndarray:
    """For each place in the window and byte, its share of the fingerprint: byte * x**(8 * place) modulo the polynomial
    over GF(2). A fingerprint is the exclusive-or of the shares of its window."""
    degree = polynomial.bit_length() - 1

    def reduce(value: int) -> int:
        while value.bit_length() > degree:
            value ^= polynomial << (value.bit_length() - 1 - degree)
        return value

    return np.array([[reduce(byte << (8 * place)) for byte in range(256)] for place in range(CDC_WINDOW)], np.uint64)


def cut_points(data: bytes, tables: np.ndarray, least: int, average: int, most: int) -> list[int]:
    """Ends of the chunks of ``data``: the first place past ``least`` where the window's fingerprint has its low bits
    clear, at the latest ``most``. Fingerprints of all places come from ``CDC_WINDOW`` table look-ups on the whole array."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    marks = np.zeros(0, np.int64)
    if n > CDC_WINDOW:
        prints = np.zeros(n - CDC_WINDOW + 1, np.uint64)
        for place in range(CDC_WINDOW):
            prints ^= tables[place][raw[CDC_WINDOW - 1 - place : n - place]]
        marks = np.flatnonzero((prints & np.uint64(average - 1)) == 0) + CDC_WINDOW
    ends, start = [], 0
    while start < n:
        i = np.searchsorted(marks, start + least)
        end = min(start + most, n, int(marks[i]) if i < len(marks) else n)
        ends.append(end)
        start = end
    return ends


#: An irreducible polynomial of degree 53 over GF(2), as in Rabin's fingerprinting; a repository may bring its own.
POLYNOMIAL = 0x3DA3358B4DC173


def cdc_chunks(files: DataFrame, key: str, content: str, polynomial: int = POLYNOMIAL, least: int = CDC_LEAST, average: int = CDC_AVERAGE, most: int = CDC_MOST) -> DataFrame:
    """key, seq, chunk_offset, size, hash, file_hash with borders that depend on the content around them only."""
    kind = dict(files.dtypes)[key]
    tables = files.sparkSession.sparkContext.broadcast(_tables(polynomial))

    def work(batches):
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in (key, "seq", "chunk_offset", "size", "hash", "file_hash")}
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                if data is None:
                    continue
                whole, start = hashlib.sha256(data).hexdigest(), 0
                for seq, end in enumerate(cut_points(data, tables.value, least, average, most)):
                    for c, v in zip(rows, (k, seq, start, end - start, hashlib.sha256(data[start:end]).hexdigest(), whole)):
                        rows[c].append(v)
                    start = end
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(key, batch.schema.field(0).type), ("seq", pa.int32()), ("chunk_offset", pa.int64()), ("size", pa.int64()), ("hash", pa.string()), ("file_hash", pa.string())]))

    return files.select(key, F.col(content).cast("binary").alias("content")).mapInArrow(work, f"{key} {kind}, seq int, chunk_offset bigint, size bigint, hash string, file_hash string")


def route(size: Column, least: int = CHUNK_BYTES) -> Column:
    """Contents of at least ``least`` bytes are cut into chunks, the others are stored whole."""
    return F.when(size >= least, "chunked").when(size.isNotNull(), "whole")


def ordered_hash(chunks: DataFrame, key: str, seq: str, piece: str) -> DataFrame:
    """key, bytes, hash: the SHA-256 over all pieces of a key in their order, one after the other; no content is ever put
    together, so it may be of any size."""
    kind = dict(chunks.dtypes)[key]
    ordered = chunks.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(piece).cast("binary").alias("piece")).repartition("key").sortWithinPartitions("key", "seq")

    def work(batches):
        now, whole, size = None, None, 0
        for batch in batches:
            done = []
            for k, data in zip(batch.column("key").to_pylist(), batch.column("piece")):
                if whole is None or k != now:
                    if whole is not None:
                        done.append((now, size, whole.hexdigest()))
                    now, whole, size = k, hashlib.sha256(), 0
                whole.update(data.as_buffer() or b"")
                size += len(data.as_buffer() or b"")
            yield row(done, batch.schema.field(0).type)
            last = batch.schema.field(0).type
        if whole is not None:
            yield row([(now, size, whole.hexdigest())], last)

    def row(done, type_):
        columns = list(zip(*done)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], type_), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=[key, "bytes", "hash"])

    return ordered.mapInArrow(work, f"{key} {kind}, bytes bigint, hash string")


def is_irreducible(polynomial: int) -> bool:
    """Whether a polynomial of prime degree over GF(2) has no factors (M. Rabin, 1980): it has no root, and x to the power
    of 2**degree is x modulo it."""
    degree = polynomial.bit_length() - 1
    if not polynomial & 1 or polynomial.bit_count() % 2 == 0:
        return False
    power = 2
    for _ in range(degree):
        square = int(bin(power)[2:], 4)  # squaring over GF(2) puts zeros between the bits
        while square.bit_length() > degree:
            square ^= polynomial << (square.bit_length() - 1 - degree)
        power = square
    return power == 2


def random_polynomial(degree: int = 53) -> int:
    """An irreducible polynomial of a prime degree, drawn by the operating system's random numbers."""
    while True:
        drawn = (1 << degree) | secrets.randbits(degree) | 1
        if is_irreducible(drawn):
            return drawn


def reassemble(chunks: DataFrame, key: str, seq: str, piece: str) -> DataFrame:
    """key, content: the pieces in order. A file's pieces must fit one row, as a restored file's content must."""
    ordered = F.array_sort(F.collect_list(F.struct(seq, piece)))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda all_, c: F.concat(all_, c[piece]))
    return chunks.groupBy(key).agg(joined.alias("content"))
