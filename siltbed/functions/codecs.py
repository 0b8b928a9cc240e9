"""Compression of binary columns in Arrow batches; a codec is built once per task."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.functions.paths import is_dense

#: Most bytes that one piece, or one manifest, may have when decompressed.
CHUNK_LIMIT, MANIFEST_LIMIT = 128 << 20, 256 << 20
#: Smaller contents are not compressed.
COMPRESS_FROM = 64 << 10
ZSTD_MAGIC, ZLIB_FIRST, SNAPPY_MAGIC = b"\x28\xb5\x2f\xfd", 0x78, b"\xff\x06\x00\x00sNaPpY"


class Codec:
    name = "none"
    #: What a damaged stream raises beside ValueError.
    Error: type[Exception] = ValueError

    def __init__(self, level: int = 0, limit: int = CHUNK_LIMIT):
        self.level, self.limit = level, limit

    def compress(self, data: bytes) -> bytes:
        return data

    def decompress(self, data: bytes) -> bytes:
        return data

    def recognises(self, data: bytes) -> bool:
        return False


class Zstd(Codec):
    name = "zstd"

    def __init__(self, level: int = 3, limit: int = CHUNK_LIMIT):
        import zstandard

        super().__init__(level if 1 <= level <= 22 else 1, limit)
        self.Error = zstandard.ZstdError
        self._in, self._out = zstandard.ZstdCompressor(level=self.level), zstandard.ZstdDecompressor(max_window_size=1 << 27)

    def compress(self, data: bytes) -> bytes:
        return self._in.compress(data)

    def decompress(self, data: bytes) -> bytes:
        reader = self._out.stream_reader(data)
        out = reader.read(self.limit + 1)
        if len(out) > self.limit:
            raise ValueError("decompressed content exceeds the limit")
        return out

    def recognises(self, data: bytes) -> bool:
        return data[:4] == ZSTD_MAGIC


class Deflate(Codec):
    name = "deflate"

    def __init__(self, level: int = 9, limit: int = CHUNK_LIMIT):
        super().__init__(level if 1 <= level <= 9 else 9, limit)

    def compress(self, data: bytes) -> bytes:
        return zlib.compress(data, self.level)

    def decompress(self, data: bytes) -> bytes:
        engine = zlib.decompressobj()
        out = engine.decompress(data, self.limit + 1)
        if len(out) > self.limit:
            raise ValueError("decompressed content exceeds the limit")
        if not engine.eof:
            raise ValueError("truncated stream")
        return out

    def recognises(self, data: bytes) -> bool:
        return data[:1] == bytes([ZLIB_FIRST])


class Snappy(Codec):
    """Framed Snappy with uncompressed or compressed chunks of up to 64 KiB and masked CRC-32C."""

    name = "s2"

    def compress(self, data: bytes) -> bytes:
        import pyarrow as pa

        out = [SNAPPY_MAGIC]
        for start in range(0, len(data), 65536):
            piece = data[start : start + 65536]
            body = pa.compress(piece, codec="snappy", asbytes=True)
            out.append(b"\x00" + (len(body) + 4).to_bytes(3, "little") + _masked_crc(piece) + body)
        return b"".join(out)

    def decompress(self, data: bytes) -> bytes:
        import pyarrow as pa

        if data[:10] != SNAPPY_MAGIC:
            raise ValueError("no snappy frame")
        out, size, at = [], 0, 10
        while at < len(data):
            kind, length = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
            body = data[at + 4 : at + 4 + length]
            if len(body) < length:
                raise ValueError("truncated stream")
            at += 4 + length
            if kind in (0, 1):
                piece = pa.decompress(body[4:], decompressed_size=_varint(body[4:]), codec="snappy", asbytes=True) if kind == 0 else body[4:]
                size += len(piece)
                if size > self.limit:
                    raise ValueError("decompressed content exceeds the limit")
                if _masked_crc(piece) != body[:4]:
                    raise ValueError("checksum mismatch")
                out.append(piece)
            elif kind < 0x80:
                raise ValueError("unknown frame")
        return b"".join(out)

    def recognises(self, data: bytes) -> bool:
        return data[:10] == SNAPPY_MAGIC


def _varint(data: bytes) -> int:
    value = shift = 0
    for b in data:
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return value
    raise ValueError("truncated length")


_CRC: list[int] = []


def _masked_crc(data: bytes) -> bytes:
    if not _CRC:
        for i in range(256):
            for _ in range(8):
                i = (i >> 1) ^ (0x82F63B78 if i & 1 else 0)
            _CRC.append(i)
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc >> 8) ^ _CRC[(crc ^ b) & 0xFF]
    crc ^= 0xFFFFFFFF
    return ((((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF).to_bytes(4, "little")


def codec(name: str, level: int = 3, limit: int = CHUNK_LIMIT) -> Codec:
    """By name; an unknown one is zstd at level 3."""
    kinds = {"none": Codec, "deflate": Deflate, "s2": Snappy, "zstd": Zstd}
    return kinds[name](level, limit) if name in kinds else Zstd(3, limit)


def compressed(content: Column, name: str = "zstd", level: int = 1) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        engine = codec(name, level)
        for batch in batches:
            yield batch.map(lambda b: None if b is None else engine.compress(bytes(b)))

    return run(content.cast("binary"))


def decompressed(content: Column, name: str = "zstd", limit: int = CHUNK_LIMIT) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        engine = codec(name, limit=limit)
        for batch in batches:
            yield batch.map(lambda b: None if b is None else engine.decompress(bytes(b)))

    return run(content)


def compress_if_useful(files: DataFrame, path: str, content: str, least: int = COMPRESS_FROM, level: int = 1) -> DataFrame:
    """``files`` with stored (binary) and is_compressed: zstd for contents of at least ``least`` bytes whose name does
    not tell that they are dense, and only where it came out smaller. Only those rows reach Python."""
    data = F.col(content).cast("binary")
    worth = (F.octet_length(data) >= least) & ~is_dense(F.col(path))
    tried = files.withColumn("__try", compressed(F.when(worth, data), "zstd", level))
    smaller = F.coalesce(F.octet_length("__try") < F.octet_length(data), F.lit(False))
    return tried.withColumns({"stored": F.when(smaller, F.col("__try")).otherwise(data), "is_compressed": smaller}).drop("__try")
