"""Encrypted frames over Spark's own AES-GCM, whose output is nonce, ciphertext and tag.

Small: magic GB1, nonce, ciphertext, tag. Large: magic GB1, count, then one sealed piece after the other.
GB2: magic, count, then size, flag and sealed piece; flag 1 means the piece is compressed. Manifests: GKM1 and one piece.
The first bytes after a small frame's magic are random; those that could be read as a count are not used.
"""

from __future__ import annotations

import hashlib
import hmac
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltbed.functions.codecs import CHUNK_LIMIT, codec

# Fixed values of the format.
GB1, GB2, GKM1 = b"GB1\x00", b"GB2\x00", b"GKM1"
IV_BYTES, TAG_BYTES, MOST_CHUNKS = 12, 16, 100_000


def is_count(data: Column) -> Column:
    """Whether the first four bytes are a big-endian number from 1 to 99999."""
    return F.coalesce(F.conv(F.hex(F.substring(data, 1, 4)), 16, 10).cast("bigint").between(1, MOST_CHUNKS - 1), F.lit(False))


def random_iv(salt: Column, small: bool = False) -> Column:
    """Cryptographically random nonces, one per row; for small frames none that reads as a count."""

    @F.pandas_udf("binary")
    def draw(rows: pd.Series) -> pd.Series:
        def one(_):
            while True:
                iv = os.urandom(IV_BYTES)
                if not small or not 0 < int.from_bytes(iv[:4], "big") < MOST_CHUNKS:
                    return iv

        return rows.map(one)

    return draw.asNondeterministic()(salt)


def seal(plain: Column, key: Column, iv: Column) -> Column:
    return F.aes_encrypt(plain.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), iv)


def open_sealed(sealed: Column, key: Column) -> Column:
    """The plaintext, null where the key or the tag is wrong."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"))


def small_frame(plain: Column, key: Column, iv: Column) -> Column:
    return F.concat(F.lit(GB1), seal(plain, key, iv))


def large_frame(pieces: Column, ivs: Column, key: Column) -> Column:
    """``pieces`` and ``ivs``: arrays of one length; null from 100000 pieces on."""
    sealed = F.transform(F.arrays_zip(pieces.alias("p"), ivs.alias("i")), lambda x: F.aes_encrypt(x["p"], key, F.lit("GCM"), F.lit("DEFAULT"), x["i"]))
    body = F.aggregate(sealed, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    count = F.unhex(F.lpad(F.hex(F.size(pieces)), 8, "0"))
    return F.when(F.size(pieces) < MOST_CHUNKS, F.concat(F.lit(GB1), count, body))


def manifest_frame(plain: Column, key: Column, iv: Column) -> Column:
    return F.concat(F.lit(GKM1), seal(plain, key, iv))


def _cut_large(body: Column, piece: int) -> Column:
    """The sealed pieces of a large frame's body, all but the last of ``piece`` plaintext bytes."""
    step, length = piece + IV_BYTES + TAG_BYTES, F.octet_length(body)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(step)), lambda i: i < length)
    return F.transform(starts, lambda i: F.substring(body, i + 1, F.lit(step)))


def open_frame(frame: Column, key: Column, piece: int) -> Column:
    """Plaintext of a GB1 or manifest frame. A frame that reads as a large one is tried as such first, then as small;
    null where neither opens."""
    magic, rest = F.substring(frame, 1, 4), F.substring(frame, F.lit(5), F.octet_length(frame))
    body = F.substring(rest, F.lit(5), F.octet_length(rest))
    pieces = F.transform(_cut_large(body, piece), lambda p: F.try_aes_decrypt(p, key, F.lit("GCM"), F.lit("DEFAULT")))
    count = F.conv(F.hex(F.substring(rest, 1, 4)), 16, 10).cast("bigint")
    whole = (F.size(pieces) == count) & ~F.exists(pieces, lambda p: p.isNull())
    large = F.when(is_count(rest) & whole, F.aggregate(pieces, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p)))
    return F.when(magic == F.lit(GB1), F.coalesce(large, open_sealed(rest, key))).when(magic == F.lit(GKM1), open_sealed(rest, key))


def gb2_pieces(content: Column, piece: int, compress_from: int = 64 << 10) -> Column:
    """array<struct<flag, data>>: the pieces of a content, compressed where that makes them smaller."""

    @F.pandas_udf("array<struct<flag:int,data:binary>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        zstd = codec("zstd", 1)

        def one(data):
            if data is None:
                return None
            out = []
            for start in range(0, len(data), piece):
                part = bytes(data[start : start + piece])
                small = zstd.compress(part) if len(part) >= compress_from else part
                out.append({"flag": int(len(small) < len(part)), "data": small if len(small) < len(part) else part})
            return out

        for batch in batches:
            yield batch.map(one)

    return cut(content.cast("binary"))


def gb2_frame(pieces: Column, ivs: Column, key: Column) -> Column:
    sealed = F.transform(F.arrays_zip(pieces.alias("p"), ivs.alias("i")), lambda x: F.struct(x["p"]["flag"].alias("flag"), F.aes_encrypt(x["p"]["data"], key, F.lit("GCM"), F.lit("DEFAULT"), x["i"]).alias("s")))
    number = lambda n, digits: F.unhex(F.lpad(F.hex(n), digits, "0"))
    body = F.aggregate(sealed, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, number(F.octet_length(x["s"]), 8), number(x["flag"], 2), x["s"]))
    return F.when(F.size(pieces) < MOST_CHUNKS, F.concat(F.lit(GB2), number(F.size(pieces), 8), body))


def split_gb2(frame: Column, most: int = (4 << 20) + TAG_BYTES + 1024) -> Column:
    """array<struct<flag, sealed>> of a GB2 frame; null where it is malformed or a piece exceeds the limit."""

    @F.pandas_udf("array<struct<flag:int,sealed:binary>>")
    def cut(rows: pd.Series) -> pd.Series:
        def one(data):
            if data is None or bytes(data[:4]) != GB2 or len(data) < 8:
                return None
            count, at, out = int.from_bytes(data[4:8], "big"), 8, []
            if count >= MOST_CHUNKS:
                return None
            for _ in range(count):
                size = int.from_bytes(data[at : at + 4], "big")
                if size > most + IV_BYTES or at + 5 + size > len(data):
                    return None
                out.append({"flag": data[at + 4], "sealed": bytes(data[at + 5 : at + 5 + size])})
                at += 5 + size
            return out if at == len(data) else None

        return rows.map(one)

    return cut(frame)


def join_gb2(pieces: Column) -> Column:
    """The plaintext of opened pieces array<struct<flag, data>>; null where one did not open."""

    @F.pandas_udf("binary")
    def join(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        zstd = codec("zstd", limit=CHUNK_LIMIT)

        def one(parts):
            if parts is None or any(p["data"] is None for p in parts):
                return None
            return b"".join(zstd.decompress(bytes(p["data"])) if p["flag"] else bytes(p["data"]) for p in parts)

        for batch in batches:
            yield batch.map(one)

    return join(pieces)


def open_gb2(frame: Column, key: Column) -> Column:
    return join_gb2(F.transform(split_gb2(frame), lambda p: F.struct(p["flag"].alias("flag"), F.try_aes_decrypt(p["sealed"], key, F.lit("GCM"), F.lit("DEFAULT")).alias("data"))))


def open_any(content: Column, key: Column, piece: int) -> Column:
    """Plaintext of whatever frame ``content`` is; less than four bytes are no frame and pass as they are. Null for a frame
    that does not open and for content that is no frame at all."""
    magic = F.substring(content, 1, 4)
    second = open_gb2(F.when(magic == F.lit(GB2), content), key)
    return F.when(F.octet_length(content) < 4, content).when(magic == F.lit(GB2), second).otherwise(open_frame(content, key, piece))


def hkdf_sha256(master: bytes, purpose: bytes, length: int = 32) -> bytes:
    """RFC 5869 with the purpose as salt and no info."""
    key, out, block, n = hmac.new(purpose or b"\x00" * 32, master, hashlib.sha256).digest(), b"", b"", 1
    while len(out) < length:
        block = hmac.new(key, block + bytes([n]), hashlib.sha256).digest()
        out, n = out + block, n + 1
    return out[:length]


def derived_key(master: Column, purpose: Column) -> Column:
    @F.pandas_udf("binary")
    def derive(m: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else hkdf_sha256(bytes(a), b.encode()) for a, b in zip(m, p)])

    return derive(master, purpose)
