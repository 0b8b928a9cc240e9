"""Passwords and key files: Argon2id in numpy (RFC 9106) and the binary and the older JSON key file."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct

import numpy as np

# Cost of the key derivation, and the head of a binary key file.
PASSES, MEMORY_KIB, LANES, KEY_BYTES = 3, 64 << 10, 4, 32
HEAD = b"GEK\x01"
SALT_BYTES, NONCE_BYTES = 32, 12


def _long_hash(data: bytes, size: int) -> bytes:
    if size <= 64:
        return hashlib.blake2b(struct.pack("<I", size) + data, digest_size=size).digest()
    block = hashlib.blake2b(struct.pack("<I", size) + data).digest()
    out = block[:32]
    while size - len(out) > 64:
        block = hashlib.blake2b(block).digest()
        out += block[:32]
    return out + hashlib.blake2b(block, digest_size=size - len(out)).digest()


_LOW = np.uint64(0xFFFFFFFF)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint64(n)) | (x << np.uint64(64 - n))


def _mix(a, b, c, d):
    for first, second in ((32, 24), (16, 63)):
        a = a + b + np.uint64(2) * (a & _LOW) * (b & _LOW)
        d = _turn(d ^ a, first)
        c = c + d + np.uint64(2) * (c & _LOW) * (d & _LOW)
        b = _turn(b ^ c, second)
    return a, b, c, d


def _rounds(v: np.ndarray) -> np.ndarray:
    """One permutation on arrays (..., 16)."""
    v = v.reshape(*v.shape[:-1], 4, 4)
    a, b, c, d = _mix(v[..., 0, :], v[..., 1, :], v[..., 2, :], v[..., 3, :])
    b, c, d = np.roll(b, -1, -1), np.roll(c, -2, -1), np.roll(d, -3, -1)
    a, b, c, d = _mix(a, b, c, d)
    b, c, d = np.roll(b, 1, -1), np.roll(c, 2, -1), np.roll(d, 3, -1)
    return np.stack([a, b, c, d], -2).reshape(*a.shape[:-1], 16)


def _compress(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Blocks (n, 128) of all lanes at once."""
    r = x ^ y
    q = _rounds(r.reshape(-1, 8, 16))
    q = q.reshape(-1, 8, 8, 2).transpose(0, 2, 1, 3).reshape(-1, 8, 16)
    q = _rounds(q).reshape(-1, 8, 8, 2).transpose(0, 2, 1, 3).reshape(-1, 128)
    return q ^ r


def argon2id(password: bytes, salt: bytes, passes: int = PASSES, memory_kib: int = MEMORY_KIB, lanes: int = LANES, size: int = KEY_BYTES, secret: bytes = b"", data: bytes = b"") -> bytes:
    """RFC 9106. The lanes of a slice do not depend on each other and are worked together."""
    pack = lambda *n: struct.pack(f"<{len(n)}I", *n)
    start = hashlib.blake2b(pack(lanes, size, memory_kib, passes, 0x13, 2) + b"".join(pack(len(x)) + x for x in (password, salt, secret, data))).digest()
    columns = memory_kib // (4 * lanes) * 4
    slice_ = columns // 4
    memory = np.zeros((lanes, columns, 128), np.uint64)
    for lane in range(lanes):
        for i in (0, 1):
            memory[lane, i] = np.frombuffer(_long_hash(start + pack(i, lane), 1024), np.uint64)
    every = np.arange(lanes)
    zero = np.zeros((lanes, 128), np.uint64)
    for turn in range(passes):
        for quarter in range(4):
            independent = turn == 0 and quarter < 2
            counter = zero.copy()
            counter[:, 0], counter[:, 1], counter[:, 2], counter[:, 3], counter[:, 4], counter[:, 5] = turn, every, quarter, lanes * columns, passes, 2
            addresses = None
            for at in range(slice_):
                if independent and (at % 128 == 0 or addresses is None):
                    counter[:, 6] += np.uint64(1)
                    addresses = _compress(zero, _compress(zero, counter))
                if turn == 0 and quarter == 0 and at < 2:
                    continue
                column = quarter * slice_ + at
                before = memory[every, (column - 1) % columns]
                pick = addresses[:, at % 128] if independent else before[:, 0]
                j1, j2 = pick & _LOW, pick >> np.uint64(32)
                lane = every if turn == 0 and quarter == 0 else (j2 % np.uint64(lanes)).astype(np.int64)
                same = lane == every
                done = quarter * slice_ if turn == 0 else columns - slice_
                area = np.where(same, done + at - 1, done - (1 if at == 0 else 0)).astype(np.uint64)
                x = (j1 * j1) >> np.uint64(32)
                relative = area - np.uint64(1) - ((area * x) >> np.uint64(32))
                first = 0 if turn == 0 or quarter == 3 else (quarter + 1) * slice_
                other = memory[lane, ((first + relative.astype(np.int64)) % columns)]
                fresh = _compress(before, other)
                memory[every, column] = fresh ^ memory[every, column] if turn else fresh
    return _long_hash(np.bitwise_xor.reduce(memory[:, -1], axis=0).tobytes(), size)


def key_from_password(password: str, salt: bytes) -> bytes:
    return argon2id(password.encode(), salt)


def encode_key_file(sealed: bytes, salt: bytes, nonce: bytes) -> bytes:
    """Head, salt, nonce, then the sealed master key with its tag."""
    if len(salt) != SALT_BYTES or len(nonce) != NONCE_BYTES:
        raise ValueError("a key file has a salt of 32 and a nonce of 12 bytes")
    return HEAD + salt + nonce + sealed


def decode_key_file(data: bytes) -> tuple[bytes, bytes, bytes]:
    """(salt, nonce, sealed) of a binary key file."""
    if data[:4] != HEAD or len(data) < 4 + SALT_BYTES + NONCE_BYTES + 16:
        raise ValueError("no key file")
    return data[4:36], data[36:48], data[48:]


def load_json_key(text: str) -> bytes:
    """The key of the older JSON file; a binary one is refused."""
    if text.startswith("GEK"):
        raise ValueError("this is a binary key file")
    key = base64.b64decode(json.loads(text)["key"], validate=True)
    if len(key) != KEY_BYTES:
        raise ValueError("the key must have 32 bytes")
    return key


def save_key_file(path: str, data: bytes) -> None:
    temp = f"{path}.{os.urandom(4).hex()}"
    fd = os.open(temp, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600)
    with os.fdopen(fd, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)
