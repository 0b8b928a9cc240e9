"""Small files that appear whole or not at all, and survive a power cut once they are there."""

from __future__ import annotations

import os
import secrets


def sync_folder(folder: str) -> None:
    handle = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


def write_synced(path: str, data: bytes) -> str:
    """``data`` in a new, synced file beside ``path``; returns its name."""
    temp = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{secrets.token_hex(4)}.tmp")
    with open(temp, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    return temp


def write_atomic(path: str, data: bytes) -> None:
    """Create or replace ``path``."""
    os.replace(write_synced(path, data), path)
    sync_folder(os.path.dirname(path) or ".")


def create_atomic(path: str, data: bytes) -> bool:
    """Create ``path``; False where it exists, which another writer may have done a moment ago."""
    temp = write_synced(path, data)
    try:
        os.link(temp, path)
    except FileExistsError:
        return False
    finally:
        os.unlink(temp)
    sync_folder(os.path.dirname(path) or ".")
    return True
