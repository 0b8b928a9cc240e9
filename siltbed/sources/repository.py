"""A repository's small files: configuration, layout, format detection, and the master key sealed by a password."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltbed.functions import frames, keys
from siltbed.operators.chunking import CHUNK_BYTES, random_polynomial
from siltbed.sources.files import write_atomic

#: Names that mark the block format in a configuration; other writers' names can be given to detect().
FORMATS = ("blocks",)
DEFAULTS = {"format": "blocks", "version": 2, "chunkSize": CHUNK_BYTES, "compression": "zstd", "encrypted": False, "cdcPolynomial": 0}


def config_path(root: str) -> Path:
    return Path(root) / "config.json"


def save_config(root: str, config: dict) -> None:
    write_atomic(str(config_path(root)), json.dumps(config, indent=2).encode())


def load_config(root: str) -> dict:
    """The configuration; keys it lacks have their defaults."""
    return DEFAULTS | json.loads(config_path(root).read_text())


def init(root: str, **settings) -> dict:
    """Create the layout; a second time is an error."""
    if config_path(root).exists():
        raise FileExistsError(f"{root} is a repository already")
    for folder in ("blobs", "manifests", "trash", "keys"):
        (Path(root) / folder).mkdir(parents=True, exist_ok=True)
    config = DEFAULTS | settings
    save_config(root, config)
    return config


def detect(root: str, formats: tuple[str, ...] = FORMATS) -> str:
    """'blocks' where the configuration names the format or there are manifests, 'unknown' without a configuration."""
    if not config_path(root).exists():
        return "unknown"
    manifests = Path(root) / "manifests"
    return "blocks" if load_config(root).get("format") in formats or (manifests.is_dir() and any(manifests.iterdir())) else "other"


def polynomial(root: str) -> int:
    """The repository's own polynomial for content-defined chunks; one without gets a random irreducible one, which is
    kept, so that borders tell nothing about contents to who does not know it."""
    config = load_config(root)
    if not config["cdcPolynomial"]:
        config["cdcPolynomial"] = random_polynomial()
        save_config(root, config)
    return config["cdcPolynomial"]


def uses_cdc(config: dict, override: str | None = None) -> bool:
    """'0' and '1' override the configuration."""
    return override == "1" if override in ("0", "1") else bool(config.get("cdc"))


def create_key(spark: SparkSession, root: str, password: str, **cost) -> bytes:
    """Make a random master key, seal it with one derived from the password, write the key file, return the key."""
    master, salt, nonce = os.urandom(32), os.urandom(keys.SALT_BYTES), os.urandom(keys.NONCE_BYTES)
    wrapping = keys.argon2id(password.encode(), salt, **cost)
    sealed = spark.range(1).select(frames.seal(F.lit(master), F.lit(wrapping), F.lit(nonce))).first()[0]
    keys.save_key_file(str(Path(root) / "keys" / "master.key"), keys.encode_key_file(bytes(sealed)[keys.NONCE_BYTES :], salt, nonce))
    return master


def unlock(spark: SparkSession, root: str, password: str, **cost) -> bytes:
    """The master key; a wrong password is an error."""
    salt, nonce, sealed = keys.decode_key_file((Path(root) / "keys" / "master.key").read_bytes())
    wrapping = keys.argon2id(password.encode(), salt, **cost)
    master = spark.range(1).select(frames.open_sealed(F.lit(nonce + sealed), F.lit(wrapping))).first()[0]
    if master is None:
        raise PermissionError("the password does not open this key file")
    return bytes(master)
