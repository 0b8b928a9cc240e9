import base64
import json
import os

import pytest

from siltbed.functions import keys
from siltbed.operators import chunking
from siltbed.sources import repository as repo


def test_argon2id_vector():
    # RFC 9106, section 5.3
    tag = keys.argon2id(b"\x01" * 32, b"\x02" * 16, 3, 32, 4, 32, b"\x03" * 8, b"\x04" * 12)
    assert tag.hex() == "0d640df58d78766c08c037a34a8b53c9d01ef0452d75b65eb52520e96b01e659"


def test_layout_and_configuration(tmp_path):
    root = str(tmp_path)
    assert repo.detect(root) == "unknown"
    repo.init(root, chunkSize=77)
    with pytest.raises(FileExistsError):
        repo.init(root)
    assert repo.detect(root) == "blocks" and repo.load_config(root)["chunkSize"] == 77
    own = repo.polynomial(root)
    assert own == repo.polynomial(root) == repo.load_config(root)["cdcPolynomial"] and own.bit_length() == 54 and chunking.is_irreducible(own)
    repo.save_config(root, {"format": "else"})
    assert repo.detect(root) == "other"
    (tmp_path / "manifests/x").write_text("")
    assert repo.detect(root) == "blocks"
    assert [repo.uses_cdc({"cdc": True}, o) for o in (None, "0", "1", "x")] == [True, False, True, True]


def test_master_key(spark, tmp_path):
    root, cheap = str(tmp_path), {"passes": 1, "memory_kib": 64}
    repo.init(root)
    master = repo.create_key(spark, root, "secret", **cheap)
    assert repo.unlock(spark, root, "secret", **cheap) == master and len(master) == 32
    path = tmp_path / "keys/master.key"
    assert path.read_bytes()[:4] == b"GEK\x01" and len(path.read_bytes()) == 4 + 32 + 12 + 48 and os.stat(path).st_mode & 0o777 == 0o600
    with pytest.raises(PermissionError):
        repo.unlock(spark, root, "wrong", **cheap)
    with pytest.raises(ValueError):
        keys.decode_key_file(b"GEK1" + bytes(100))


def test_json_key():
    key = os.urandom(32)
    text = json.dumps({"key": base64.b64encode(key).decode()})
    assert keys.load_json_key(text) == key
    for bad in ("GEK\x01...", json.dumps({"key": base64.b64encode(b"short").decode()})):
        with pytest.raises(ValueError):
            keys.load_json_key(bad)


def test_irreducible_polynomials():
    assert chunking.is_irreducible(chunking.POLYNOMIAL) and chunking.is_irreducible(0b111) and chunking.is_irreducible(0b1011)
    assert not any(chunking.is_irreducible(p) for p in (0b110, 0b1111, 0b1001, chunking.POLYNOMIAL ^ 2))
    assert len({chunking.random_polynomial() for _ in range(3)}) == 3
