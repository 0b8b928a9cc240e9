"""Has this key been seen before? Sorted hash partitions of all earlier keys in Elias-Fano form.

Keys are 64 lower-case hex digits. A partition holds the keys that share the leading hex digits; within it the
following bits are a fingerprint. The sorted fingerprints are Elias-Fano coded; the bytes of each key that neither the
partition nor the code tells lie beside them in the same order, for the exact check. A probe is
a successor search; a hit on the fingerprint alone may be wrong, with the probability that ``wrong_rate`` measures.

The number of leading digits and the bits of the fingerprint are kept with each partition; a store that outgrows them is
split anew from its own code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.commits import Commits
from siltbed.llm.elias_fano import EliasFano
from siltbed.session import scratch_path

VALID = "^[0-9a-f]{64}$"
#: Bits of the fingerprint, partition digits included.
FINGERPRINT_BITS = 56
#: Keys wanted in a partition; the number of leading hex digits follows from it.
PARTITION_KEYS = 250_000
#: New keys of a partition that are merged at a time.
BATCH_KEYS = 1 << 16
#: Turns in which the rows of a query's batch are taken, by equal spans of their order.
TURNS = 16

STORE = "part string, digits int, bits int, n bigint, low_bits int, highs binary, lows binary, rest binary"
ANSWERS = "key binary, turn bigint, first_put bigint, puts bigint, in_store boolean, repeated boolean, by_fingerprint boolean, by_earlier boolean"


def valid(keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is 64 lower-case hex digits; null and malformed keys are never seen."""
    return keys.where(F.col(key).rlike(VALID))


def partition_digits(keys: int) -> int:
    return next(k for k in range(2, 9) if keys <= PARTITION_KEYS * 16**k or k == 8)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """An (n, 32) byte matrix of a binary column of 32-byte values."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.binary())
    if not len(array):
        return np.zeros((0, 32), np.uint8)
    data = np.frombuffer(array.buffers()[2], np.uint8)
    first = np.frombuffer(array.buffers()[1], np.int64 if pa.types.is_large_binary(array.type) else np.int32)[array.offset]
    return data[first : first + 32 * len(array)].reshape(-1, 32)


def _fingerprints(keys: np.ndarray, digits: int, bits: int) -> np.ndarray:
    head = keys[:, :8].copy().view(">u8")[:, 0].astype(np.uint64)
    return (head >> np.uint64(64 - bits)) & np.uint64((1 << (bits - 4 * digits)) - 1)


def _sorted(keys: np.ndarray) -> np.ndarray:
    """Rows in byte order, each once."""
    if not len(keys):
        return keys
    order = np.lexsort(keys.copy().view(">u8").T[::-1])
    keys = keys[order]
    return keys[np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])]


def _coded(part: str, rows: np.ndarray, digits: int, bits: int) -> pa.Table:
    """One row of a store: sorted keys as code and the bytes that it lacks."""
    coded = EliasFano.encode(_fingerprints(rows, digits, bits), bits - 4 * digits)
    rest = np.ascontiguousarray(rows[:, bits // 8 :])
    return pa.table({
        "part": [part], "digits": pa.array([digits], pa.int32()), "bits": pa.array([bits], pa.int32()), "n": [coded.n],
        "low_bits": pa.array([coded.low_bits], pa.int32()), "highs": [coded.highs.tobytes()], "lows": [coded.lows.tobytes()], "rest": [rest.tobytes()],
    })


def _decoded(table: pa.Table) -> tuple[EliasFano, np.ndarray]:
    """The code of a store's row, and the bytes beside it."""
    row = {c: table.column(c)[0].as_py() for c in ("n", "low_bits", "highs", "lows", "rest", "bits")}
    return EliasFano(row["n"], row["low_bits"], row["highs"], row["lows"]), np.frombuffer(row["rest"], np.uint8).reshape(-1, 32 - row["bits"] // 8)


def _keys(table: pa.Table) -> np.ndarray:
    """The whole keys of a store's row: the partition, the decoded fingerprint, the rest."""
    if not table.num_rows:
        return np.zeros((0, 32), np.uint8)
    coded, rest = _decoded(table)
    part, digits, bits = (table.column(c)[0].as_py() for c in ("part", "digits", "bits"))
    head = (np.uint64(int(part, 16) << (64 - 4 * digits)) | (coded.decode() << np.uint64(64 - bits))).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([head[:, : bits // 8], rest], axis=1)


def _hashed_keys(keys: DataFrame, key: str) -> DataFrame:
    return valid(keys, key).select(F.unhex(key).alias("key")).distinct()


def _in_parts(keys: DataFrame, digits: int) -> DataFrame:
    return keys.withColumn("part", F.substring(F.lower(F.hex("key")), 1, digits))


def _build(keys: DataFrame, digits: int, bits: int) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        return _coded(table.column("part")[0].as_py(), _sorted(_matrix(table.column("key"))), digits, bits)

    return _in_parts(keys, digits).groupBy("part").applyInArrow(build, STORE)


def build_store(keys: DataFrame, key: str, expected: int, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """The store of all distinct valid keys, one row per partition of about ``PARTITION_KEYS``. Distinct before the
    shuffle, so a hot key is one row per map task; partitions cannot be hot, for keys are hashes. Empty gives no row."""
    return _build(_hashed_keys(keys, key), partition_digits(expected), bits)


def stored_keys(store: DataFrame) -> DataFrame:
    """(key) of every key in a store, as 32 bytes."""

    def unpack(batches):
        for batch in batches:
            for i in range(len(batch)):
                rows = _keys(pa.Table.from_batches([batch.slice(i, 1)]))
                for k in range(0, len(rows), BATCH_KEYS):
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows[k : k + BATCH_KEYS]], pa.binary())], names=["key"])

    return store.mapInArrow(unpack, "key binary")


def store_layout(store: DataFrame, expected: int, bits: int) -> tuple[int, int]:
    """Digits and bits of a store; of one without a row, what is expected."""
    row = store.select("digits", "bits").take(1)
    return (row[0].digits, row[0].bits) if row else (partition_digits(expected), bits)


def store_size(store: DataFrame) -> DataFrame:
    """keys, code_bytes and rest_bytes a key; a key by itself takes 32."""
    code, rest = F.sum(F.octet_length("highs") + F.octet_length("lows")), F.sum(F.octet_length("rest"))
    return store.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("keys"), (code / F.sum("n")).alias("code_bytes"), (rest / F.sum("n")).alias("rest_bytes"))


def _probe(coded: EliasFano, stored: np.ndarray, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is stored, by its fingerprint and by the whole key. Equal fingerprints lie in a row."""
    by_print, exact = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if not coded.n:
        return by_print, exact
    at = coded.successor(prints)
    live = np.flatnonzero(at < coded.n)
    first = True
    while len(live):
        same = coded.values_at(at[live]) == prints[live]
        live = live[same]
        if first:
            by_print[live], first = True, False
        hit = (stored[at[live]] == keys[live]).all(axis=1)  # the bytes that the code lacks
        exact[live[hit]] = True
        live = live[~hit]
        at[live] += 1
        live = live[at[live] < coded.n]
    return by_print, exact


def _repeated(prints: np.ndarray) -> np.ndarray:
    """Which values stand at an earlier place already."""
    out = np.zeros(len(prints), bool)
    order = np.argsort(prints, kind="stable")
    out[order[1:]] = prints[order[1:]] == prints[order[:-1]]
    return out


def _turn(order: str, span: int | None):
    """The turn in which a row is taken: so many ``order`` values each; one turn without a span."""
    return F.floor(F.col(order).cast("bigint") / F.lit(span)) if span else F.lit(0).cast("bigint")


def turn_span(batch: DataFrame, order: str) -> int:
    """The span that makes about ``TURNS`` turns of ``batch``."""
    first, last = batch.agg(F.min(F.col(order).cast("bigint")), F.max(F.col(order).cast("bigint"))).first()
    return 1 if first is None else (last - first) // TURNS + 1


def probe_store(store: DataFrame, batch: DataFrame, key: str, order: str, expected: int, bits: int = FINGERPRINT_BITS, span: int | None = None) -> DataFrame:
    """For each turn of ``span`` values of ``order`` and each distinct valid key in it: its first ``order`` value, how
    often it comes, whether the store held it before and whether an earlier turn had it (exactly), whether the store has
    its fingerprint, and whether an earlier key of the batch has it. ``expected`` and ``bits`` count for an empty store
    only; any other tells its own layout.

    A turn's own repetitions are one row, so a hot key is at most a row per turn. Each partition takes its rows in
    ``order``, a turn and at most ``BATCH_KEYS`` at a time. A portion is probed against the store and against the code
    of the batch's own keys, compared with itself, and merged into that code before the next; so each key meets all
    earlier ones, however the portions are cut.
    """
    digits, bits = store_layout(store, expected, bits)
    width, known = bits - 4 * digits, bits // 8

    def answer(old: pa.Table, new: pa.Table) -> pa.Table:
        keys, first = _matrix(new.column("key")), new.column("first_put").to_numpy()
        coded, stored = _decoded(old) if old.num_rows else (EliasFano.encode(np.zeros(0, np.uint64), width), np.zeros((0, 32 - known), np.uint8))
        order_of = np.argsort(first, kind="stable")
        cuts = np.flatnonzero(np.diff(new.column("turn").to_numpy()[order_of])) + 1
        portions = [t[k : k + BATCH_KEYS] for t in np.split(order_of, cuts) for k in range(0, len(t), BATCH_KEYS)]
        by_print, exact, by_earlier, repeated = (np.zeros(len(keys), bool) for _ in range(4))
        own_code, own = EliasFano.encode(np.zeros(0, np.uint64), width), np.zeros((0, 32), np.uint8)
        for k, portion in enumerate(portions):
            prints, rest = _fingerprints(keys[portion], digits, bits), keys[portion, known:]
            by_print[portion], exact[portion] = _probe(coded, stored, rest, prints)
            by_earlier[portion], repeated[portion] = _probe(own_code, own[:, known:], rest, prints)
            by_earlier[portion] |= _repeated(prints)
            if k + 1 < len(portions):
                own = _sorted(np.concatenate([own, keys[portion[~exact[portion] & ~repeated[portion]]]]))
                own_code = EliasFano.encode(_fingerprints(own, digits, bits), width)
        return pa.table({"key": new.column("key"), "turn": new.column("turn"), "first_put": first, "puts": new.column("puts"), "in_store": exact, "repeated": repeated, "by_fingerprint": by_print, "by_earlier": by_earlier})

    each = valid(batch, key).groupBy(F.unhex(key).alias("key"), _turn(order, span).alias("turn")).agg(F.min(F.col(order).cast("bigint")).alias("first_put"), F.count(F.lit(1)).alias("puts"))
    return store.groupBy("part").cogroup(_in_parts(each, digits).groupBy("part")).applyInArrow(answer, ANSWERS)


def _merge(store: DataFrame, keys: DataFrame, digits: int, bits: int) -> DataFrame:
    def merge(old: pa.Table, new: pa.Table) -> pa.Table:
        rows = _sorted(np.concatenate([_keys(old), _matrix(new.column("key"))]))
        return _coded((old if old.num_rows else new).column("part")[0].as_py(), rows, digits, bits)

    return store.groupBy("part").cogroup(_in_parts(keys, digits).groupBy("part")).applyInArrow(merge, STORE)


def merge_store(store: DataFrame, batch: DataFrame, key: str, expected: int, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """The store with the keys of ``batch``: two sorted lists merged per partition, written anew. Where ``expected`` keys
    want other partitions than the store has, its keys are decoded and split anew. A store keeps its bits."""
    keys, (digits, bits) = _hashed_keys(batch, key), store_layout(store, expected, bits)
    if digits != (wanted := partition_digits(expected)):
        return _build(stored_keys(store).unionByName(keys).distinct(), wanted, bits)
    return _merge(store, keys, digits, bits)


class SeenKeys:
    """A store on disk that takes batch after batch, by commits (see ``commits``): the answers to a batch and the store
    with its keys are committed together, so a batch that died has left nothing, and one that is tried again is answered
    as if it had never been there."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.log = spark, Commits(spark, folder or scratch_path(spark, "seen-keys"))

    def store(self) -> DataFrame:
        _, content = self.log.latest()
        return self.log.tables([f"{content['data']}/store"] if content else [], STORE)

    def _advance(self, write, attempts: int) -> str:
        for _ in range(attempts):
            last, content = self.log.latest()
            data = self.log.stage()
            keys = write(self.store(), content.get("keys", 0), data)
            if self.log.commit(last + 1, {"data": data, "keys": keys}):
                return data
        raise RuntimeError(f"{attempts} commits in a row were taken by other runs")

    def _write_store(self, store: DataFrame, data: str) -> int:
        store.write.parquet(f"{data}/store")
        return self.spark.read.schema(STORE).parquet(f"{data}/store").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def add(self, keys: DataFrame, key: str, expected: int, attempts: int = 5) -> None:
        """Merge keys without asking."""
        self._advance(lambda store, held, data: self._write_store(merge_store(store, keys, key, max(expected, held)), data), attempts)

    def take(self, batch: DataFrame, key: str, order: str, expected: int, span: int | None = None, attempts: int = 5) -> DataFrame:
        """The answers of :func:`probe_store` for ``batch``, whose new keys are then in the store."""

        def write(store: DataFrame, held: int, data: str) -> int:
            probe_store(store, batch, key, order, expected, span=span).write.parquet(f"{data}/answers")
            fresh = self.spark.read.parquet(f"{data}/answers").where("not in_store and not repeated").select("key").distinct()
            digits, bits = store_layout(store, expected, FINGERPRINT_BITS)
            wanted = partition_digits(held + fresh.count())
            merged = _merge(store, fresh, digits, bits) if digits >= wanted else _build(stored_keys(store).unionByName(fresh), wanted, bits)
            return self._write_store(merged, data)

        return self.spark.read.parquet(f"{self._advance(write, attempts)}/answers")


def seen_rows(batch: DataFrame, key: str, order: str, answers: DataFrame, span: int | None = None) -> DataFrame:
    """Rows of ``batch`` whose key was in the store, in an earlier turn (``span`` as in :func:`probe_store`) or in a row
    of its turn with a smaller ``order``. Only keys that were seen at all are joined back; that side has one row a key
    and turn, so adaptive execution can split a hot key's rows."""
    known = answers.where("in_store or repeated or puts > 1").select(F.lower(F.hex("key")).alias("__key"), F.col("turn").alias("__turn"), "first_put", (F.col("in_store") | F.col("repeated")).alias("__before"))
    rows = valid(batch, key).join(known, (F.col(key) == F.col("__key")) & (_turn(order, span) == F.col("__turn")))
    return rows.where(F.col("__before") | (F.col(order) > F.col("first_put"))).drop("__key", "__turn", "first_put", "__before")


def list_keys(lists: DataFrame, hashes: str) -> tuple[DataFrame, int]:
    """The keys of all lists one by one, and how many there are with repetitions (from the lists' lengths alone)."""
    total = lists.agg(F.coalesce(F.sum(F.greatest(F.size(hashes), F.lit(0))), F.lit(0))).first()[0]
    return lists.select(F.explode(hashes).alias("key")), int(total)


def wrong_rate(answers: DataFrame, earlier: bool = False) -> DataFrame:
    """keys, seen, wrong (fingerprint says seen, the whole key does not; it never errs the other way) and the rate.
    ``earlier``: fingerprints of earlier keys of the batch err as well as those of the store."""
    hit = F.col("by_fingerprint") | F.col("by_earlier") if earlier else F.col("by_fingerprint")
    wrong = F.sum((hit & ~F.col("in_store")).cast("bigint"))
    total = answers.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(F.col("in_store").cast("bigint")), F.lit(0)).alias("seen"), F.coalesce(wrong, F.lit(0)).alias("wrong"))
    return total.withColumn("wrong_rate", F.coalesce(F.col("wrong") / F.nullif(F.col("keys") - F.col("seen"), F.lit(0)), F.lit(0.0)))


