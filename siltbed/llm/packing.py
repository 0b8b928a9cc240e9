"""Filling fixed-capacity containers along a space-filling curve.

Each document's hashed pieces are projected to ``DIMENSIONS`` numbers; their position on the Hilbert curve orders the
corpus so that documents of like content are neighbours. The corpus is range-sorted by that key, and runs of
``WINDOW`` neighbours are packed: an item above the capacity is cut into full containers and a rest, rests and whole
items go by decreasing size to the fullest open container that still takes them. Containers that stay open at the end
of a window stay open for the next one, so only the last few of a partition remain partly empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.bpe import NAME, TOKENIZERS, Encoder, load, portions, text_bytes

DIMENSIONS, CURVE_BITS = 4, 8
#: Neighbouring items that are packed together.
WINDOW = 8192
#: Open containers that are carried from one window to the next.
CARRIED = 256

PLACED = "container_kind string, capacity bigint, container_id bigint, doc_id bigint, token_start bigint, token_count bigint, position bigint"


def hilbert_key(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Positions on the Hilbert curve of the rows of ``cells`` (n, dimensions), integers below 2**bits. After
    J. Skilling, Programming the Hilbert curve, 2004."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] ^= np.where(on, p, swap)
            if i:
                x[i] ^= np.where(on, 0, swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def project(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Cells of the documents whose pieces begin at ``first``: the sums of pseudo-random signs of the pieces, put on a
    scale of their spread and cut to the grid."""
    n = np.diff(first)
    cells = np.zeros((len(n), DIMENSIONS), np.int64)
    some = n > 0
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    for k in range(DIMENSIONS):
        signs = ((mixed >> np.uint64(40 + 5 * k)) & np.uint64(1)).astype(np.int64) * 2 - 1
        total = np.concatenate([[0], np.cumsum(signs)])
        mean = (total[first[1:]] - total[first[:-1]])[some] / np.sqrt(n[some])
        cells[some, k] = np.clip((np.tanh(mean / 8) + 1) * (1 << (CURVE_BITS - 1)), 0, (1 << CURVE_BITS) - 1).astype(np.int64)
    return cells


def measured(documents: DataFrame, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(doc_id, tokens, curve) of each document with at least one token; whole texts. Null and empty texts hold no
    token and need no room."""
    shared = documents.sparkSession.sparkContext.broadcast(load(folder, name))

    def work(batches):
        encoder = Encoder(shared.value)
        for part in portions(batches, "text"):
            _, sizes, (first, hashes) = encoder.encode(*text_bytes(part.column("text")), want_ids=False)
            key = hilbert_key(project(first, hashes))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(key)], names=["doc_id", "tokens", "curve"])

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id bigint, tokens bigint, curve bigint").where("tokens > 0")


def partitions_for(items: int, most: int) -> int:
    """Stretches of the curve that are packed apart: long ones, for each leaves some containers partly empty, and at
    most as many as the cluster shuffles into."""
    return max(1, min(most, items // (4 * WINDOW)))


class Packer:
    """Open containers of one capacity, found by their room: bit r of ``rooms`` tells that one with room r is open."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.rooms, self.by_room = 0, {}

    def place(self, size: int) -> tuple[int, int]:
        """(container, position within it) for an item of ``size`` tokens, by best fit."""
        above = self.rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            container = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms &= ~(1 << room)
        else:
            room, container = self.capacity, self.next_id
            self.next_id += 1
        left = room - size
        if left:
            self.by_room.setdefault(left, []).append(container)
            self.rooms |= 1 << left
        return container, self.capacity - room

    def close(self, keep: int) -> None:
        """Keep the ``keep`` open containers with most room, so that the memory stays bounded."""
        kept, rooms = {}, self.rooms
        while rooms and keep > 0:
            room = rooms.bit_length() - 1
            kept[room] = self.by_room[room][:keep]
            keep -= len(kept[room])
            rooms &= ~(1 << room)
        self.by_room, self.rooms = kept, sum(1 << r for r in kept)


def _pack_window(packer: Packer, doc: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Columns (container, doc, start, count, position) of the items."""
    full = size // packer.capacity
    rest = size % packer.capacity
    owner = np.repeat(np.arange(len(size)), full)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    containers = packer.next_id + np.arange(len(owner))
    packer.next_id += len(owner)
    items = np.flatnonzero(rest)
    items = items[np.argsort(-rest[items], kind="stable")]
    placed = np.array([packer.place(s) for s in rest[items].tolist()], np.int64).reshape(-1, 2)
    return [
        np.concatenate([containers, placed[:, 0]]),
        np.concatenate([doc[owner], doc[items]]),
        np.concatenate([nth * packer.capacity, full[items] * packer.capacity]),
        np.concatenate([np.full(len(owner), packer.capacity), rest[items]]),
        np.concatenate([np.zeros(len(owner), np.int64), placed[:, 1]]),
    ]


def pack(items: DataFrame, kinds: list[tuple[str, int]], partitions: int) -> DataFrame:
    """Where every token goes: container_kind, capacity, container_id, doc_id, token_start, token_count, position
    (of the first of these tokens in the container). ``items``: doc_id, tokens, curve, each at least one token.

    An item larger than the capacity is cut, any other stays whole. Container ids are unique within a kind and capacity. The
    order of equal curve keys is that of doc_id; repeated items are placed as often as they come.
    """
    spread = items.repartitionByRange(partitions, "curve", "doc_id").sortWithinPartitions("curve", "doc_id").withColumn("part", F.spark_partition_id())

    def work(batches):
        packers = None
        pending: list[tuple[np.ndarray, np.ndarray]] = []

        def emit():
            doc, size = (np.concatenate(c) for c in zip(*pending))
            pending.clear()
            for (kind, _), packer in packers.items():
                columns = _pack_window(packer, doc, size)
                packer.close(CARRIED)
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * n, pa.string()), pa.array(np.full(n, packer.capacity)), *(pa.array(c.astype(np.int64)) for c in columns)],
                    names=["container_kind", "capacity", "container_id", "doc_id", "token_start", "token_count", "position"],
                )

        for batch in batches:
            if not len(batch):
                continue
            if packers is None:
                packers = {(kind, capacity): Packer(capacity, batch.column("part")[0].as_py() << 40) for kind, capacity in kinds}
            pending.append((batch.column("doc_id").to_numpy(), batch.column("tokens").to_numpy()))
            if sum(len(d) for d, _ in pending) >= WINDOW:
                yield from emit()
        if pending:
            yield from emit()

    return spread.mapInArrow(work, PLACED)


def fill_rates(placed: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, the least number of containers that the tokens need, and the share of room used."""
    kinds = placed.groupBy("container_kind", "capacity", "container_id").agg(F.sum("token_count").alias("used"))
    rates = kinds.groupBy("container_kind", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"))
    return rates.withColumn("least", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity")))


def broken_rules(placed: DataFrame, items: DataFrame) -> DataFrame:
    """Per kind and capacity: documents placed, and how many containers are too full, how many hold tokens on top of each
    other, how many documents are not placed whole, and how many were cut though they fit; all but the first must be 0.
    ``items``: doc_id, tokens, each document once."""
    kind = ["container_kind", "capacity"]
    in_order = Window.partitionBy(*kind, "container_id").orderBy("position")
    held = placed.withColumn("__clash", F.coalesce(F.col("position") < F.lag(F.col("position") + F.col("token_count")).over(in_order), F.lit(False)))
    boxes = held.groupBy(*kind, "container_id").agg(F.sum("token_count").alias("used"), F.max("__clash").alias("clash"))
    boxes = boxes.groupBy(*kind).agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"), F.count_if("clash").alias("overlapping"))
    docs = placed.groupBy(*kind, "doc_id").agg(F.sum("token_count").alias("n"), F.max(F.col("token_start") + F.col("token_count")).alias("end"), F.count(F.lit(1)).alias("parts"), F.countDistinct("token_start").alias("starts"))
    docs = docs.join(items.select("doc_id", "tokens"), "doc_id", "left")
    whole = F.coalesce((F.col("n") == F.col("tokens")) & (F.col("end") == F.col("tokens")) & (F.col("parts") == F.col("starts")), F.lit(False))
    docs = docs.groupBy(*kind).agg(F.count(F.lit(1)).alias("documents"), F.count_if(~whole).alias("not_whole"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("cut_small"))
    return docs.join(boxes, kind)
