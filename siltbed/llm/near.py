"""Duplicates and near-duplicates of sets against everything taken in before.

A set of chunk hashes has a bit-difference fingerprint: a number of 64-bit blocks, each the exclusive-or of the hashes
that fall into it, and a 64-bit word of their parities. One differing element changes one block and at most one bit of
the word, so sets of a and b elements with a Jaccard similarity of at least s differ in at most
t = (1 - s) / (1 + s) * (a + b) blocks; with t + 1 blocks at least one is equal. The blocks are stored in one table per
block number and size level, as if rotated to the front; an exact match in any of them makes a candidate, the
Hamming distance of the parity words must not exceed t, and the sets themselves are compared last.

A block that is empty, or that holds none but very frequent elements, selects nothing. A set with such a block also
stores its first a - ceil(s * a) + 1 elements in an order that puts the frequent ones last: two similar sets always
share one of these. So no pair is lost, whichever blocks are left out.
"""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.commits import Commits
from siltbed.session import broadcast_if_small, materialise, scratch_path

#: Least similarity, in tenths.
TENTHS = 7
#: A bucket of more sets than this is worked off against its earliest sets, so many at a time.
ANCHORS = 64
#: An element of more sets than HOT_LEAST and than one in HOT_SHARE of all is frequent; so at most HOT_SHARE are.
HOT_LEAST, HOT_SHARE = 256, 20_000
#: How many times as many sets begin a new epoch of frequent elements.
GROWTH = 4

SIGNATURES = "sig bigint, cid bigint, n int, parity bigint"


def size_levels(most: int) -> np.ndarray:
    """The largest size of each level: a set's similar sets are of its own or a neighbouring level."""
    tops, top = [], 0
    while top < most:
        top = (top + 1) * 10 // TENTHS
        tops.append(top)
    return np.array(tops, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def signatures(cid: np.ndarray, sizes: np.ndarray, elements: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
    """The rows of the block tables for sets of distinct 64-bit elements, given end to end. Sets with fewer than three
    elements have no near-duplicates but equal sets and come out with none."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    e = elements.astype(np.uint64, copy=False) if elements.dtype == np.uint64 else elements.view(np.uint64)
    at = np.searchsorted(hot, e)
    is_hot = hot[np.minimum(at, len(hot) - 1)] == e if len(hot) else np.zeros(len(e), bool)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    parity = np.bitwise_xor.reduceat(np.uint64(1) << (_mix(e) & np.uint64(63)), starts) if len(e) else np.zeros(0, np.uint64)
    order = np.lexsort((_mix(e), is_hot, owner))
    rank = np.arange(len(e)) - starts[owner]
    tops = size_levels(int(sizes.max()) if len(sizes) else 0)
    own = np.searchsorted(tops, sizes)
    out: dict[str, list[np.ndarray]] = {"sig": [], "set": []}
    for step in (0, 1):
        level = own + step
        top = size_levels(int(tops[-1]) * 2 + 2)[level] if len(level) else level
        blocks = (10 - TENTHS) * 2 * top // (10 + TENTHS) + 1
        busy = (blocks > 1) & (sizes > 2)
        salt = _mix(level.astype(np.uint64) + np.uint64(1))
        block = (_mix(e ^ salt[owner]) % blocks[owner].astype(np.uint64)).astype(np.int64)
        use = busy[owner]
        if not use.any():
            continue
        o, b, x, h = owner[use], block[use], e[use], is_hot[use]
        turn = np.lexsort((b, o))
        o, b, x, h = o[turn], b[turn], x[turn], h[turn]
        first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (b[1:] != b[:-1])]))
        value, all_hot = np.bitwise_xor.reduceat(_mix(x), first), np.logical_and.reduceat(h, first)
        o, b = o[first], b[first]
        good = ~all_hot
        out["sig"].append(_mix(value[good] ^ _mix((b[good].astype(np.uint64) << np.uint64(20)) ^ salt[o[good]])))
        out["set"].append(o[good])
        weak = busy & (np.bincount(o[good], minlength=len(sizes)) < blocks)
        prefix = sizes - -(-TENTHS * sizes // 10) + 1
        lead = weak[owner] & (rank < prefix[owner])  # the k-th of a set in the common order
        out["sig"].append(_mix(e[order][lead] + _mix(salt[owner[lead]] + np.uint64(7))))
        out["set"].append(owner[lead])
    which = np.concatenate(out["set"]).astype(np.int64) if out["set"] else np.zeros(0, np.int64)
    sig = np.concatenate(out["sig"]) if out["sig"] else np.zeros(0, np.uint64)
    return {"sig": sig.view(np.int64), "cid": cid[which], "n": sizes[which].astype(np.int32), "parity": parity[which].view(np.int64)}


def block_tables(sets: DataFrame, hot: np.ndarray, epoch: int = 0) -> DataFrame:
    """(sig, cid, n, parity) of ``sets`` (cid, elements array<bigint>, distinct within each); signatures of different
    epochs never meet."""
    shared = sets.sparkSession.sparkContext.broadcast(hot)
    turned = _mix(np.array([epoch], np.uint64)).view(np.int64)

    def work(batches):
        for batch in batches:
            column = batch.column("elements")
            sizes = np.diff(np.asarray(column.offsets)).astype(np.int64)
            kept = signatures(batch.column("cid").to_numpy(), sizes, column.flatten().to_numpy(), shared.value)
            kept["sig"] = kept["sig"] ^ turned
            yield pa.RecordBatch.from_pydict(kept)

    return sets.where(F.size("elements") > 2).select("cid", "elements").mapInArrow(work, SIGNATURES)


def hot_elements(sets: DataFrame, total: int | None = None) -> np.ndarray:
    """Frequent elements, sorted; at most ``HOT_SHARE`` of them by their definition. ``total``: elements of all sets,
    where ``sets`` are only some."""
    counts = sets.select(F.explode("elements").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    total = sets.agg(F.coalesce(F.sum(F.size("elements")), F.lit(0))).first()[0] if total is None else total
    frequent = counts.where(F.col("n") > max(HOT_LEAST, total // HOT_SHARE)).select("e").collect()
    return np.sort(np.array([r[0] for r in frequent], np.int64).view(np.uint64))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (early, late) whose sets are similar enough: first by 64-bit hashes, then what is left by the chunk hashes
    themselves, so no collision can make a match."""

    def held(candidates: DataFrame, column: str) -> DataFrame:
        ids = candidates.select(F.explode(F.array("early", "late")).alias("cid")).distinct()
        some = sets.select("cid", column).join(broadcast_if_small(ids), "cid", "left_semi")
        both = candidates.join(some.select(F.col("cid").alias("early"), F.col(column).alias("__a")), "early")
        both = both.join(some.select(F.col("cid").alias("late"), F.col(column).alias("__b")), "late")
        common = F.size(F.array_intersect("__a", "__b"))
        return both.where(common * (10 + TENTHS) >= (F.size("__a") + F.size("__b")) * TENTHS).select("early", "late")

    return held(materialise(held(materialise(pairs, "pairs"), "elements"), "close"), "hashes")


def _close(a: str, b: str):
    """Sizes and parity words allow the similarity."""
    small, large = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")), F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    apart = F.bit_count(F.col(f"{a}.parity").bitwiseXOR(F.col(f"{b}.parity")))
    return (small * 10 >= large * TENTHS) & (apart * (10 + TENTHS) <= (small + large) * (10 - TENTHS))


def earliest_similar(sets: DataFrame, table: DataFrame) -> DataFrame:
    """(late, early): for each fresh set the smallest cid of an earlier similar one, where there is one. ``table``: block
    tables with ``fresh`` and ``leads``, that a row may be the earlier one; sets that are not fresh are never paired
    among themselves, and no set that only looks up under a former epoch with another one of these.

    Buckets of one block value with up to ``ANCHORS`` leading sets are paired in full. A larger one is worked off in rounds:
    all of its sets against its ``ANCHORS`` earliest, then those that match none of them against the next ones, until
    none is left; a set that matches an anchor needs no later one, for those have greater ids. So the pairs stay in
    proportion to the bucket for families of copies, and nothing is capped.
    """
    columns = ["sig", "cid", "n", "parity"]
    rows = table.dropDuplicates(["sig", "cid"])
    sizes = rows.groupBy("sig").agg(F.count_if("leads").alias("in_bucket"), F.count(F.lit(1)).alias("__all"), F.max("fresh").alias("__asked"))
    sizes = sizes.where("in_bucket > 0 and __all > 1 and __asked").select("sig", "in_bucket")
    shared = materialise(rows.join(sizes, "sig"), "buckets")
    small = shared.where(F.col("in_bucket") <= ANCHORS)
    a, b = small.where("leads").alias("a"), small.where("fresh").alias("b")
    pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.cid") < F.col("b.cid"))).where(_close("a", "b"))
    found = _similar(pairs.select(F.col("a.cid").alias("early"), F.col("b.cid").alias("late")).distinct(), sets).groupBy("late").agg(F.min("early").alias("early"))

    large = shared.where(F.col("in_bucket") > ANCHORS)
    pool, pending = large.where("leads").select(*columns), large.where("fresh").select(*columns)
    while pending.take(1):
        anchors = materialise(_earliest(pool), "anchors")
        x, y = anchors.alias("x"), pending.alias("y")
        near = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.cid") < F.col("y.cid"))).where(_close("x", "y"))
        matched = materialise(_similar(near.select(F.col("x.cid").alias("early"), F.col("y.cid").alias("late")).distinct(), sets), "matched")
        found = found.unionByName(matched.select("late", "early"))
        done = anchors.select("sig", F.col("cid").alias("early")).join(matched, "early").select("sig", F.col("late").alias("cid")).distinct()
        last = anchors.groupBy("sig").agg(F.max("cid").alias("last"))
        pending = pending.join(last, "sig").where(F.col("cid") > F.col("last")).drop("last").join(done, ["sig", "cid"], "left_anti")
        pending = materialise(pending, "pending")
        pool = pool.join(last, "sig").where(F.col("cid") > F.col("last")).drop("last").join(pending.select("sig").distinct(), "sig", "left_semi")
        pool = materialise(pool, "pool")
    return found.groupBy("late").agg(F.min("early").alias("early"))


def _earliest(pool: DataFrame) -> DataFrame:
    """The ``ANCHORS`` smallest cids of each bucket; first within 64 slices of a bucket, so no task sees a hot one whole."""
    slices = Window.partitionBy("sig", F.pmod(F.xxhash64("cid"), F.lit(64))).orderBy("cid")
    few = pool.withColumn("__r", F.row_number().over(slices)).where(F.col("__r") <= ANCHORS)
    whole = Window.partitionBy("sig").orderBy("cid")
    return few.withColumn("__r", F.row_number().over(whole)).where(F.col("__r") <= ANCHORS).drop("__r")


def hashed_sets(files: DataFrame) -> DataFrame:
    """intake_id, content_hash, hashes (the distinct chunk hashes as bytes, sorted; null where there are none), elements
    (the same as 64-bit hashes) and the key of the set, a SHA-256 over it. Null chunk hashes are no hashes."""
    # 64 hex digits take half the room; a leading byte keeps them apart from text of any other form.
    packed = lambda h: F.when(h.rlike("^[0-9a-f]{64}$"), F.concat(F.lit(b"h"), F.unhex(h))).otherwise(F.concat(F.lit(b"t"), h.cast("binary")))
    hashes = F.array_sort(F.array_distinct(F.transform(F.filter("chunks", lambda c: c.hash.isNotNull()), lambda c: packed(c.hash))))
    rows = files.select(F.col("intake_id").cast("bigint").alias("intake_id"), "content_hash", F.when(F.size("chunks") > 0, hashes).alias("hashes"))
    rows = rows.withColumn("hashes", F.when(F.size("hashes") > 0, F.col("hashes")))
    whole = F.array_join(F.transform("hashes", lambda h: F.concat(F.hex(F.octet_length(h)), F.lit(":"), F.hex(h))), ",")
    return rows.withColumns({"elements": F.array_distinct(F.transform("hashes", lambda h: F.xxhash64(h))), "key": F.unhex(F.sha2(whole, 256))})


class History:
    """Everything accepted so far: the distinct sets with their block tables, the links found and the content hashes, in
    parquet that only grows, by commits (see ``commits``). A batch is looked up against it by its own blocks and then
    appended with its answers in one commit, so a batch that died has left nothing.

    Which elements are called frequent is fixed for an epoch; when the history has grown ``GROWTH`` times since, the
    next batch begins a new one, and so does a batch that alone holds so many sets of some other element that it is
    frequent now. A set is stored under its own epoch and looks up under every one, so two sets always meet in the epoch
    of the earlier one; there are logarithmically many, and one for each batch that brings frequent elements of its own.
    """

    SETS = "key binary, cid bigint, elements array<bigint>, hashes array<binary>"
    BLOCKS = "sig bigint, cid bigint, n int, parity bigint"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, Commits(spark, folder)

    def _table(self, content: dict, name: str, schema: str) -> DataFrame:
        return self.log.tables([f"{d}/{name}" for d in content.get("data", [])], schema)

    def answers(self) -> DataFrame:
        """(intake_id, earlier_id) of all batches."""
        return self._table(self.log.latest()[1], "answers", "intake_id bigint, earlier_id bigint")

    def take(self, batch: DataFrame, attempts: int = 5) -> DataFrame:
        """(intake_id, earlier_id) for each file of ``batch`` with an earlier match, its own or a former batch's; then the
        batch is appended. intake_ids must be greater than all that were taken before; an empty batch changes nothing."""
        for _ in range(attempts):
            last, content = self.log.latest()
            data = self.log.stage()
            ids = batch.agg(F.min(F.col("intake_id").cast("bigint")), F.max(F.col("intake_id").cast("bigint"))).first()
            if ids[0] is None:
                return self.log.tables([], "intake_id bigint, earlier_id bigint")
            if ids[0] <= content.get("to", ids[0] - 1):
                raise ValueError(f"ids up to {content['to']} were taken already")
            state = self._append(batch, content, data)
            if self.log.commit(last + 1, state | {"to": ids[1], "data": [*content.get("data", []), data]}):
                return self.spark.read.parquet(f"{data}/answers")
        raise RuntimeError(f"{attempts} commits in a row were taken by other runs")

    def _append(self, batch: DataFrame, content: dict, data: str) -> dict:
        rows = hashed_sets(batch)
        sets = self._table(content, "sets", self.SETS)
        new = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("intake_id").alias("cid"), F.first("elements").alias("elements"), F.first("hashes").alias("hashes"))
        known = materialise(new.join(sets.select("key", F.col("cid").alias("first")), "key", "left"), "batch-sets")
        fresh = known.where("first is null").drop("first")

        count, width = fresh.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("elements")), F.lit(0))).first()
        epochs, total, held = content.get("epochs", []), content.get("sets", 0) + count, content.get("elements", 0) + width
        if not epochs or total > GROWTH * epochs[-1]["sets"]:
            elements = sets.select("elements").unionByName(fresh.select("elements"))
            epochs = [*epochs, {"sets": total, "hot": hot_elements(elements).view(np.int64).tolist()}]
        else:
            hot = np.union1d(np.array(epochs[-1]["hot"], np.int64).view(np.uint64), hot_elements(fresh, held))
            if len(hot) > len(epochs[-1]["hot"]):
                epochs = [*epochs, {"sets": epochs[-1]["sets"], "hot": hot.view(np.int64).tolist()}]
        signed = [block_tables(fresh, np.array(e["hot"], np.int64).view(np.uint64), k) for k, e in enumerate(epochs)]
        signed[-1].write.parquet(f"{data}/blocks")
        own = self.spark.read.parquet(f"{data}/blocks")
        own = own.withColumn("leads", F.lit(True))
        asked = materialise(reduce(DataFrame.unionByName, [*(s.withColumn("leads", F.lit(False)) for s in signed[:-1]), own]), "asked") if len(signed) > 1 else own
        met = self._table(content, "blocks", self.BLOCKS).join(broadcast_if_small(asked.select("sig").distinct()), "sig", "left_semi")
        table = met.withColumns({"leads": F.lit(True), "fresh": F.lit(False)}).unionByName(asked.withColumn("fresh", F.lit(True)))
        columns = ["cid", "elements", "hashes"]
        near = earliest_similar(sets.select(*columns).unionByName(fresh.select(*columns)), table)
        near.select("late", "early").write.parquet(f"{data}/links")

        links = self._table(content | {"data": [*content.get("data", []), data]}, "links", "late bigint, early bigint")
        best = known.select("key", F.coalesce("first", "cid").alias("cid")).join(links, F.col("cid") == F.col("late"), "left").select(F.col("key").alias("__key"), F.least("cid", "early").alias("by_set"))
        mine = batch.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min(F.col("intake_id").cast("bigint")).alias("by_content"))
        contents = self._table(content, "contents", "content_hash string, by_content bigint")
        before = contents.select(F.col("content_hash").alias("__hash"), F.col("by_content").alias("__before"))
        mine = mine.join(before, F.col("content_hash") == F.col("__hash"), "left")
        joined = rows.select("intake_id", "content_hash", "key").join(best, F.col("key") == F.col("__key"), "left")
        joined = joined.join(mine.select(F.col("content_hash").alias("__content"), F.least("by_content", "__before").alias("by_content")), F.col("content_hash") == F.col("__content"), "left")
        answers = joined.select("intake_id", F.least("by_set", "by_content").alias("earlier_id")).where(F.col("earlier_id") < F.col("intake_id"))
        answers.write.parquet(f"{data}/answers")
        mine.where("__before is null").select("content_hash", "by_content").write.parquet(f"{data}/contents")
        fresh.select("key", "cid", "elements", "hashes").write.option("compression", "zstd").parquet(f"{data}/sets")
        return {"epochs": epochs, "sets": total, "elements": held}


def earliest_matches(files: DataFrame, batch: str | None = None, deliveries: int = 1, folder: str | None = None) -> DataFrame:
    """(intake_id, earlier_id): for each file the smallest earlier intake_id with an equal content_hash or a similar
    set of chunks, where there is one. The files go through a history (at ``folder``, else for this run only) in
    ``deliveries`` of equally many numbers of the column ``batch``, or at once. Where these numbers run against the
    intake_ids, a delivery is as many files as the next one, by intake_id.

    Equal sets are one class, so copies never meet in pairs; near-duplicates are found between classes. Null content
    hashes match nothing, and files without chunks match by content only. Files without a batch number come with the
    last; earlier is what has the smaller intake_id, whatever the batch numbers say.
    """
    spark = files.sparkSession
    history = History(spark, folder or scratch_path(spark, "history"))
    if batch is None or deliveries == 1:
        history.take(files)
        return history.answers()
    lo, hi = files.agg(F.min(batch), F.max(batch)).first()
    if lo is None:
        lo = hi = 0
    turn, arrival = F.coalesce(F.floor((F.col(batch).cast("bigint") - lo) * deliveries / (hi - lo + 1)), F.lit(deliveries - 1)), F.col("intake_id").cast("bigint")
    spans = files.groupBy(turn.alias("turn")).agg(F.min(arrival).alias("first"), F.max(arrival).alias("last")).where("first is not null").orderBy("turn").collect()
    if any(after["first"] <= before["last"] for before, after in pairwise(spans)):
        cuts = files.agg(F.percentile_approx(arrival, [k / deliveries for k in range(1, deliveries)])).first()[0]
        turn = reduce(Column.__add__, [(arrival > cut).cast("int") for cut in cuts])
    for k in range(deliveries):
        history.take(files.where(turn == k))
    return history.answers()
