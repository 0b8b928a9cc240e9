"""Sets of sequence numbers kept as disjoint, inclusive intervals, and processing of what is not in them yet.

Sequence numbers are cut into blocks of ``BLOCK``; intervals never leave their block, so all of the work for one
source spreads over the cluster however many rows that source holds, and no task sees more than one block of a key.
Merging across block borders happens only on the two outermost intervals of each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.commits import Commits
from siltbed.session import materialise

#: Sequence numbers per block.
BLOCK = 1 << 16


def block_of(seq: Column) -> Column:
    return F.floor(seq / BLOCK).cast("bigint")


def to_intervals(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The distinct numbers of ``rows`` as intervals (key, block, lo, hi). Null numbers are left out; a null key is a key."""
    numbers = rows.where(F.col(seq).isNotNull()).select(F.col(key).alias(key), F.col(seq).cast("bigint").alias("seq")).distinct()
    in_block = Window.partitionBy(key, "block").orderBy("seq")
    runs = numbers.withColumn("block", block_of(F.col("seq"))).withColumn("run", F.col("seq") - F.row_number().over(in_block))
    return runs.groupBy(key, "block", "run").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).drop("run")


def _sweep(parts: DataFrame, key: str, wanted: Column) -> DataFrame:
    """Cut (key, block, lo, hi, side) at every border and keep the stretches where ``wanted`` holds of the
    numbers of open intervals on side 0 and 1 (columns ``a`` and ``b``)."""
    ends = F.array(
        F.struct(F.col("lo").alias("at"), F.lit(1).alias("step")),
        F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("step")),
    )
    points = parts.select(key, "block", "side", F.explode(ends).alias("e")).select(key, "block", "side", "e.*")
    points = points.groupBy(key, "block", "at").agg(*[F.sum(F.when(F.col("side") == s, F.col("step")).otherwise(0)).alias(n) for s, n in ((0, "da"), (1, "db"))])
    w = Window.partitionBy(key, "block").orderBy("at")
    open_ = points.select(
        key, "block", F.col("at").alias("lo"), (F.lead("at").over(w) - 1).alias("hi"),
        F.sum("da").over(w).alias("a"), F.sum("db").over(w).alias("b"),
    ).where(F.col("hi").isNotNull())
    kept = open_.withColumn("keep", wanted)
    lag = kept.withColumn("new", F.when(F.col("keep") & ~F.coalesce(F.lag("keep").over(Window.partitionBy(key, "block").orderBy("lo")), F.lit(False)), 1).otherwise(0))
    runs = lag.withColumn("run", F.sum("new").over(Window.partitionBy(key, "block").orderBy("lo"))).where("keep")
    return runs.groupBy(key, "block", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def merge_intervals(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The union of two interval sets, disjoint again."""
    parts = one.select(key, "block", "lo", "hi", F.lit(0).alias("side")).unionByName(other.select(key, "block", "lo", "hi", F.lit(1).alias("side")))
    return _sweep(parts, key, (F.col("a") > 0) | (F.col("b") > 0))


def subtract_intervals(available: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """What of ``available`` is not in ``processed``: the gaps, with late numbers between processed ones."""
    parts = available.select(key, "block", "lo", "hi", F.lit(0).alias("side")).unionByName(processed.select(key, "block", "lo", "hi", F.lit(1).alias("side")))
    return _sweep(parts, key, (F.col("a") > 0) & (F.col("b") == 0))


def across_blocks(intervals: DataFrame, key: str) -> DataFrame:
    """(key, lo, hi) joined over block borders, for reports. Only intervals that touch a border are merged per key:
    at most two per block, so a key of n numbers brings n / 32768 rows to its task; the others pass by."""
    touches = (F.col("lo") == F.col("block") * BLOCK) | (F.col("hi") == (F.col("block") + 1) * BLOCK - 1)
    w = Window.partitionBy(key).orderBy("lo")
    edge = intervals.where(touches).withColumn("new", F.when(F.col("lo") == F.lag("hi").over(w) + 1, 0).otherwise(1))
    merged = edge.withColumn("run", F.sum("new").over(w)).groupBy(key, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")
    return intervals.where(~touches).select(key, "lo", "hi").unionByName(merged)


def word_masks(intervals: DataFrame, key: str) -> DataFrame:
    """(key, word, mask): the intervals as bits, 64 numbers a row; linear in the numbers however ragged they are."""
    words = intervals.select(key, "lo", "hi", F.explode(F.sequence(F.shiftright("lo", 6), F.shiftright("hi", 6))).alias("word"))
    first, last = "int(greatest(lo, word * 64) & 63)", "int(least(hi, word * 64 + 63) & 63)"
    mask = F.expr(f"shiftleft(-1L, {first}) & shiftrightunsigned(-1L, 63 - {last})")
    return words.groupBy(key, "word").agg(F.bit_or(mask).alias("mask"))


def rows_in(rows: DataFrame, intervals: DataFrame, key: str, seq: str) -> DataFrame:
    """``rows`` with ``in_gap``: whether their number is in one of the intervals. A plain equi-join on key and number / 64,
    then one bit; the rows are the streamed side, so repeated numbers may be as many as they like. A null key equals a
    null key; a null number is in no interval."""
    masks = word_masks(intervals, key).select(F.col(key).alias("__key"), F.col("word").alias("__word"), F.col("mask").alias("__mask"))
    left = rows.withColumn("__at", F.col(seq).cast("bigint"))
    on = F.col(key).eqNullSafe(F.col("__key")) & (F.shiftright("__at", 6) == F.col("__word"))
    bit = F.expr("coalesce(getbit(__mask, int(__at & 63)) = 1, false)")
    return left.join(masks, on, "left").withColumn("in_gap", bit).drop("__key", "__word", "__mask", "__at")


class Ledger:
    """Processed intervals on disk, committed together with the output they stand for (see ``commits``).

    A run fixes the gaps once, as a table; the output and the merged intervals are both made from it, so a source that
    grows meanwhile changes neither, and its new numbers are the next run's. A run that dies before its commit leaves
    nothing that a later run reads; one that finds its commit taken by another starts over from the new state. So no
    number is skipped and none is repeated.

    Rows that are wholly equal are handed over once; rows of one number that differ are handed over all, for only
    ``process`` can tell which counts. Rows without a number have no place in a sequence: they are left out, and their
    number is in the commit (``unnumbered``). Extra columns pass through; an empty source commits empty tables.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, seq: str):
        self.spark, self.log, self.key, self.seq = spark, Commits(spark, folder), key, seq

    def commits(self) -> list[int]:
        return self.log.numbers()

    def processed(self, key_type: str = "string") -> DataFrame:
        number, content = self.log.latest()
        return self._intervals(content, key_type)

    def _intervals(self, content: dict, key_type: str) -> DataFrame:
        return self.log.tables([f"{content['data']}/intervals"] if content else [], f"{self.key} {key_type}, block bigint, lo bigint, hi bigint")

    def output(self, number: int | None = None) -> DataFrame:
        """The output of one commit, or of all."""
        return self.spark.read.parquet(*[f"{self.log.read(n)['data']}/output" for n in (self.commits() if number is None else [number])])

    def run(self, rows: DataFrame, process, attempts: int = 5) -> int:
        """Process what the ledger does not hold: ``process(new_rows)`` gives the output. Returns the commit's number."""
        for _ in range(attempts):
            last, content = self.log.latest()
            before = self._intervals(content, dict(rows.dtypes)[self.key])
            gaps = materialise(subtract_intervals(to_intervals(rows, self.key, self.seq), before, self.key), "gaps")
            data = self.log.stage()
            new = rows_in(rows, gaps, self.key, self.seq).where("in_gap").drop("in_gap").dropDuplicates()
            process(new).write.parquet(f"{data}/output")
            merge_intervals(before, gaps, self.key).write.parquet(f"{data}/intervals")
            # One column with a pushed-down filter: files without a null are not read.
            unnumbered = rows.where(F.col(self.seq).isNull()).count()
            if self.log.commit(last + 1, {"data": data, "unnumbered": unnumbered}):
                return last + 1
        raise RuntimeError(f"{attempts} commits in a row were taken by other runs")
