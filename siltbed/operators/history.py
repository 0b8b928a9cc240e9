"""History of changing attributes: a change log per attribute, each with its own validity intervals, combined by
splitting at the union of their borders and coalescing what is equal again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.instants import normalise_instants
from siltbed.operators.snapshots import entries_of, states_of
from siltbed.session import broadcast_if_small, materialise, parallelism


def attribute_log(states: DataFrame, key: list[str], at: str, attributes: list[str], carry: list[str] = ()) -> DataFrame:
    """(key, attribute, value, from_at, to_at): for each attribute the stretches of consecutive ``at`` over which its
    value stays the same (two nulls are equal). ``at`` must be unique within the key; a number that is missing ends
    every stretch. ``to_at`` is the first number after the stretch. ``carry`` columns belong to the key."""
    order = Window.partitionBy(*key).orderBy(at)
    before = states.withColumns({"__gap": F.coalesce(F.lag(at).over(order) != F.col(at) - 1, F.lit(True)), **{f"__was_{a}": F.lag(a).over(order) for a in attributes}})
    begins = {a: F.col("__gap") | ~F.col(a).eqNullSafe(F.col(f"__was_{a}")) for a in attributes}
    closes = F.coalesce(F.lead(at).over(order) != F.col(at) + 1, F.lit(True))
    events = before.withColumn("__closes", closes).select(
        *key, *carry, F.col(at).alias("from_at"), "__closes",
        F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value"), begins[a].alias("begins")) for a in attributes])).alias("__e"),
    ).select(*key, *carry, "from_at", "__closes", "__e.*").where("begins or __closes")
    of_attribute = Window.partitionBy(*key, "attribute").orderBy("from_at")
    # An event that closes ends at its own next number; one that only begins ends where the next event begins, and a
    # stretch that begins and closes apart is one: the beginning takes the closing event's end.
    end = F.when(F.col("__closes"), F.col("from_at") + 1).otherwise(F.when(F.lead("begins").over(of_attribute), F.lead("from_at").over(of_attribute)).otherwise(F.lead("from_at").over(of_attribute) + 1))
    return events.withColumn("to_at", end).where("begins").drop("begins", "__closes")


def combine_logs(log: DataFrame, key: list[str], attributes: list[str], carry: list[str] = ()) -> DataFrame:
    """(key, from_at, to_at, one column per attribute): the log's intervals split at the union of their borders, then
    coalesced while they touch and no attribute differs. Stretches without any attribute do not come out."""
    marks = log.select(
        *key, *carry,
        F.explode(F.array(F.struct(F.col("from_at").alias("at"), F.lit(True).alias("opens"), "attribute", "value"), F.struct(F.col("to_at").alias("at"), F.lit(False).alias("opens"), "attribute", F.lit(None).cast("string").alias("value")))).alias("__m"),
    ).select(*key, *carry, "__m.*")
    held = [F.max(F.when(F.col("attribute") == a, F.struct("opens", "value"))).alias(f"__{a}") for a in attributes]
    borders = marks.groupBy(*key, *carry, "at").agg(*held)
    order = Window.partitionBy(*key).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = borders.select(*key, *carry, F.col("at").alias("from_at"), F.lead("at").over(order).alias("to_at"), *[F.last(f"__{a}", ignorenulls=True).over(so_far).alias(f"__{a}") for a in attributes])
    spans = spans.withColumn("__all", F.struct(*[f"__{a}" for a in attributes])).where(F.col("to_at").isNotNull() & F.greatest(*[F.coalesce(F.col(f"__{a}.opens"), F.lit(False)) for a in attributes], F.lit(False)))
    after = Window.partitionBy(*key).orderBy("from_at")
    same = (F.lag("to_at").over(after) == F.col("from_at")) & F.lag("__all").over(after).eqNullSafe(F.col("__all"))
    runs = spans.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(after))
    return runs.groupBy(*key, *carry, "__run").agg(F.min("from_at").alias("from_at"), F.max("to_at").alias("to_at"), *[F.first(f"__{a}.value").alias(a) for a in attributes]).drop("__run")


def file_versions(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every version of every file: cloud_id, path, content_hash, mtime_us, from_manifest_id, to_manifest_id (0: none
    after it), versions (how many the file has). Unreadable mtimes are equal to each other and come out as null."""
    entries = entries_of(files, snapshots)
    entries = entries.repartition(parallelism(entries.sparkSession), "cloud_id", "path")
    key, carry = ["cloud_id", "path"], ["last_snap", "zone", "locale"]
    log = materialise(attribute_log(states_of(entries), key, "snap", ["content_hash", "mtime"], carry), "change-log")
    times = normalise_instants(log.where("attribute = 'mtime'"), "value", "zone", "locale", "__us")
    log = log.where("attribute <> 'mtime'").unionByName(times.withColumn("value", F.col("__us").cast("string")).drop("__us"))
    versions = combine_logs(log, key, ["content_hash", "mtime"], carry)
    counted = versions.withColumn("versions", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    ids = broadcast_if_small(snapshots.select("snap", "manifest_id"))
    named = counted.join(ids.select(F.col("snap").alias("from_at"), F.col("manifest_id").alias("from_manifest_id")), "from_at")
    named = named.join(ids.select(F.col("snap").alias("to_at"), F.col("manifest_id").alias("__to")), "to_at", "left")
    return named.select(*key, "content_hash", F.col("mtime").cast("bigint").alias("mtime_us"), "from_manifest_id", F.when(F.col("to_at") <= F.col("last_snap"), F.col("__to")).otherwise(F.lit(0).cast("bigint")).alias("to_manifest_id"), "versions")
