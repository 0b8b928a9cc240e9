"""References to records that do not exist.

References are grouped by their null mask (which of the key columns are null); each mask is anti-joined on its
non-null columns only, and the declared match semantics say what a mask means:

* ``simple``: a reference with any null column refers to nothing and is no orphan;
* ``partial``: null columns match anything, the others must agree with one target row; all null is no orphan;
* ``full``: all null is no orphan, some null is one, whatever the targets hold.

Nulls in the targets' key columns match nothing. Repeated reference rows come out as often as they went in. An empty
target table makes every checked reference an orphan; an empty reference table gives an empty result. Columns of the
references are kept as they are; the targets add none, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.session import broadcast_if_small

MATCHES = ("simple", "partial", "full")


def null_mask(keys: Sequence[str]) -> Column:
    """A string with one letter per key column: ``n`` where it is null, ``v`` where it has a value."""
    return F.concat(*[F.when(F.col(k).isNull(), "n").otherwise("v") for k in keys])


def orphan_references(
    refs: DataFrame,
    targets: DataFrame,
    keys: Sequence[tuple[str, str]],
    match: str = "simple",
    as_of: str | None = None,
    valid_from: str | None = None,
    removed_at: str | None = None,
) -> DataFrame:
    """The rows of ``refs`` whose target is missing.

    ``keys`` pairs a column of ``refs`` with one of ``targets``. With ``as_of`` (of ``refs``) and ``valid_from`` (of
    ``targets``, comparable) a target also has to exist by then, and with ``removed_at`` one must not have been removed;
    the two may be met by different rows of the same key. A null ``as_of`` is met by no target.

    Targets are reduced to one row per key before the join (partial aggregation before the shuffle), so a hot key
    multiplies nothing; the references' side of the join may be as skewed as it likes, adaptive execution splits it.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    columns = refs.columns
    ref_keys = [r for r, _ in keys]
    branches = []
    for nulls in product((False, True), repeat=len(keys)):
        held = [k for k, null in zip(keys, nulls) if not null]
        if all(nulls) or (match == "simple" and any(nulls)):
            continue
        of_mask = refs.where(reduce(lambda a, b: a & b, [F.col(r).isNull() if null else F.col(r).isNotNull() for r, null in zip(ref_keys, nulls)]))
        if match == "full" and any(nulls):
            branches.append(of_mask)
            continue
        branches.append(_anti_join(of_mask, targets, held, as_of, valid_from, removed_at).select(*columns))
    return reduce(DataFrame.unionByName, branches)


def _anti_join(refs: DataFrame, targets: DataFrame, keys, as_of, valid_from, removed_at) -> DataFrame:
    renamed = [F.col(t).alias(f"__key{i}") for i, (_, t) in enumerate(keys)]
    on = reduce(lambda a, b: a & b, [F.col(r) == F.col(f"__key{i}") for i, (r, _) in enumerate(keys)])
    known = targets.where(reduce(lambda a, b: a & b, [F.col(t).isNotNull() for _, t in keys]))
    if not (as_of or removed_at):
        return refs.join(broadcast_if_small(known.select(*renamed).distinct()), on, "left_anti")
    known = known.groupBy(*renamed).agg(
        (F.min(valid_from) if valid_from else F.lit(None)).alias("__since"),
        F.max(F.col(removed_at).isNull() if removed_at else F.lit(True)).alias("__live"),
    )
    if as_of:
        on = on & (F.col("__since") <= F.col(as_of))
    return refs.join(broadcast_if_small(known.where("__live")), on, "left_anti")


def store_references(entries: DataFrame, chunks: DataFrame, manifests: DataFrame) -> DataFrame:
    """Every reference of the store to a blob: ref_table, ref_id, hash (null for an empty one), received_at. An entry
    with chunk rows refers by these, any other by its content hash. Chunk rows of an unknown entry keep a null
    received_at. Entries are reduced to one row each; their chunks are the streamed side of the join, so that one file
    may hold any share of them."""
    when = manifests.groupBy("manifest_id").agg(F.min("received_at").alias("received_at"))
    entry = entries.where(F.col("entry_id").isNotNull()).select("entry_id", "manifest_id", F.col("content_hash").alias("hash"))
    entry = entry.join(broadcast_if_small(when), "manifest_id", "left").groupBy("entry_id").agg(F.max("hash").alias("hash"), F.min("received_at").alias("received_at"))
    of_chunks = chunks.select("entry_id", "ref_id", "hash").join(entry.select("entry_id", "received_at"), "entry_id", "left")
    whole = entry.join(chunks.select("entry_id").distinct(), "entry_id", "left_anti")
    row = lambda name, key: [F.lit(name).alias("ref_table"), F.col(key).alias("ref_id"), F.nullif("hash", F.lit("")).alias("hash"), "received_at"]
    return of_chunks.select(*row("file_chunks", "ref_id")).unionByName(whole.select(*row("manifest_files", "entry_id")))


def missing_blobs(entries: DataFrame, chunks: DataFrame, manifests: DataFrame, blobs: DataFrame) -> DataFrame:
    """References whose blob is missing, removed, or stored only after the manifest came in; each once."""
    refs = store_references(entries, chunks, manifests)
    # Seconds since 1970 as a time without zone, like received_at, whatever the session's zone is.
    stored = blobs.select("hash", F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, mod_time)").alias("mod_at"), "removed_at")
    found = orphan_references(refs, stored, [("hash", "hash")], "simple", as_of="received_at", valid_from="mod_at", removed_at="removed_at")
    return found.groupBy("ref_table", "ref_id").agg(F.min("received_at").alias("received_at"))
