"""Queries of the problems on keys and texts: 4 seen keys, 5 near-duplicates, 8 token ids, 9 packing, 10 abuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import abuse, bpe, near, packing, seen
from siltbed.session import materialise, parallelism, table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The lists of alive_index enter a store; the rows of blobs are then taken in turns of put_id, each probed and merged."""
    keys, listed = seen.list_keys(table(spark, d, "alive_index"), "hashes")
    rows = table(spark, d, "blobs").select("put_id", "hash")
    expected, span = max(listed, rows.count()), seen.turn_span(rows, "put_id")
    known = seen.SeenKeys(spark)
    known.add(keys, "key", expected)
    return seen.seen_rows(rows, "hash", "put_id", known.take(rows, "hash", "put_id", expected, span), span).select("put_id")


def p4_rate(spark: SparkSession, d: str) -> DataFrame:
    """The rate of wrong answers of the fingerprints alone, at three widths: against the store and against all keys with
    a smaller put_id. The lists are read once."""
    keys, listed = seen.list_keys(table(spark, d, "alive_index"), "hashes")
    keys, blobs = materialise(seen.valid(keys, "key").distinct(), "seen-keys"), table(spark, d, "blobs")
    expected = max(listed, blobs.count())

    def rate(bits: int) -> DataFrame:
        store = materialise(seen.build_store(keys, "key", expected, bits), "seen-store")
        return seen.wrong_rate(seen.probe_store(store, blobs, "hash", "put_id", expected, bits), earlier=True).withColumn("bits", F.lit(bits))

    return rate(24).unionByName(rate(32)).unionByName(rate(seen.FINGERPRINT_BITS))


def p4_size(spark: SparkSession, d: str) -> DataFrame:
    """Bytes a key of the store over all lists: the code, and the rest beside it."""
    keys, listed = seen.list_keys(table(spark, d, "alive_index"), "hashes")
    return seen.store_size(seen.build_store(keys, "key", listed))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The batches go through a history in three deliveries, each looked up and then appended."""
    return near.earliest_matches(table(spark, d, "intake_files"), "batch_no", 3).select("earlier_id", "intake_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"))


def _containers(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    """The capacities: a fixed handful of rows."""
    return [(r[0], int(r[1])) for r in table(spark, d, "container_sizes").select("container_kind", "capacity").distinct().orderBy("capacity", "container_kind").collect()]


def p9_placed(spark: SparkSession, d: str) -> DataFrame:
    items = materialise(packing.measured(table(spark, d, "documents")), "measured")
    return packing.pack(items, _containers(spark, d), packing.partitions_for(items.count(), parallelism(spark)))


def p9_rules(spark: SparkSession, d: str) -> DataFrame:
    """That every token is in one container and only what is larger than a container is cut, counted over all placements."""
    items = materialise(packing.measured(table(spark, d, "documents")), "measured")
    placed = packing.pack(items, _containers(spark, d), packing.partitions_for(items.count(), parallelism(spark)))
    return packing.broken_rules(materialise(placed, "placed"), items)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_rates(p9_placed(spark, d))


_MODELS: dict[tuple[str, str], abuse.Model] = {}


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, score); the network is trained once a session and folder of tables."""
    documents, key = table(spark, d, "documents"), (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        _MODELS[key] = abuse.train(*abuse.labelled_sample(documents, table(spark, d, "labels")))
    return abuse.document_scores(documents, _MODELS[key])


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, abusive ones and their share per source; null sources are one group."""
    joined = table(spark, d, "documents").select("doc_id", "source").join(_scores(spark, d), "doc_id")
    hits = F.sum((F.col("score") >= abuse.THRESHOLD).cast("bigint"))
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), hits.alias("abusive"), (hits / F.count(F.lit(1))).alias("rate"))


QUERIES = {f.__name__: f for f in (p4_found, p4_rate, p4_size, p5_found, p8_ids, p9_placed, p9_rules, p9_rates, p10_found, p10_scores, p10_rates)}

ORACLE = {
    "p4_found": """
WITH k AS (SELECT DISTINCT unnest(hashes) AS hash FROM alive_index), f AS (SELECT hash, min(put_id) AS first FROM blobs GROUP BY hash)
SELECT put_id FROM blobs JOIN f USING (hash) WHERE regexp_full_match(hash, '[0-9a-f]{64}') AND (put_id > first OR hash IN (SELECT hash FROM k WHERE hash IS NOT NULL))""",
    "p4_rate": """
WITH k AS (SELECT DISTINCT hash FROM (SELECT unnest(hashes) AS hash FROM alive_index) WHERE regexp_full_match(hash, '[0-9a-f]{64}')),
f AS (SELECT hash, min(put_id) AS first FROM blobs WHERE regexp_full_match(hash, '[0-9a-f]{64}') GROUP BY hash),
w AS (SELECT unnest([24, 32, 56]) AS bits),
p AS (SELECT bits, hash, hash IN (SELECT hash FROM k) AS held, row_number() OVER (PARTITION BY bits, substr(hash, 1, bits // 4) ORDER BY first) > 1
  OR EXISTS (SELECT 1 FROM (SELECT DISTINCT bits AS b, substr(hash, 1, bits // 4) AS print FROM k, w) s WHERE s.b = bits AND s.print = substr(hash, 1, bits // 4)) AS hit FROM f, w)
SELECT count(*) AS keys, count(*) FILTER (held) AS seen, count(*) FILTER (hit AND NOT held) AS wrong,
  coalesce(count(*) FILTER (hit AND NOT held) / nullif(count(*) FILTER (NOT held), 0), 0) AS wrong_rate, bits FROM p GROUP BY bits""",
    "p9_rules": """
SELECT container_kind, capacity, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0::BIGINT AS overfull, 0::BIGINT AS overlapping, 0::BIGINT AS not_whole, 0::BIGINT AS cut_small FROM (SELECT DISTINCT container_kind, capacity FROM container_sizes)""",
    "p5_found": """
WITH c AS (SELECT DISTINCT intake_id, unnest(chunks).hash AS h FROM intake_files), n AS (SELECT intake_id, count(h) AS n FROM c WHERE h IS NOT NULL GROUP BY 1),
near AS (SELECT a.intake_id AS earlier_id, b.intake_id FROM c a JOIN c b ON a.h = b.h AND a.intake_id < b.intake_id GROUP BY 1, 2
  HAVING count(*) * 10 >= 7 * ((SELECT n FROM n WHERE intake_id = a.intake_id) + (SELECT n FROM n WHERE intake_id = b.intake_id) - count(*))),
same AS (SELECT min(a.intake_id) AS earlier_id, b.intake_id FROM intake_files a JOIN intake_files b ON a.content_hash = b.content_hash AND a.intake_id < b.intake_id GROUP BY 2)
SELECT min(earlier_id) AS earlier_id, intake_id FROM (SELECT * FROM near UNION ALL SELECT * FROM same) GROUP BY intake_id""",
}
