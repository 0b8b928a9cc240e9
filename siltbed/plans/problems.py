"""Queries of the general problems: 1 orphan references, 2 incremental processing, 3 attribute history,
6 snapshot differences, 7 timestamps. Each callable takes (spark, folder of tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.instants import CANONICAL, InstantDictionary, normalise_instants
from siltbed.operators.history import file_versions
from siltbed.operators.incremental import pending_files, pending_intervals, processed_rows
from siltbed.operators.intervals import Ledger, across_blocks
from siltbed.operators.orphans import missing_blobs, null_mask, orphan_references
from siltbed.operators.snapdiff import snapshot_changes
from siltbed.operators.snapshots import ordered_snapshots
from siltbed.session import broadcast_if_small, scratch_path, table


def _missing(spark: SparkSession, d: str) -> DataFrame:
    return missing_blobs(table(spark, d, "manifest_files"), table(spark, d, "file_chunks"), table(spark, d, "manifests"), table(spark, d, "blobs"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _missing(spark, d).select("ref_table", F.col("ref_id").cast("bigint").alias("ref_id"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and month of arrival."""
    month = F.date_format("received_at", "yyyy-MM")
    return _missing(spark, d).groupBy("ref_table", month.alias("period")).agg(F.count(F.lit(1)).alias("orphans"))


def p1_intake(spark: SparkSession, d: str) -> DataFrame:
    """A composite key with nulls: files of the intake against stored entries of the same content and size; either may
    be null and then matches anything. Counted per null mask."""
    intake = table(spark, d, "intake_files").select("intake_id", "content_hash", "size")
    stored = table(spark, d, "manifest_files").select(F.nullif("content_hash", F.lit("")).alias("content_hash"), F.nullif("size", F.lit(0)).alias("size"))
    found = orphan_references(intake, stored, [("content_hash", "content_hash"), ("size", "size")], "partial")
    return found.groupBy(null_mask(["content_hash", "size"]).alias("mask")).agg(F.count(F.lit(1)).alias("orphans"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pending_files(table(spark, d, "files_scan"), table(spark, d, "scan_runs"), table(spark, d, "source_registry"))


def p2_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The numbers still to process, as intervals per source."""
    gaps = pending_intervals(table(spark, d, "files_scan"), table(spark, d, "scan_runs"))
    return across_blocks(gaps, "cloud_id").select("cloud_id", F.col("lo").alias("first_rev"), F.col("hi").alias("last_rev"))


def p2_committed(spark: SparkSession, d: str) -> DataFrame:
    """The numbers a ledger holds, as intervals per source, after a run over what successful runs have read and one
    over the whole scan, which commits the rest."""
    scan = table(spark, d, "files_scan")
    ledger = Ledger(spark, scratch_path(spark, "ledger"), "cloud_id", "rev")
    for rows in (processed_rows(scan, table(spark, d, "scan_runs")), scan):
        ledger.run(rows.select("cloud_id", "rev", "rel_path", "size", "mtime", "status"), lambda new: new)
    return across_blocks(ledger.processed(), "cloud_id").select("cloud_id", F.col("lo").alias("first_rev"), F.col("hi").alias("last_rev"))


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return ordered_snapshots(table(spark, d, "manifests"), table(spark, d, "source_registry"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    versions = file_versions(table(spark, d, "manifest_files"), _snapshots(spark, d))
    return versions.where("versions > 1").select("cloud_id", "path", "from_manifest_id", "to_manifest_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "manifest_files"), _snapshots(spark, d))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("change_kind").agg(F.count(F.lit(1)).alias("n"))


#: Setting with the path of a dictionary of instants that is kept from run to run; without it each run keeps its own.
DICTIONARY = "spark.siltbed.instants"


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The values of manifests enter a stored dictionary first, then those of manifest_files that it has not met."""
    zones = table(spark, d, "source_registry").groupBy("cloud_id").agg(F.max("time_zone").alias("zone"), F.max("date_locale").alias("locale"))
    manifests = table(spark, d, "manifests").select("manifest_id", "cloud_id", "ts").dropDuplicates(["manifest_id"])
    manifests = manifests.join(broadcast_if_small(zones), "cloud_id", "left")
    files = table(spark, d, "manifest_files").select("entry_id", "manifest_id", "mtime").where(~F.col("mtime").rlike(CANONICAL))
    files = files.join(broadcast_if_small(manifests.select("manifest_id", "zone", "locale")), "manifest_id", "left")
    rows = manifests.where(~F.col("ts").rlike(CANONICAL)).select(F.lit("manifests").alias("record_table"), F.col("manifest_id").alias("record_id"), F.col("ts").alias("raw"), "zone", "locale")
    more = files.select(F.lit("manifest_files").alias("record_table"), F.col("entry_id").alias("record_id"), F.col("mtime").alias("raw"), "zone", "locale")
    dictionary = InstantDictionary(spark, spark.conf.get(DICTIONARY, None) or scratch_path(spark, "instants"))
    known, later = (normalise_instants(part, "raw", "zone", "locale", dictionary=dictionary) for part in (rows, more))
    known = known.unionByName(later).where("utc_us is not null")
    return known.select("record_table", "record_id", "utc_us").dropDuplicates(["record_table", "record_id"])


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_intake, p2_found, p2_gaps, p2_committed, p3_found, p6_found, p6_report, p7_found)}

_REFS = """
WITH refs AS (
  SELECT 'manifest_files' AS ref_table, e.entry_id AS ref_id, e.content_hash AS hash, m.received_at
  FROM (SELECT DISTINCT entry_id, manifest_id, content_hash FROM manifest_files) e
  JOIN (SELECT DISTINCT manifest_id, received_at FROM manifests) m USING (manifest_id)
  WHERE e.entry_id NOT IN (SELECT entry_id FROM file_chunks WHERE entry_id IS NOT NULL)
  UNION ALL
  SELECT 'file_chunks', c.ref_id, c.hash, m.received_at
  FROM (SELECT DISTINCT ref_id, entry_id, hash FROM file_chunks) c
  JOIN (SELECT DISTINCT entry_id, manifest_id FROM manifest_files) e USING (entry_id)
  JOIN (SELECT DISTINCT manifest_id, received_at FROM manifests) m USING (manifest_id)
), missing AS (
  SELECT ref_table, ref_id, received_at FROM refs
  LEFT JOIN (SELECT hash, min(mod_time) AS since, bool_or(removed_at IS NULL) AS live FROM blobs WHERE hash IS NOT NULL GROUP BY hash) b USING (hash)
  WHERE refs.hash IS NOT NULL AND refs.hash <> '' AND NOT coalesce(live AND since * 1000000 <= epoch_us(received_at), false)
)
"""

# Instants in SQL: CTEs over raws(raw, zone, loc) that end in inst(raw, zone, loc, us). A wall time is read by the zone; the
# library takes the second of two occurrences, so the hour before is tried first, and one that does not come back is none.
_INSTANTS = r"""
shape AS (SELECT raw, zone, loc, regexp_replace(regexp_replace(trim(raw, chr(9) || chr(10) || chr(13) || ' '), '^([0-9-]{10})t', '\1T'), '([0-9])z$', '\1Z') AS t FROM raws WHERE regexp_matches(raw, '[0-9]')),
cut AS (SELECT *, regexp_extract(t, '([0-9]{1,2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]+))?(?: ([AP])M)?', ['h', 'm', 's', 'f', 'half']) AS c,
  regexp_extract(t, '(Z|[+-][0-9]{2}:?[0-9]{2}|[A-Z]{2,5})$', 1) AS tail, regexp_extract(t, '^([0-9]{4})-([0-9]{2})-([0-9]{2})[T ]', ['y', 'm', 'd']) AS ymd,
  regexp_extract(t, '^([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4}) ', ['a', 'b', 'y']) AS aby, regexp_extract(t, '^(?:[A-Z][a-z]{2}, )?([0-9]{1,2}) ([A-Z][a-z]{2}) ([0-9]{4}) ', ['d', 'm', 'y']) AS dmy,
  regexp_extract(t, '^[A-Z][a-z]{2} ([A-Z][a-z]{2}) +([0-9]{1,2}) [0-9:]{8} ([0-9]{4})$', ['m', 'd', 'y']) AS mdy, regexp_extract(t, '^([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})([0-9]{2})Z$', ['y', 'm', 'd', 'h', 'mi', 's']) AS packed FROM shape),
months AS (SELECT unnest(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']) AS name, unnest(range(1, 13)) AS num),
dated AS (SELECT cut.*, try_cast(CASE WHEN ymd.y <> '' THEN ymd.y || '-' || ymd.m || '-' || ymd.d WHEN packed.y <> '' THEN packed.y || '-' || packed.m || '-' || packed.d
  WHEN aby.y <> '' AND regexp_matches(coalesce(loc, ''), '-US$|^ja') THEN aby.y || '-' || aby.a || '-' || aby.b WHEN aby.y <> '' THEN aby.y || '-' || aby.b || '-' || aby.a
  WHEN dmy.y <> '' THEN dmy.y || '-' || (SELECT num FROM months WHERE name = dmy.m) || '-' || dmy.d WHEN mdy.y <> '' THEN mdy.y || '-' || (SELECT num FROM months WHERE name = mdy.m) || '-' || mdy.d END AS DATE) AS day,
  CASE WHEN packed.y <> '' THEN try_cast(packed.h AS INT) WHEN c.half = '' THEN try_cast(c.h AS INT) WHEN try_cast(c.h AS INT) BETWEEN 1 AND 12 THEN try_cast(c.h AS INT) % 12 + CASE WHEN c.half = 'P' THEN 12 ELSE 0 END END AS hh,
  CASE WHEN packed.y <> '' THEN try_cast(packed.mi AS INT) ELSE try_cast(c.m AS INT) END AS mm, CASE WHEN packed.y <> '' THEN try_cast(packed.s AS INT) ELSE try_cast(c.s AS INT) END AS ss FROM cut),
walled AS (SELECT *, CASE WHEN hh <= 23 AND mm <= 59 AND ss <= 59 THEN epoch_us(day::TIMESTAMP) + ((hh * 60 + mm) * 60 + ss)::BIGINT * 1000000 + rpad(left(coalesce(c.f, ''), 6), 6, '0')::BIGINT END AS wall,
  CASE WHEN tail = 'Z' OR tail IN ('UTC', 'GMT') THEN 0 WHEN regexp_matches(tail, '^[+-]') THEN (CASE WHEN tail[1:1] = '-' THEN -1 ELSE 1 END) * (try_cast(tail[2:3] AS INT) * 60 + try_cast(right(tail, 2) AS INT))
  WHEN tail NOT IN ('', 'AM', 'PM') THEN (SELECT minutes FROM (VALUES ('CET', 60), ('CEST', 120), ('BST', 60), ('EST', -300), ('EDT', -240), ('PST', -480), ('PDT', -420), ('AEST', 600), ('AEDT', 660), ('IST', 330), ('JST', 540)) v(short, minutes) WHERE short = tail) END AS away FROM dated),
placed AS (SELECT *, timezone(coalesce(zone, 'UTC'), make_timestamp(wall)) AS late FROM walled),
inst AS (SELECT raw, zone, loc, CASE WHEN regexp_full_match(t, '[0-9]+') THEN CASE WHEN try_cast(t AS BIGINT) > 100000000000000 THEN try_cast(t AS BIGINT) WHEN try_cast(t AS BIGINT) > 100000000000 THEN try_cast(t AS BIGINT) * 1000 ELSE try_cast(t AS BIGINT) * 1000000 END
  WHEN regexp_full_match(t, '[0-9]+\.[0-9]+') THEN try_cast(split_part(t, '.', 1) AS BIGINT) * 1000000 + rpad(left(split_part(t, '.', 2), 6), 6, '0')::BIGINT
  WHEN away IS NOT NULL THEN wall - away * 60000000::BIGINT WHEN tail NOT IN ('', 'AM', 'PM') THEN NULL
  WHEN timezone(coalesce(zone, 'UTC'), late - INTERVAL 1 HOUR) = make_timestamp(wall) THEN epoch_us(late - INTERVAL 1 HOUR) WHEN timezone(coalesce(zone, 'UTC'), late) = make_timestamp(wall) THEN epoch_us(late) END AS us FROM placed)"""

_ZONES = "z AS (SELECT cloud_id, max(time_zone) AS zone, max(date_locale) AS loc FROM source_registry GROUP BY 1), m AS (SELECT manifest_id, max(cloud_id) AS cloud_id, max(ts) AS ts FROM manifests WHERE manifest_id IS NOT NULL GROUP BY 1)"

_STATES = f"""
WITH {_ZONES}, e AS (SELECT DISTINCT entry_id, manifest_id, pos, regexp_replace(replace(path, '\\', '/'), '^/', '') AS path, content_hash, mtime, coalesce(status, '') IN ('locked', 'error') AS lost FROM manifest_files WHERE path IS NOT NULL),
raws AS (SELECT DISTINCT raw, zone, loc FROM (SELECT ts AS raw, zone, loc FROM m LEFT JOIN z USING (cloud_id) UNION ALL SELECT mtime, zone, loc FROM e JOIN m USING (manifest_id) LEFT JOIN z USING (cloud_id))), {_INSTANTS},
snaps AS (SELECT manifest_id, cloud_id, z.zone, z.loc, row_number() OVER (PARTITION BY cloud_id ORDER BY us NULLS FIRST, manifest_id) AS k, count(*) OVER (PARTITION BY cloud_id) AS n
  FROM m LEFT JOIN z USING (cloud_id) LEFT JOIN inst i ON i.raw = m.ts AND i.zone IS NOT DISTINCT FROM z.zone AND i.loc IS NOT DISTINCT FROM z.loc),
won AS (SELECT s.cloud_id, s.k, s.n, e.path, e.lost, e.content_hash AS h, i.us FROM e JOIN snaps s USING (manifest_id) LEFT JOIN inst i ON i.raw = e.mtime AND i.zone IS NOT DISTINCT FROM s.zone AND i.loc IS NOT DISTINCT FROM s.loc
  QUALIFY row_number() OVER (PARTITION BY e.manifest_id, e.path ORDER BY e.pos DESC, e.entry_id DESC) = 1),
kept AS (SELECT *, last_value(CASE WHEN NOT lost THEN {{'h': h, 'us': us}} END IGNORE NULLS) OVER (PARTITION BY cloud_id, path ORDER BY k ROWS UNBOUNDED PRECEDING) AS r FROM won),
st AS (SELECT cloud_id, k, n, path, CASE WHEN lost AND r IS NOT NULL THEN r.h ELSE h END AS h, CASE WHEN lost AND r IS NOT NULL THEN r.us ELSE us END AS us FROM kept)"""

_CHANGES = _STATES + """, changes AS (
SELECT a.cloud_id, a.k, a.path, CASE WHEN b.path IS NULL THEN 'added' ELSE 'changed' END AS change_kind FROM st a LEFT JOIN st b ON a.cloud_id = b.cloud_id AND a.path = b.path AND b.k = a.k - 1 WHERE a.k > 1 AND (b.path IS NULL OR a.h IS DISTINCT FROM b.h)
UNION ALL SELECT b.cloud_id, b.k + 1, b.path, 'removed' FROM st b LEFT JOIN st a ON a.cloud_id = b.cloud_id AND a.path = b.path AND a.k = b.k + 1 WHERE b.k < b.n AND a.path IS NULL)"""

ORACLE = {
    "p1_found": _REFS + "SELECT ref_table, ref_id FROM missing",
    "p1_report": _REFS + "SELECT ref_table, strftime(received_at, '%Y-%m') AS period, count(*) AS orphans FROM missing GROUP BY ALL",
    "p1_intake": """
WITH t AS (SELECT DISTINCT nullif(content_hash, '') AS h, nullif(size, 0) AS z FROM manifest_files)
SELECT CASE WHEN content_hash IS NULL THEN 'n' ELSE 'v' END || CASE WHEN size IS NULL THEN 'n' ELSE 'v' END AS mask, count(*) AS orphans FROM intake_files
WHERE CASE WHEN content_hash IS NULL AND size IS NULL THEN false WHEN content_hash IS NULL THEN size NOT IN (SELECT z FROM t WHERE z IS NOT NULL)
WHEN size IS NULL THEN content_hash NOT IN (SELECT h FROM t WHERE h IS NOT NULL) ELSE (content_hash, size) NOT IN (SELECT (h, z) FROM t WHERE h IS NOT NULL AND z IS NOT NULL) END GROUP BY 1""",
    "p2_found": f"""
WITH {_ZONES}, f AS (SELECT s.*, coalesce(arrived_at <= reach, false) AS done FROM files_scan s LEFT JOIN (SELECT cloud_id, max(cutoff_at) AS reach FROM scan_runs WHERE outcome = 'ok' GROUP BY 1) USING (cloud_id)
  WHERE coalesce(status, '') NOT IN ('locked', 'error') AND rel_path IS NOT NULL AND rev IS NOT NULL),
raws AS (SELECT DISTINCT mtime AS raw, zone, loc FROM f LEFT JOIN z USING (cloud_id)), {_INSTANTS},
t AS (SELECT f.cloud_id, f.rel_path, f.rev, f.size, f.mtime, f.done, i.us FROM f LEFT JOIN z USING (cloud_id) LEFT JOIN inst i ON i.raw = f.mtime AND i.zone IS NOT DISTINCT FROM z.zone AND i.loc IS NOT DISTINCT FROM z.loc),
now AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY cloud_id, rel_path ORDER BY rev DESC, size DESC NULLS LAST, mtime DESC NULLS LAST) = 1),
was AS (SELECT * FROM t WHERE done QUALIFY row_number() OVER (PARTITION BY cloud_id, rel_path ORDER BY rev DESC, size DESC NULLS LAST, mtime DESC NULLS LAST) = 1)
SELECT now.cloud_id, now.rel_path FROM now LEFT JOIN was ON now.cloud_id IS NOT DISTINCT FROM was.cloud_id AND now.rel_path = was.rel_path
WHERE was.rel_path IS NULL OR now.size IS DISTINCT FROM was.size OR now.us IS DISTINCT FROM was.us""",
    "p2_committed": """
SELECT cloud_id, min(rev) AS first_rev, max(rev) AS last_rev FROM (SELECT cloud_id, rev, rev - row_number() OVER (PARTITION BY cloud_id ORDER BY rev) AS run FROM (SELECT DISTINCT cloud_id, rev FROM files_scan WHERE rev IS NOT NULL)) GROUP BY cloud_id, run""",
    "p3_found": _STATES + """,
steps AS (SELECT *, CASE WHEN lag(k) OVER w = k - 1 AND lag(h) OVER w IS NOT DISTINCT FROM h AND lag(us) OVER w IS NOT DISTINCT FROM us THEN 0 ELSE 1 END AS fresh FROM st WINDOW w AS (PARTITION BY cloud_id, path ORDER BY k)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY cloud_id, path ORDER BY k) AS run FROM steps),
spans AS (SELECT cloud_id, path, min(k) AS lo, max(k) AS hi, count(*) OVER (PARTITION BY cloud_id, path) AS versions FROM runs GROUP BY cloud_id, path, run)
SELECT v.cloud_id, path, a.manifest_id AS from_manifest_id, coalesce(b.manifest_id, 0) AS to_manifest_id FROM spans v JOIN snaps a ON a.cloud_id = v.cloud_id AND a.k = v.lo LEFT JOIN snaps b ON b.cloud_id = v.cloud_id AND b.k = v.hi + 1 WHERE versions > 1""",
    "p6_found": _CHANGES + " SELECT s.manifest_id, path, change_kind FROM changes c JOIN snaps s USING (cloud_id, k)",
    "p6_report": _CHANGES + " SELECT change_kind, count(*) AS n FROM changes GROUP BY 1",
    "p7_found": f"""
WITH {_ZONES}, v AS (SELECT 'manifests' AS record_table, manifest_id AS record_id, ts AS raw, zone, loc FROM m LEFT JOIN z USING (cloud_id)
  UNION ALL SELECT DISTINCT 'manifest_files', entry_id, mtime, zone, loc FROM manifest_files LEFT JOIN m USING (manifest_id) LEFT JOIN z USING (cloud_id)),
raws AS (SELECT DISTINCT raw, zone, loc FROM v), {_INSTANTS}
SELECT record_table, record_id, us AS utc_us FROM v JOIN inst i ON i.raw = v.raw AND i.zone IS NOT DISTINCT FROM v.zone AND i.loc IS NOT DISTINCT FROM v.loc
WHERE us IS NOT NULL AND NOT regexp_full_match(v.raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z')""",
    "p2_gaps": """
WITH seen AS (SELECT s.cloud_id, s.rev, bool_or(coalesce(s.arrived_at <= r.reach, false)) AS done FROM files_scan s
  LEFT JOIN (SELECT cloud_id, max(cutoff_at) AS reach FROM scan_runs WHERE outcome = 'ok' GROUP BY 1) r USING (cloud_id) GROUP BY 1, 2)
SELECT cloud_id, min(rev) AS first_rev, max(rev) AS last_rev FROM (
  SELECT cloud_id, rev, rev - row_number() OVER (PARTITION BY cloud_id ORDER BY rev) AS run FROM seen WHERE NOT done)
GROUP BY cloud_id, run""",
}
