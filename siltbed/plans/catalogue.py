"""Queries of the snapshot engine's own operators, each over its whole tables, with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.functions import codecs, frames
from siltbed.functions.instants import flexible_text, number_micros, rfc3339_micros
from siltbed.functions.paths import ancestors, cloud_key, is_cloud_id, is_dense, is_hash, safe_relative, toggle_leading_dot
from siltbed.operators import chunking, predicates, snapshot, store
from siltbed.operators.snapshots import normal_path
from siltbed.session import broadcast_if_small, scratch_path, table
from siltbed.sources import manifests as mf
from siltbed.streaming.intake import windowed_counts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# ---- inputs ---------------------------------------------------------------------------------------------------

_ENT = r"""ent AS (SELECT DISTINCT entry_id, manifest_id, pos, regexp_replace(replace(path, '\', '/'), '^/', '') AS path, content_hash, size, mtime, mode, status FROM manifest_files)"""
_PATHS = f"{_ENT}, paths AS (SELECT DISTINCT path FROM ent)"
_LAST = f"""{_ENT}, man AS (SELECT cloud_id, manifest_id, row_number() OVER (PARTITION BY cloud_id ORDER BY manifest_id DESC) AS back FROM (SELECT DISTINCT cloud_id, manifest_id FROM manifests)),
won AS (SELECT man.cloud_id || ':' || path AS path, back, content_hash, size, mtime, status, row_number() OVER (PARTITION BY manifest_id, path ORDER BY pos DESC) AS nth FROM ent JOIN man USING (manifest_id) WHERE back <= 2),
cur AS (SELECT * FROM won WHERE back = 1 AND nth = 1), prev AS (SELECT * FROM won WHERE back = 2 AND nth = 1)"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "manifest_files").select("entry_id", "manifest_id", "pos", normal_path(F.col("path")).alias("path"), "content_hash", "size", "mtime", "mode", "status")
    return rows.distinct()


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest_files").select(normal_path(F.col("path")).alias("path")).distinct()


def _last_two(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each source's latest manifest (back 1) and the one before it (back 2), by order of arrival. The join
    with these few manifests comes first; repeated rows fall together in whatever aggregates them."""
    order = Window.partitionBy("cloud_id").orderBy(F.desc("manifest_id"))
    last = table(spark, d, "manifests").select("cloud_id", "manifest_id").distinct().withColumn("back", F.row_number().over(order)).where("back <= 2")
    rows = table(spark, d, "manifest_files").select("manifest_id", "pos", normal_path(F.col("path")).alias("path"), "content_hash", "size", "mtime", "status")
    return rows.join(broadcast_if_small(last), "manifest_id").withColumn("path", F.concat("cloud_id", F.lit(":"), "path"))


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The two as tables of one row per source and path."""
    won = _last_two(spark, d).groupBy("path", "back").agg(F.max(F.struct("pos", "content_hash", "size", "mtime", "status")).alias("e")).select("path", "back", "e.*")
    return won.where("back = 1").drop("back", "pos"), won.where("back = 2").drop("back", "pos")


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.classify_pairs(_last_two(spark, d), ["path"])


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source", "file_path")


# ---- predicates -----------------------------------------------------------------------------------------------


@query(f"WITH {_PATHS} SELECT path FROM paths WHERE regexp_matches(path, '(^|/)[^/]*\\.md$') OR regexp_matches(path, '(^|/)index[^/][^/]*$')")
def exclude_glob_suffix(spark, d):
    return _paths(spark, d).where(predicates.is_excluded(F.col("path"), ["*.md", "index?*"]))


@query(f"WITH {_PATHS} SELECT path FROM paths WHERE path = 'docs' OR path LIKE 'docs/%' OR path LIKE '%/docs/%' OR path LIKE '%/docs' OR path LIKE 'lab/%' OR path LIKE '%/lab/%'")
def exclude_dir_prefix(spark, d):
    return _paths(spark, d).where(predicates.is_excluded(F.col("path"), ["docs", "lab/"]))


@query(f"WITH {_PATHS} SELECT path FROM paths WHERE path LIKE '2023/%' OR path LIKE '%/2023/%' OR regexp_matches(path, '(^|/)draft[^/]*$') OR regexp_matches(path, '^archive/(.*/)?raw/') OR regexp_matches(path, '^archive/(.*/)?raw$') OR regexp_matches(path, '^.+/archive[^/]*/(.*/)?raw(/|$)')")
def exclude_globstar(spark, d):
    return _paths(spark, d).where(predicates.is_excluded(F.col("path"), ["2023/**", "**/draft*", "archive/**/raw"]))


@query(f"WITH {_PATHS} SELECT path FROM paths WHERE (regexp_matches(path, '(^|/)[^/]*\\.log$') OR path LIKE 'mail/%' OR path LIKE '%/mail/%') AND NOT regexp_matches(path, '(^|/)readme[^/]*$')")
def exclude_with_negation(spark, d):
    return _paths(spark, d).where(predicates.is_excluded(F.col("path"), ["*.log", "mail/"], ["readme*"]))


@query(f"WITH {_PATHS} SELECT path FROM paths WHERE regexp_matches(path, '(^|/)raw/') AND NOT path LIKE 'archive/%'")
def skip_dir_subtree(spark, d):
    return _paths(spark, d).where(predicates.under_skipped(F.col("path"), ["raw"], ["archive"]))


@query(f"WITH {_PATHS} SELECT path FROM paths WHERE path LIKE '%/notes' OR path = 'notes' OR path LIKE '%/notes/%' OR starts_with(path, '**/notes') OR path LIKE 'data/%' OR path = 'data' OR (starts_with(path, 'a') AND ends_with(path, '.txt')) OR regexp_matches(path, '(^|/)[^/]*\\.ini$') OR starts_with(path, 'al')")
def legacy_match_exclude(spark, d):
    return _paths(spark, d).where(predicates.match_exclude(F.col("path"), ["**/notes", "data/**", "a**.txt", "*.ini", "al"]))


@query(f"WITH {_ENT} SELECT entry_id, size FROM ent WHERE size > 10485760 OR size <= 512")
def size_filter(spark, d):
    _, _, sizes = predicates.split_excludes(["size:>10MB", "size:<=512b"])
    return _entries(spark, d).where(predicates.size_excluded(F.col("size"), sizes)).select("entry_id", "size")


@query("SELECT source_id, array_to_string(list_sort(list_distinct(list_concat(string_split(path, '/'), [device_id, cloud_id, device_id]))), '|') AS merged FROM source_registry")
def merge_excludes(spark, d):
    merged = predicates.merge_excludes_column(F.split("path", "/"), F.array("device_id", "cloud_id", "device_id"))
    return table(spark, d, "source_registry").select("source_id", F.array_join(F.array_sort(merged), "|").alias("merged"))


# Extensions of content that is compressed already.
_DENSE = (
    "jpg jpeg png gif bmp tiff tif webp heic heif avif ico raw cr2 nef orf arw dng rw2 psd psb mp4 avi mkv mov wmv "
    "flv webm m4v mpg mpeg 3gp 3g2 ts mts vob m2ts rm rmvb mp3 aac flac ogg wma m4a wav opus aiff alac amr ape wv "
    "tta zip zipx rar rar5 7z gz bz2 xz zst lz4 tar tgz lz lzma br sz cab arj ace lha lzh arc uha kgb z zz sit sitx "
    "brotli iso dmg img bin nrg mdf mds ccd sub vmdk vdi vhd vhdx qcow2 qcow qed ova ovf xva wim esd squashfs cramfs "
    "gho tib tibx vbk vib adi fbk sna pdf docx xlsx pptx odt ods odp doc xls ppt epub mobi azw3 cbr cbz exe dll so "
    "dylib jar war apk ipa deb rpm pkg msi app appx msix nupkg"
)


@query(f"WITH {_PATHS} SELECT path, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\\.([^.]*)$', 1)) IN (SELECT unnest(string_split('{_DENSE}', ' '))) AS dense FROM paths")
def incompressible_flag(spark, d):
    return _paths(spark, d).select("path", is_dense(F.col("path")).alias("dense"))


@query("SELECT put_id, coalesce(regexp_full_match(hash, '[0-9a-f]{64}'), false) AS ok FROM blobs")
def valid_hash_filter(spark, d):
    return table(spark, d, "blobs").select("put_id", is_hash(F.col("hash")).alias("ok"))


@query(r"""SELECT source_id, id, NOT (starts_with(id, '/') OR starts_with(id, '\') OR (id[2:2] = ':' AND regexp_matches(id[1:1], '[A-Za-z]')) OR list_contains(list_transform(string_split_regex(id, '[/\\]'), lambda x: trim(x)), '..')) AS ok, coalesce(path <> '' AND NOT regexp_matches(path, '^[/\\]') AND NOT regexp_matches(path, '^[A-Za-z]:')
AND NOT regexp_matches(path, '(^|[/\\]) *\.\. *([/\\]|$)'), false) AS path_ok FROM (SELECT source_id, path, CASE WHEN coalesce(device_id, '') = '' THEN cloud_id ELSE device_id || '/' || cloud_id END AS id FROM source_registry)""")
def valid_cloud_id(spark, d):
    key = cloud_key(F.col("device_id"), F.col("cloud_id"))
    return table(spark, d, "source_registry").select("source_id", key.alias("id"), is_cloud_id(key).alias("ok"), is_cloud_id(F.col("path")).alias("path_ok"))


@query(r"""SELECT DISTINCT path, CASE WHEN path IS NULL OR path = '' OR starts_with(replace(path, '\', '/'), '/') OR regexp_matches(path, '^[A-Za-z]:') THEN NULL ELSE replace(path, '\', '/') END AS clean FROM manifest_files""")
def safe_path_filter(spark, d):
    return table(spark, d, "manifest_files").select("path", safe_relative(F.col("path")).alias("clean")).distinct()


@query(f"WITH {_PATHS} SELECT path, CASE WHEN path = '' THEN path WHEN starts_with(path, '.') THEN substr(path, 2) ELSE '.' || path END AS toggled FROM paths")
def toggle_dot(spark, d):
    return _paths(spark, d).select("path", toggle_leading_dot(F.col("path")).alias("toggled"))


# ---- snapshots ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS hash, octet_length(encode(text)) AS bytes FROM documents")
def content_hash(spark, d):
    data = F.col("text").cast("binary")
    return _documents(spark, d).select("doc_id", F.sha2(data, 256).alias("hash"), F.octet_length(data).cast("bigint").alias("bytes"))


_CLASSES = f"""WITH {_LAST}, cls AS (SELECT coalesce(c.path, p.path) AS path, CASE WHEN c.path IS NULL THEN 'deleted' WHEN p.path IS NULL THEN 'new'
WHEN c.content_hash IS DISTINCT FROM p.content_hash THEN 'changed' ELSE 'unchanged' END AS status, coalesce(c.size, p.size) AS size FROM cur c FULL JOIN prev p ON c.path = p.path)"""


@query(_CLASSES + " SELECT status, count(*) AS files, sum(size)::BIGINT AS bytes FROM cls GROUP BY status")
def snapshot_diff(spark, d):
    return snapshot.status_counts(_classified(spark, d))


@query(_CLASSES + " SELECT path, status, size FROM cls")
def snapshot_status_rows(spark, d):
    return snapshot.classify(*_snapshots(spark, d)).select("path", "status", "size")


@query(_CLASSES + """ SELECT count(*) FILTER (status <> 'deleted') AS file_count, coalesce(sum(size) FILTER (status <> 'deleted'), 0)::BIGINT AS total_size, count(*) FILTER (status = 'new') AS new_files,
count(*) FILTER (status = 'changed') AS changed_files, count(*) FILTER (status = 'unchanged') AS unchanged_files, count(*) FILTER (status = 'deleted') AS deleted_files,
coalesce(sum(size) FILTER (status IN ('new', 'changed')), 0)::BIGINT AS new_bytes, coalesce(count(*) FILTER (status = 'unchanged') / nullif(count(*) FILTER (status <> 'deleted'), 0), 0) AS dedup_ratio FROM cls""")
def manifest_stats(spark, d):
    return snapshot.snapshot_stats(_classified(spark, d))


@query(f"WITH {_LAST} SELECT c.path FROM cur c JOIN prev p ON c.path = p.path WHERE c.mtime = p.mtime AND c.size = p.size AND length(p.content_hash) >= 2")
def fast_path_unchanged(spark, d):
    return snapshot.two_phase(*_snapshots(spark, d))[0].select("path")


@query(f"WITH {_LAST} SELECT path, size FROM prev WHERE path NOT IN (SELECT path FROM cur)")
def deleted_files(spark, d):
    return snapshot.deleted(*_snapshots(spark, d)).select("path", "size")


@query(f"WITH {_LAST} SELECT c.path, CASE WHEN p.path IS NULL THEN 'new' WHEN coalesce(p.content_hash, '') <> coalesce(c.content_hash, '') THEN 'changed' ELSE 'unchanged' END AS status FROM cur c LEFT JOIN prev p ON c.path = p.path WHERE p.path IS NOT NULL AND coalesce(p.content_hash, '') = ''")
def failed_prev_becomes_changed(spark, d):
    now, before = _snapshots(spark, d)
    failed = before.where(F.coalesce("content_hash", F.lit("")) == "").select("path", F.lit("").alias("was"))
    joined = now.join(failed, "path")
    return joined.select("path", snapshot.status_of(F.lit(True), F.coalesce("content_hash", F.lit("")), F.col("was")).alias("status"))


@query("SELECT cloud_id, count(*) AS files, sum(size)::BIGINT AS bytes FROM (SELECT DISTINCT * FROM files_scan) WHERE NOT is_dir GROUP BY cloud_id")
def source_total_size(spark, d):
    rows = table(spark, d, "files_scan").distinct().where("not is_dir")
    return rows.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query(f"""WITH RECURSIVE {_PATHS}, up(dir) AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM paths UNION SELECT regexp_extract(dir, '^(.*)/[^/]*$', 1) FROM up WHERE dir <> ''),
kept(dir) AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM paths WHERE NOT regexp_matches(path, '\\.(pdf|jpg|md|go|tar)$') UNION SELECT regexp_extract(dir, '^(.*)/[^/]*$', 1) FROM kept WHERE dir <> ''),
parents AS (SELECT regexp_extract(dir, '^(.*)/[^/]*$', 1) AS dir FROM up WHERE dir <> '')
SELECT dir FROM up WHERE dir <> '' AND dir NOT IN (SELECT dir FROM kept) AND dir NOT IN (SELECT dir FROM parents)""")
def empty_dirs(spark, d):
    """Directories of all paths that an exclusion leaves without a file; a kept child directory keeps its parent."""
    paths = _paths(spark, d)
    dirs = paths.select(F.explode(ancestors(F.col("path"))).alias("rel_path"), F.lit(True).alias("is_dir")).where("rel_path <> ''")
    kept = paths.where(~predicates.is_excluded(F.col("path"), ["*.pdf", "*.jpg", "*.md", "*.go", "*.tar"])).select(F.col("path").alias("rel_path"), F.lit(False).alias("is_dir"))
    return snapshot.empty_directories(dirs.unionByName(kept))


@query(f"""WITH RECURSIVE {_PATHS}, up(dir) AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM paths UNION SELECT regexp_extract(dir, '^(.*)/[^/]*$', 1) FROM up WHERE dir <> ''),
f AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS files FROM paths GROUP BY 1), s AS (SELECT regexp_extract(dir, '^(.*)/[^/]*$', 1) AS dir, count(*) AS subdirs FROM up WHERE dir <> '' GROUP BY 1)
SELECT dir, coalesce(files, 0) AS files, coalesce(subdirs, 0) AS subdirs FROM up LEFT JOIN f USING (dir) LEFT JOIN s USING (dir)""")
def dir_tree_children(spark, d):
    return snapshot.directory_children(_paths(spark, d))


# ---- chunks and store -----------------------------------------------------------------------------------------

_CHUNKS = """chunks AS (SELECT doc_id, i AS seq, substr(hx, 2048 * i + 1, 2048) AS h FROM (SELECT doc_id, hex(encode(text)) AS hx, unnest(range(0, (octet_length(encode(text)) + 1023) // 1024)) AS i FROM documents WHERE text IS NOT NULL))"""
_BLOBLIST = "stored AS (SELECT hash FROM blobs WHERE hash IS NOT NULL GROUP BY hash HAVING bool_or(removed_at IS NULL))"


def _chunks(spark, d):
    return chunking.fixed_chunks(_documents(spark, d), "doc_id", "text", 1024)


def _stored(spark, d):
    return table(spark, d, "blobs").where("hash is not null").groupBy("hash").agg(F.max(F.col("removed_at").isNull()).alias("live")).where("live").select("hash")


@query(f"WITH {_CHUNKS} SELECT doc_id, seq::INT AS seq, 1024 * seq AS chunk_offset, length(h) // 2 AS size, sha256(unhex(h)) AS hash FROM chunks")
def fixed_chunks(spark, d):
    return _chunks(spark, d)


@query(f"WITH {_CHUNKS} SELECT count(*) AS chunks, sum(length(h) // 2)::BIGINT AS bytes, count(DISTINCT h) AS distinct_chunks, max(length(h) // 2) AS largest FROM chunks")
def chunk_size_stats(spark, d):
    return _chunks(spark, d).agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("bytes"), F.countDistinct("hash").alias("distinct_chunks"), F.max("size").alias("largest"))


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, CASE WHEN octet_length(encode(text)) >= 4096 THEN 'chunked' ELSE 'whole' END AS route FROM documents WHERE text IS NOT NULL")
def chunk_route(spark, d):
    size = F.octet_length("text").cast("bigint")
    return _documents(spark, d).where("text is not null").select("doc_id", size.alias("bytes"), chunking.route(size, 4096).alias("route"))


@query(f"WITH {_BLOBLIST} SELECT hash, min(intake_id) AS intake_id FROM (SELECT content_hash AS hash, intake_id FROM intake_files WHERE regexp_full_match(content_hash, '[0-9a-f]{{64}}')) WHERE hash NOT IN (SELECT hash FROM stored) GROUP BY hash")
def dedup_new_blobs(spark, d):
    wanted = table(spark, d, "intake_files").select(F.col("content_hash").alias("hash"), "intake_id")
    return store.new_blobs(wanted, _stored(spark, d)).select("hash", "intake_id")


@query("SELECT content_hash, count(*) AS copies, sum(size)::BIGINT AS bytes FROM intake_files WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1")
def duplicate_content_groups(spark, d):
    return table(spark, d, "intake_files").where("content_hash is not null").groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("bytes")).where("copies > 1")


@query("SELECT cloud_id, coalesce(count(*) FILTER (status = 'unchanged') / nullif(count(*) FILTER (status IN ('new', 'changed', 'unchanged')), 0), 0) AS ratio FROM (SELECT DISTINCT * FROM files_scan) GROUP BY cloud_id")
def dedup_ratio(spark, d):
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return table(spark, d, "files_scan").distinct().groupBy("cloud_id").agg(F.coalesce(of("unchanged") / F.nullif(of("new", "changed", "unchanged"), F.lit(0)), F.lit(0.0)).alias("ratio"))


_REFS = f"""{_ENT}, ch AS (SELECT DISTINCT ref_id, entry_id, seq, hash, size FROM file_chunks), refs AS (SELECT hash FROM ch WHERE hash <> ''
UNION ALL SELECT content_hash FROM ent WHERE content_hash <> '' AND entry_id NOT IN (SELECT entry_id FROM ch))"""


def _references(spark, d):
    chunks = table(spark, d, "file_chunks").select("ref_id", "entry_id", "hash").distinct()
    entries = table(spark, d, "manifest_files").select("entry_id", "content_hash").distinct()
    return store.row_references(entries, chunks.select("entry_id", "hash"), "entry_id")


@query(f"WITH {_REFS} SELECT DISTINCT hash FROM refs")
def alive_hashes_set(spark, d):
    return _references(spark, d).distinct()


@query(f"WITH {_REFS} SELECT hash, count(*) AS refs FROM refs GROUP BY hash")
def alive_hashes_multiset(spark, d):
    return _references(spark, d).groupBy("hash").agg(F.count(F.lit(1)).alias("refs"))


@query(f"WITH {_REFS}, {_BLOBLIST} SELECT hash FROM stored WHERE hash NOT IN (SELECT hash FROM refs)")
def garbage_blobs(spark, d):
    return store.garbage(_stored(spark, d), _references(spark, d))


@query(f"WITH {_BLOBLIST} SELECT entry_id, bool_and(hash IS NOT NULL AND hash IN (SELECT hash FROM stored)) AS present FROM (SELECT DISTINCT ref_id, entry_id, hash FROM file_chunks) GROUP BY entry_id")
def all_chunks_present(spark, d):
    return store.all_present(table(spark, d, "file_chunks").select("ref_id", "entry_id", "hash").distinct(), _stored(spark, d), "entry_id")


_CUTS = f"""{_ENT}, m AS (SELECT DISTINCT cloud_id, manifest_id FROM manifests), b AS (SELECT cloud_id, manifest_id, row_number() OVER (PARTITION BY cloud_id ORDER BY manifest_id DESC) AS back FROM m),
c AS (SELECT DISTINCT b.back, b.cloud_id || ':' || ent.path AS path, f.hash, f.size FROM (SELECT DISTINCT ref_id, entry_id, hash, size FROM file_chunks) f JOIN ent USING (entry_id) JOIN b USING (manifest_id) WHERE b.back <= 2)"""


@query(f"WITH {_CUTS} SELECT path, hash, size FROM c WHERE back = 1 AND NOT EXISTS (SELECT 1 FROM c p WHERE p.back = 2 AND p.path = c.path AND p.hash = c.hash)")
def changed_chunks_upload(spark, d):
    order = Window.partitionBy("cloud_id").orderBy(F.desc("manifest_id"))
    last = table(spark, d, "manifests").select("cloud_id", "manifest_id").distinct().withColumn("back", F.row_number().over(order)).where("back <= 2")
    entries = _entries(spark, d).select("entry_id", "manifest_id", "path").join(broadcast_if_small(last), "manifest_id")
    chunks = table(spark, d, "file_chunks").select("entry_id", "hash", "size").join(entries, "entry_id")
    chunks = chunks.select("back", F.concat("cloud_id", F.lit(":"), "path").alias("path"), "hash", "size").distinct()
    return store.changed_chunks(chunks.where("back = 1").drop("back"), chunks.where("back = 2"), "path")


@query("SELECT put_id, hash FROM blobs WHERE regexp_full_match(hash, '[0-9a-f]{64}') AND starts_with(hash[1:2], 'b')")
def blob_list_prefix(spark, d):
    return store.list_blobs(table(spark, d, "blobs").select("put_id", "hash"), "b")


@query("SELECT hash[1:2] AS shard, count(*) AS blobs, sum(coalesce(stored_size, 0))::BIGINT AS bytes, max(mod_time) AS newest FROM blobs WHERE regexp_full_match(hash, '[0-9a-f]{64}') GROUP BY 1")
def blob_shard_histogram(spark, d):
    rows = table(spark, d, "blobs").where(is_hash(F.col("hash")))
    return rows.groupBy(store.shard_of(F.col("hash")).alias("shard")).agg(F.count(F.lit(1)).alias("blobs"), F.sum(F.coalesce("stored_size", F.lit(0))).alias("bytes"), F.max("mod_time").alias("newest"))


@query("SELECT count(DISTINCT text) AS first, 0 AS second, count(DISTINCT text) AS stored FROM documents")
def blob_write_idempotent(spark, d):
    path = scratch_path(spark, "store")
    blobs = _documents(spark, d).where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.col("text").cast("binary").alias("payload"))
    first, second = store.put(blobs, path), store.put(blobs, path)
    return spark.read.parquet(path).agg(F.lit(first).cast("bigint").alias("first"), F.lit(second).cast("int").alias("second"), F.countDistinct("hash").alias("stored"))


@query(f"WITH {_ENT} SELECT coalesce(status, '') AS status, count(*) AS entries, count(*) FILTER (coalesce(status, '') NOT IN ('locked', 'error') AND coalesce(content_hash, '') <> '') AS restorable FROM ent GROUP BY 1")
def restore_skip_filter(spark, d):
    good = ~F.coalesce("status", F.lit("")).isin(*snapshot.NOT_STORED) & (F.coalesce("content_hash", F.lit("")) != "")
    return _entries(spark, d).groupBy(F.coalesce("status", F.lit("")).alias("status")).agg(F.count(F.lit(1)).alias("entries"), F.count_if(good).alias("restorable"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text <> ''")
def restore_reassemble(spark, d):
    docs = _documents(spark, d).where("text <> ''")
    pieces = docs.select(F.col("doc_id").cast("string").alias("path"), F.posexplode(chunking.chunk_column(F.col("text"), 1024)).alias("seq", "payload"))
    pieces = pieces.withColumn("hash", F.sha2("payload", 256))
    blobs = pieces.select("hash", "payload").dropDuplicates(["hash"])
    entries = docs.select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.lit("new").alias("status"))
    whole = store.restore(entries, pieces.select("path", "seq", "hash"), blobs)
    return whole.select(F.col("path").cast("bigint").alias("doc_id"), F.sha2("content", 256).alias("hash"))


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS hash FROM documents WHERE text <> ''")
def cdc_chunks_invariants(spark, d):
    """Sizes add up, offsets are gapless, and all chunks together have the whole's hash."""
    chunks = chunking.cdc_chunks(_documents(spark, d), "doc_id", "text", least=256, average=1024, most=4096)
    seamless = chunks.groupBy("doc_id").agg(F.sum("size").alias("bytes"), F.max(F.col("chunk_offset") + F.col("size")).alias("end"), F.max("file_hash").alias("hash"), F.max("size").alias("largest"))
    return seamless.where("bytes = end and largest <= 4096").select("doc_id", "bytes", "hash")


# ---- manifests ------------------------------------------------------------------------------------------------


@query(f"WITH {_ENT} SELECT manifest_id, path, content_hash, size FROM ent")
def flatten_manifest(spark, d):
    entries = _entries(spark, d)
    documents = mf.nested(entries, ["manifest_id"]).withColumn("version", F.lit(2)).withColumn("files", F.lit(None).cast("array<struct<path:string,contentHash:string,size:bigint,mtime:string,mode:int,status:string,chunks:array<struct<hash:string,size:bigint>>>>"))
    return mf.files_of(documents, ["manifest_id"]).select("manifest_id", "path", "content_hash", "size")


@query(f"WITH {_ENT} SELECT manifest_id, path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id, path ORDER BY pos DESC) AS nth FROM ent) WHERE nth = 1")
def file_map_last_wins(spark, d):
    return mf.last_wins(_entries(spark, d), ["manifest_id"]).select("manifest_id", "path", "content_hash")


@query(f"WITH {_ENT} SELECT manifest_id, count(*) AS files, sum(size)::BIGINT AS bytes FROM ent GROUP BY manifest_id")
def manifest_json_roundtrip(spark, d):
    """Nested, written as JSON, parsed again with the explicit schema, flattened and counted."""
    documents = mf.nested(_entries(spark, d), ["manifest_id"]).select("manifest_id", F.to_json(F.struct(F.lit(2).alias("version"), "dirs", "stats")).alias("doc"))
    files = mf.files_of(mf.parsed(documents, "doc"), ["manifest_id"])
    return files.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query(f"WITH {_ENT} SELECT manifest_id, path, size FROM ent")
def manifest_v1_migration(spark, d):
    flat = _entries(spark, d).groupBy("manifest_id").agg(F.collect_list(F.struct("path", F.col("content_hash").alias("contentHash"), "size")).alias("files"))
    documents = flat.select("manifest_id", F.to_json(F.struct(F.lit(1).alias("version"), "files")).alias("doc"))
    return mf.files_of(mf.parsed(documents, "doc"), ["manifest_id"]).select("manifest_id", "path", "size")


@query(f"WITH {_ENT} SELECT manifest_id, path, first(entry_id ORDER BY pos, entry_id) AS entry_id FROM ent WHERE path LIKE '%.md' GROUP BY manifest_id, path")
def find_file(spark, d):
    """The first entry of exactly each asked path."""
    files = table(spark, d, "manifest_files").select("manifest_id", normal_path(F.col("path")).alias("path"), "pos", "entry_id")
    return mf.find_first(files, files.where(F.col("path").endswith(".md")), ["manifest_id"], "entry_id")


@query(f"""WITH {_ENT}, w AS (SELECT DISTINCT manifest_id, translate(path, 'aeiors', 'AEIORS') AS wanted FROM ent), l AS (SELECT manifest_id, path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id, path ORDER BY pos DESC) AS nth FROM ent) WHERE nth = 1),
a AS (SELECT *, CASE WHEN wanted = '' THEN wanted WHEN starts_with(wanted, '.') THEN substr(wanted, 2) ELSE '.' || wanted END AS alt FROM w)
SELECT a.manifest_id, wanted, first(path ORDER BY CASE WHEN path = alt THEN 0 ELSE 1 END, path) AS path FROM a JOIN l ON a.manifest_id = l.manifest_id AND (lower(path) = lower(wanted) OR lower(path) = lower(alt)) GROUP BY a.manifest_id, wanted""")
def find_file_tolerant(spark, d):
    entries = _entries(spark, d)
    wanted = entries.select("manifest_id", F.translate("path", "aeiors", "AEIORS").alias("wanted")).distinct()
    return mf.find_tolerant(mf.last_wins(entries, ["manifest_id"]), wanted, ["manifest_id"]).select("manifest_id", "wanted", "path")


# Some names have as few digits as times before September 2001 have; a second file of one second has a suffix.
_NAMES = """names AS (SELECT user_id, (CASE WHEN event_id % 5 = 0 THEN epoch(date_trunc('second', ts))::BIGINT - 900000000 ELSE epoch(date_trunc('second', ts))::BIGINT END)::VARCHAR
|| '_d' || (event_id % 3)::VARCHAR || CASE WHEN event_id % 4 = 0 THEN '_0000af' ELSE '' END || '.json.zst' AS file_name FROM events)"""


def _names(spark, d):
    seconds = F.unix_date(F.to_date("ts")).cast("bigint") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    seconds = F.when(F.col("event_id") % 5 == 0, seconds - 900000000).otherwise(seconds)
    suffix = F.when(F.col("event_id") % 4 == 0, "_0000af").otherwise("")
    return table(spark, d, "events").select("user_id", F.concat(seconds.cast("string"), F.lit("_d"), (F.col("event_id") % 3).cast("string"), suffix, F.lit(".json.zst")).alias("file_name"))


@query(f"WITH {_NAMES} SELECT user_id, last(file_name ORDER BY split_part(file_name, '_', 1)::BIGINT, len(string_split(file_name, '_')), file_name) AS file_name FROM names GROUP BY user_id")
def latest_snapshot(spark, d):
    return mf.latest(_names(spark, d).where(mf.is_manifest_name(F.col("file_name"))), ["user_id"])


@query(f"WITH {_NAMES} SELECT user_id, split_part(file_name, '_', 1)::BIGINT AS seconds, first(file_name ORDER BY len(string_split(file_name, '_')), file_name) AS file_name FROM names GROUP BY ALL")
def snapshot_by_second(spark, d):
    names = _names(spark, d).withColumn("seconds", mf.name_time(F.col("file_name")))
    return mf.by_second(names, ["user_id", "seconds"], F.col("seconds"))


@query(f"WITH {_NAMES} SELECT user_id, split_part(file_name, '_', 1)::BIGINT AS seconds FROM names")
def snapshot_timestamps(spark, d):
    return mf.timestamps(_names(spark, d))


@query(f"WITH {_NAMES} SELECT user_id, count(*) > 0 AS there FROM names WHERE split_part(file_name, '_', 1)::BIGINT >= 1704067200 GROUP BY user_id")
def snapshot_exists(spark, d):
    return mf.timestamps(_names(spark, d)).where("seconds >= 1704067200").groupBy("user_id").agg((F.count(F.lit(1)) > 0).alias("there"))


@query("SELECT DISTINCT device_id || '/' || cloud_id AS cloud_id FROM manifests")
def source_ids(spark, d):
    paths = table(spark, d, "manifests").select(F.concat_ws("/", "device_id", "cloud_id", F.col("manifest_id").cast("string")).alias("path"))
    return mf.source_ids(paths)


@query("SELECT put_id FROM blobs WHERE removed_at IS NOT NULL AND 1767225600 - removed_at > 2592000")
def trash_retention(spark, d):
    listing = table(spark, d, "blobs").where("removed_at is not null").select("put_id", F.col("removed_at").alias("mod_time"))
    return mf.expired(listing, 1767225600, 30 * 86400).select("put_id")


@query("SELECT cloud_id, count(*) AS snapshots, max(received_at) AS newest, sum(file_count)::BIGINT AS files FROM (SELECT DISTINCT cloud_id, manifest_id, received_at, file_count FROM manifests) GROUP BY cloud_id")
def registry_rollup(spark, d):
    rows = table(spark, d, "manifests").select("cloud_id", "manifest_id", "received_at", "file_count").distinct()
    return rows.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("snapshots"), F.max("received_at").alias("newest"), F.sum("file_count").alias("files"))


# ---- scalars --------------------------------------------------------------------------------------------------


@query("""SELECT entry_id, min(CASE WHEN mtime::BIGINT > 100000000000000 THEN mtime::BIGINT WHEN mtime::BIGINT > 100000000000 THEN mtime::BIGINT * 1000 ELSE mtime::BIGINT * 1000000 END) AS micros
FROM manifest_files WHERE regexp_full_match(mtime, '-?[0-9]{1,18}') GROUP BY entry_id""")
def flex_time_units(spark, d):
    rows = table(spark, d, "manifest_files").where(F.col("mtime").rlike("^-?[0-9]{1,18}$"))
    return rows.groupBy("entry_id").agg(F.min(number_micros(F.col("mtime"))).alias("micros"))


@query(r"""SELECT entry_id, min(CASE WHEN regexp_full_match(mtime, '-?[0-9]{1,18}') THEN strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S')
|| rtrim(rtrim(strftime(make_timestamp(us), '.%f'), '0'), '.') || 'Z' ELSE mtime END) AS stamp FROM (SELECT entry_id, mtime, CASE WHEN n > 100000000000000 THEN n WHEN n > 100000000000 THEN n * 1000 ELSE n * 1000000 END AS us
FROM (SELECT entry_id, mtime, try_cast(CASE WHEN regexp_full_match(mtime, '-?[0-9]{1,18}') THEN mtime END AS BIGINT) AS n FROM manifest_files)) GROUP BY entry_id""")
def flex_time_text(spark, d):
    return table(spark, d, "manifest_files").groupBy("entry_id").agg(F.min(flexible_text(F.col("mtime"))).alias("stamp"))


@query(r"""SELECT entry_id, max(coalesce(CASE WHEN regexp_matches(mtime, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$') THEN
epoch_us(try_cast(regexp_replace(mtime, '(\.\d{6})\d*', '\1') AS TIMESTAMPTZ)) END, 0)) AS micros FROM manifest_files GROUP BY entry_id""")
def mtime_micro(spark, d):
    return table(spark, d, "manifest_files").groupBy("entry_id").agg(F.max(rfc3339_micros(F.col("mtime"))).alias("micros"))


@query("SELECT DISTINCT manifest_id, strftime(received_at, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM manifests")
def rfc3339_format(spark, d):
    return table(spark, d, "manifests").select("manifest_id", F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp")).distinct()


_KEY = "X'000102030405060708090A0B0C0D0E0F101112131415161718191A1B1C1D1E1F'"
_HASHES = "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL"


def _texts(spark, d):
    return _documents(spark, d).where("text is not null").select("doc_id", F.col("text").cast("binary").alias("data"))


def _hashed(df: DataFrame, column) -> DataFrame:
    return df.select("doc_id", F.sha2(column, 256).alias("hash"))


@query(_HASHES)
def zstd_roundtrip(spark, d):
    return _hashed(_texts(spark, d), codecs.decompressed(codecs.compressed(F.col("data"), "zstd", 3), "zstd"))


@query(_HASHES)
def deflate_roundtrip(spark, d):
    return _hashed(_texts(spark, d), codecs.decompressed(codecs.compressed(F.col("data"), "deflate", 6), "deflate"))


@query(_HASHES)
def s2_roundtrip(spark, d):
    return _hashed(_texts(spark, d), codecs.decompressed(codecs.compressed(F.col("data"), "s2"), "s2"))


@query("SELECT doc_id, sha256(text) AS hash, octet_length(encode(text)) >= 4096 AS tried FROM documents WHERE text IS NOT NULL")
def compress_if_useful(spark, d):
    docs = _texts(spark, d).withColumn("path", F.concat("doc_id", F.lit(".txt")))
    stored = codecs.compress_if_useful(docs, "path", "data", 4096)
    opened = F.coalesce(codecs.decompressed(F.when(F.col("is_compressed"), F.col("stored"))), F.col("stored"))
    return stored.select("doc_id", F.sha2(opened, 256).alias("hash"), (F.octet_length("data") >= 4096).alias("tried"))


@query(_HASHES)
def gb1_roundtrip(spark, d):
    sealed = _texts(spark, d).withColumn("frame", frames.small_frame(F.col("data"), F.expr(_KEY), frames.random_iv(F.col("doc_id"), small=True)))
    return _hashed(sealed, frames.open_frame(F.col("frame"), F.expr(_KEY), 1024))


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text <> ''")
def gb1_large_roundtrip(spark, d):
    cut = _texts(spark, d).where("octet_length(data) > 0").select("doc_id", F.posexplode(chunking.chunk_column(F.col("data"), 1024)).alias("seq", "piece"))
    with_iv = cut.withColumn("iv", frames.random_iv(F.col("seq")))
    sets = with_iv.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "piece", "iv"))).alias("s"))
    framed = sets.select("doc_id", frames.large_frame(F.col("s.piece"), F.col("s.iv"), F.expr(_KEY)).alias("frame"))
    return _hashed(framed, frames.open_frame(F.col("frame"), F.expr(_KEY), 1024))


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text <> ''")
def gb2_roundtrip(spark, d):
    pieces = _texts(spark, d).where("octet_length(data) > 0").select("doc_id", F.posexplode(frames.gb2_pieces(F.col("data"), 4096, 512)).alias("seq", "piece"))
    with_iv = pieces.withColumn("iv", frames.random_iv(F.col("seq")))
    sets = with_iv.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "piece", "iv"))).alias("s"))
    framed = sets.select("doc_id", frames.gb2_frame(F.col("s.piece"), F.col("s.iv"), F.expr(_KEY)).alias("frame"))
    return _hashed(framed, frames.open_gb2(F.col("frame"), F.expr(_KEY)))


@query(_HASHES)
def gkm1_roundtrip(spark, d):
    sealed = _texts(spark, d).withColumn("frame", frames.manifest_frame(F.col("data"), F.expr(_KEY), frames.random_iv(F.col("doc_id"))))
    return _hashed(sealed, frames.open_frame(F.col("frame"), F.expr(_KEY), 1024))


@query()
def hkdf_derive(spark, d):
    return table(spark, d, "source_registry").select("source_id", F.lower(F.hex(frames.derived_key(F.expr(_KEY), F.col("cloud_id")))).alias("derived"))


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(spark, d):
    counted = windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "1 hour", "2 hours")
    return counted.withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---- more of the store and of listings ------------------------------------------------------------------------------


@query(f"WITH {_BLOBLIST} SELECT intake_id, coalesce(regexp_full_match(content_hash, '[0-9a-f]{{64}}') AND content_hash IN (SELECT hash FROM stored), false) AS there FROM intake_files")
def blob_exists(spark, d):
    wanted = table(spark, d, "intake_files").select("intake_id", F.col("content_hash").alias("hash"))
    return store.exists(wanted, _stored(spark, d)).select("intake_id", "there")


@query("SELECT hash, mod_time, coalesce(stored_size, 0) AS stored_size FROM blobs WHERE regexp_full_match(hash, '[0-9a-f]{64}') AND starts_with(hash, 'c')")
def blob_listing(spark, d):
    return store.listing(table(spark, d, "blobs"), "c")


def _text_store(spark, d) -> store.BlobStore:
    kept = store.BlobStore(spark, scratch_path(spark, "store"), "hash string, payload binary, shard string")
    kept.put(_documents(spark, d).where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.col("text").cast("binary").alias("payload")))
    return kept


@query("SELECT 0 AS again, count(*) FILTER (h < 'a') AS kept, count(*) FILTER (h >= 'a') AS removed, coalesce(sum(n) FILTER (h < 'a'), 0)::BIGINT AS bytes FROM (SELECT DISTINCT sha256(text) AS h, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL)")
def blob_delete(spark, d):
    """All texts are stored; those whose hash begins with a letter are removed, twice."""
    kept = _text_store(spark, d)
    doomed = _documents(spark, d).where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash")).where("hash >= 'a'")
    removed, again = kept.delete(doomed), kept.delete(doomed)
    return kept.rows().agg(F.count(F.lit(1)).alias("kept"), F.lit(removed).cast("bigint").alias("removed"), F.lit(again).cast("int").alias("again"), F.coalesce(F.sum(F.octet_length("payload").cast("bigint")), F.lit(0)).alias("bytes"))


@query("SELECT sha256(text) AS hash, octet_length(encode(text)) AS bytes FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL) ORDER BY 1 LIMIT 1")
def blob_get(spark, d):
    """The one blob with the least hash, by a look-up in its shard."""
    kept = _text_store(spark, d)
    least = kept.rows().agg(F.min("hash")).first()[0]
    return kept.get(least or "0" * 64).select(F.sha2("payload", 256).alias("hash"), F.octet_length("payload").cast("bigint").alias("bytes"))


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS hash FROM documents WHERE text <> ''")
def ordered_chunk_hash(spark, d):
    pieces = _documents(spark, d).where("text <> ''").select("doc_id", F.posexplode(chunking.chunk_column(F.col("text"), 1024)).alias("seq", "piece"))
    return chunking.ordered_hash(pieces, "doc_id", "seq", "piece")


@query("SELECT DISTINCT cloud_id, manifest_id, ts, row_number() OVER (PARTITION BY cloud_id ORDER BY ts DESC NULLS LAST, manifest_id)::INT AS place FROM (SELECT DISTINCT cloud_id, manifest_id, ts FROM manifests)")
def snapshots_newest_first(spark, d):
    return mf.newest_first(table(spark, d, "manifests").select("cloud_id", "manifest_id", "ts").distinct(), ["cloud_id"], "ts", "manifest_id")


@query(f"WITH {_PATHS} SELECT path FROM paths ORDER BY path LIMIT 10")
def first_samples(spark, d):
    """The first ten paths in their order: the sample that a report shows."""
    return _paths(spark, d).orderBy("path").limit(10)


@query("""SELECT count(*) FILTER (status = 'new') AS new_files, count(*) FILTER (status = 'changed') AS changed_files, count(*) FILTER (status = 'unchanged') AS unchanged_files, count(*) FILTER (status = 'error') AS failed_files,
count(*) FILTER (status = 'locked') AS locked_files, count(*) FILTER (status = 'skipped') AS skipped_files, count(*) FILTER (status IS NULL OR status NOT IN ('new', 'changed', 'unchanged', 'error', 'locked', 'skipped')) AS other_files FROM (SELECT DISTINCT * FROM files_scan)""")
def scan_counters(spark, d):
    return snapshot.scan_counters(table(spark, d, "files_scan").distinct())


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def decrypt_if_encrypted(spark, d):
    """Every kind of frame, and contents too short to be one."""
    key, iv = F.expr(_KEY), frames.random_iv(F.col("doc_id"), small=True)
    texts = _texts(spark, d).withColumn("iv", iv)
    cut = F.transform(chunking.chunk_column(F.col("data"), 64), lambda p: F.struct(F.lit(0).alias("flag"), p.alias("data")))
    ivs = lambda c: F.transform(c, lambda _, i: F.unhex(F.substring(F.sha2(F.concat(F.col("iv"), F.unhex(F.lpad(F.hex(i), 8, "0"))), 256), 1, 24)))
    second = frames.gb2_frame(cut, ivs(cut), key)
    kind = F.col("doc_id") % 3
    framed = F.when(F.octet_length("data") < 4, F.col("data")).when(kind == 0, frames.small_frame(F.col("data"), key, F.col("iv"))).when(kind == 1, second).otherwise(frames.manifest_frame(F.col("data"), key, F.col("iv")))
    return _hashed(texts.withColumn("frame", framed), frames.open_any(F.col("frame"), key, 1024))


@query(f"WITH {_REFS} SELECT DISTINCT hash FROM refs WHERE hash IS NOT NULL")
def alive_hashes_documents(spark, d):
    """Manifests written as JSON files, of which only the hashes are read back."""
    chunks = table(spark, d, "file_chunks").select("ref_id", "entry_id", "seq", "hash", "size").distinct()
    lists = chunks.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "hash", "size"))), lambda c: F.struct(c["hash"].alias("hash"), c["size"].alias("size"))).alias("chunks"))
    folder = scratch_path(spark, "manifest-documents")
    mf.nested(_entries(spark, d).join(lists, "entry_id", "left"), ["manifest_id"]).select(F.to_json(F.struct(F.lit(2).alias("version"), "dirs", "stats")).alias("value")).write.text(folder)
    return mf.alive_hashes(spark, folder)


@query(f"""WITH RECURSIVE {_ENT}, own AS (SELECT DISTINCT manifest_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM ent UNION SELECT DISTINCT manifest_id, 'bare/' || manifest_id::VARCHAR FROM ent),
up(manifest_id, dir) AS (SELECT manifest_id, dir FROM own UNION SELECT manifest_id, regexp_extract(dir, '^(.*)/[^/]*$', 1) FROM up WHERE dir <> '')
SELECT manifest_id, folders, files, bytes FROM (SELECT manifest_id, count(*) AS folders FROM up GROUP BY 1) JOIN (SELECT manifest_id, count(*) AS files, sum(size)::BIGINT AS bytes FROM ent GROUP BY 1) USING (manifest_id)""")
def manifest_v1_folders(spark, d):
    """Documents of the first version with an empty directory each, brought to the second: directories and counters."""
    flat = _entries(spark, d).groupBy("manifest_id").agg(F.collect_list(F.struct("path", F.col("content_hash").alias("contentHash"), "size")).alias("files"))
    bare = F.concat(F.lit("bare/"), F.col("manifest_id").cast("string"))
    documents = flat.select("manifest_id", F.to_json(F.struct(F.lit(1).alias("version"), "files", F.array(F.struct(bare.alias("relPath"), F.lit("x").alias("name"))).alias("emptyDirs"))).alias("doc"))
    moved = mf.migrated(mf.parsed(documents, "doc"), ["manifest_id"])
    return moved.select("manifest_id", F.size("dirs").cast("bigint").alias("folders"), F.col("stats.fileCount").alias("files"), F.col("stats.totalSize").alias("bytes"))
