"""Snapshot manifests: nested documents, their checksummed files, time travel over their names, and source registries.

The relational work is on DataFrames; only the commit of one small file is driver-side Python (temp file and rename).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import secrets
import shutil
import time
from datetime import datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.functions.codecs import MANIFEST_LIMIT, codec
from siltbed.functions.paths import ancestors, base_name, dir_name, join_path, toggle_leading_dot
from siltbed.sources.files import create_atomic, sync_folder, write_atomic

CHUNKS = "array<struct<hash:string,size:bigint>>"
DIRS = f"map<string,struct<files:array<struct<name:string,contentHash:string,size:bigint,mtime:string,mode:int,status:string,chunks:{CHUNKS}>>,subdirs:array<string>>>"
STATS = "struct<fileCount:bigint,totalSize:bigint,newFiles:bigint,changedFiles:bigint,unchangedFiles:bigint,newBytes:bigint>"
#: Explicit, for inference loses the root directory, whose key is the empty string.
MANIFEST = (
    f"version int, sourceId bigint, cloudId string, sourceName string, sourcePath string, timestamp string, deviceId string, dirs {DIRS}, stats {STATS}, "
    f"files array<struct<path:string,contentHash:string,size:bigint,mtime:string,mode:int,status:string,chunks:{CHUNKS}>>, emptyDirs array<struct<relPath:string,name:string>>"
)
REGISTRY = (
    "sourceId bigint, cloudId string, name string, path string, deviceId string, pins array<struct<repoPath:string,snapshotTime:bigint,note:string,createdAt:bigint>>, "
    "notes array<struct<repoPath:string,snapshotTime:bigint,content:string,pushedFiles:string,source:string,createdAt:bigint,authorDeviceId:string,authorName:string>>, "
    "snapshots array<struct<timestamp:string,fileCount:bigint,totalSize:bigint>>, "
    "settings struct<schedule:string,scheduleConfig:string,retention:string,retentionCustom:string,excludes:array<string>,enableAi:boolean,watchMode:string>, "
    "lastSnapshot string, snapshotCount bigint, createdAt string"
)


def parsed(documents: DataFrame, doc: str) -> DataFrame:
    """Columns of the JSON in ``doc``; text that is no JSON object gives a row of nulls with ``bad`` set."""
    read = documents.withColumn("__m", F.from_json(doc, MANIFEST + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return read.select(*[c for c in documents.columns if c != doc], "__m.*").withColumn("bad", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


def files_of(manifests: DataFrame, key: list[str]) -> DataFrame:
    """key, path, content_hash, size, mtime, status, chunks, pos of all files: the directories' and, for old
    documents, the flat list's. Duplicates are kept; pos is the order within a directory."""
    some = lambda prefix: [F.col(f"{prefix}contentHash").alias("content_hash"), F.col(f"{prefix}size").alias("size"), F.col(f"{prefix}mtime").alias("mtime"), F.col(f"{prefix}status").alias("status"), F.col(f"{prefix}chunks").alias("chunks"), "pos"]
    nested = manifests.select(*key, F.explode("dirs").alias("dir", "d")).select(*key, "dir", F.posexplode("d.files").alias("pos", "f"))
    flat = manifests.where("version < 2").select(*key, F.posexplode("files").alias("pos", "f"))
    return nested.select(*key, join_path(F.col("dir"), F.col("f.name")).alias("path"), *some("f.")).unionByName(flat.select(*key, F.regexp_replace("f.path", "^/", "").alias("path"), *some("f.")))


def last_wins(files: DataFrame, key: list[str]) -> DataFrame:
    """One row per path: the one that comes last."""
    nth = F.row_number().over(Window.partitionBy(*key, "path").orderBy(F.desc("pos")))
    return files.withColumn("__n", nth).where("__n = 1").drop("__n")


def folder_rows(entries: DataFrame, key: list[str] = (), empty: DataFrame | None = None) -> DataFrame:
    """key, dir, files, subdirs, n, bytes: entries (path, content_hash, size, mtime, mode, status and, where there are any,
    chunks) folded into their directories; every ancestor is there, with its child directories, the root as ''. ``empty``
    (key, dir): directories without a file."""
    chunks = F.col("chunks") if "chunks" in entries.columns else F.lit(None)
    file = F.struct(base_name(F.col("path")).alias("name"), F.col("content_hash").alias("contentHash"), "size", "mtime", "mode", "status", chunks.cast(CHUNKS).alias("chunks"))
    held = entries.select(*key, dir_name(F.col("path")).alias("dir"), file.alias("file")).groupBy(*key, "dir").agg(F.array_sort(F.collect_list("file")).alias("files"), F.count(F.lit(1)).alias("n"), F.sum("file.size").alias("bytes"))
    # Ancestors of directories, not of files: there are far fewer.
    own = held.select(*key, "dir")
    own = own if empty is None else own.unionByName(empty.select(*key, "dir"))
    every = own.select(*key, F.explode(F.array_append(F.when(F.col("dir") == "", F.array()).otherwise(ancestors(F.col("dir"))), F.col("dir"))).alias("dir")).distinct()
    inner = every.where("dir <> ''").groupBy(*key, dir_name(F.col("dir")).alias("dir")).agg(F.array_sort(F.collect_list(base_name(F.col("dir")))).alias("subdirs"))
    joined = every.join(held, [*key, "dir"], "left").join(inner, [*key, "dir"], "left")
    none = lambda kind: F.array().cast(kind)
    kinds = dict(held.dtypes)
    return joined.select(*key, "dir", F.coalesce("files", none(kinds["files"])).alias("files"), F.coalesce("subdirs", none("array<string>")).alias("subdirs"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def folder_documents(entries: DataFrame) -> DataFrame:
    """dir, body: one directory of a manifest document a row, as JSON, in the order of the directories."""
    return folder_rows(entries).select("dir", F.to_json(F.struct("files", "subdirs")).alias("body")).orderBy("dir")


def migrated(manifests: DataFrame, key: list[str]) -> DataFrame:
    """key, version, dirs, stats of documents of the first version in the form of the second: the flat list becomes
    directories, its empty directories come along, and the counters are counted again."""
    old = manifests.where("coalesce(version, 0) < 2")
    rows = old.select(*key, F.explode("files").alias("f")).select(*key, F.regexp_replace("f.path", "^/", "").alias("path"), F.col("f.contentHash").alias("content_hash"), "f.size", "f.mtime", "f.mode", "f.status", "f.chunks")
    bare = old.select(*key, F.explode("emptyDirs").alias("e")).select(*key, F.regexp_replace("e.relPath", "^/", "").alias("dir"))
    return nested(rows, key, empty=bare).withColumn("version", F.lit(2))


def nested(entries: DataFrame, key: list[str], counters: DataFrame | None = None, empty: DataFrame | None = None) -> DataFrame:
    """key, dirs, stats: whole documents, one a row, so for manifests that fit one; ``write_manifest`` writes any other.
    ``counters``: key, newFiles, changedFiles, unchangedFiles, newBytes, or counted by status."""
    folders = folder_rows(entries, key, empty)
    whole = folders.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("dir", F.struct("files", "subdirs")))).alias("dirs"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    if counters is None:
        of = lambda s: F.count_if(F.col("status") == s)
        fresh = F.coalesce(F.sum(F.when(F.col("status").isin("new", "changed"), F.col("size"))), F.lit(0))
        counters = entries.groupBy(*key).agg(of("new").alias("newFiles"), of("changed").alias("changedFiles"), of("unchanged").alias("unchangedFiles"), fresh.alias("newBytes"))
    stats = F.struct(F.col("n").alias("fileCount"), F.col("bytes").alias("totalSize"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("newFiles", "changedFiles", "unchangedFiles", "newBytes")])
    return whole.join(counters, key, "left").select(*key, "dirs", stats.alias("stats"))


def alive_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """hash: what the plain or compressed manifests below ``folder`` refer to, each once. Only hashes are parsed."""
    file = "struct<contentHash:string,chunks:array<struct<hash:string>>>"
    schema = f"dirs map<string,struct<files:array<{file}>>>, files array<{file}>"
    docs = spark.read.schema(schema).option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").json(folder)
    rows = docs.select(F.explode(F.flatten(F.map_values("dirs").getField("files"))).alias("f")).unionByName(docs.select(F.explode("files").alias("f")))
    return rows.select(F.explode(F.when(F.size("f.chunks") > 0, F.col("f.chunks.hash")).otherwise(F.array("f.contentHash"))).alias("hash")).where("hash <> ''").distinct()


def find_first(files: DataFrame, wanted: DataFrame, key: list[str], carry: str) -> DataFrame:
    """For each wanted path (key, path) the first entry of exactly this path: key, path, ``carry``."""
    hit = files.join(wanted.select(*key, "path").distinct(), [*key, "path"], "left_semi")
    return hit.groupBy(*key, "path").agg(F.min_by(carry, F.struct("pos", carry)).alias(carry))


def newest_first(listed: DataFrame, key: list[str], stamp: str, tie: str) -> DataFrame:
    """``listed`` with ``place``: 1 for the greatest ``stamp`` of its key, compared as text; equal ones by ``tie``."""
    return listed.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last(stamp), tie)))


def find_file(files: DataFrame, path: Column | str) -> DataFrame:
    """The first entry of exactly this path."""
    return files.where(F.col("path") == path).orderBy("pos").limit(1)


def find_tolerant(files: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """For each wanted path (column ``wanted``) the best match: with the leading dot toggled, else whatever the case
    of either form; ties go to the smallest path. Equi-joins on the folded path only."""
    alt = toggle_leading_dot(F.col("wanted"))
    forms = F.array_distinct(F.array(F.lower("wanted"), F.lower(alt)))
    asked = wanted.select(*key, "wanted", alt.alias("alt"), F.explode(forms).alias("folded"))
    hit = asked.join(files.withColumn("folded", F.lower("path")), [*key, "folded"])
    rank = F.when(F.col("path") == F.col("alt"), 0).otherwise(1)
    return hit.groupBy(*key, "wanted").agg(F.min(F.struct(rank.alias("rank"), "path", "content_hash")).alias("m")).select(*key, "wanted", "m.path", "m.content_hash")


# Names of manifest files: {unix seconds}_{device}.json.zst, with a suffix before the extension on collision.


def is_manifest_name(name: Column) -> Column:
    return (name.endswith(".json.zst") | name.endswith(".json")) & ~name.contains(".alive.")


def name_time(name: Column) -> Column:
    """Seconds in front of the name, null where there are none."""
    return F.substring_index(name, "_", 1).try_cast("bigint")


def latest(listing: DataFrame, key: list[str], name: str = "file_name") -> DataFrame:
    """The newest name per key: by its seconds as a number, then the one saved last of that second (see
    :func:`save_order`), then by the text. Names without seconds come before all others."""
    order = F.struct(F.coalesce(name_time(F.col(name)), F.lit(-(1 << 62))), save_order(F.col(name)), F.col(name))
    return listing.groupBy(*key).agg(F.max_by(name, order).alias(name))


def save_order(name: Column) -> Column:
    """1 for a name with the suffix that a second file of one second gets, 0 for the first."""
    return F.when(name.rlike(r"_[0-9a-f]{6}\.json(\.zst)?$"), 1).otherwise(0)


def by_second(listing: DataFrame, key: list[str], seconds: Column, name: str = "file_name") -> DataFrame:
    """The name of that second that was saved first: the one without a suffix, if it is there, then by the text."""
    at = listing.where(F.col(name).startswith(F.concat(seconds.cast("string"), F.lit("_"))))
    return at.groupBy(*key).agg(F.min_by(name, F.struct(save_order(F.col(name)), F.col(name))).alias(name))


def timestamps(listing: DataFrame, name: str = "file_name") -> DataFrame:
    return listing.select(*[c for c in listing.columns if c != name], name_time(F.col(name)).alias("seconds")).where("seconds is not null")


def manifest_dir(meta: str, cloud_id: str) -> str:
    return os.path.join(meta, "manifests", cloud_id)


def _free_name(meta: str, header: dict, write) -> str:
    """Give ``write(path)`` a name for the manifest of ``header`` until it says that the name was free."""
    device = header.get("deviceId")
    if not device:
        raise ValueError("a manifest needs a device")
    try:
        seconds = int(datetime.fromisoformat(header["timestamp"].replace("Z", "+00:00")).timestamp())
    except (KeyError, ValueError, AttributeError):
        seconds = int(time.time())
    folder = Path(manifest_dir(meta, header.get("cloudId", "")))
    folder.mkdir(parents=True, exist_ok=True)
    for attempt in range(4):
        path = folder / f"{seconds}_{device}{'_' + secrets.token_hex(3) if attempt else ''}.json.zst"
        if write(str(path)):
            return str(path)
    raise FileExistsError(f"no free name for {seconds}_{device}")


def save_manifest(meta: str, document: dict, seal=None) -> str:
    """Write one manifest and its checksum sidecar; returns the path. The second of two in one second gets a suffix.
    ``seal`` encrypts the compressed bytes. The sidecar comes first, so a manifest is never without one."""
    body = codec("zstd", 3, MANIFEST_LIMIT).compress(json.dumps(document, ensure_ascii=False).encode())
    body = seal(body) if seal else body

    def write(path: str) -> bool:
        if os.path.exists(path) or not create_atomic(f"{path}.sha256", hashlib.sha256(body).hexdigest().encode()):
            return False
        return create_atomic(path, body)

    return _free_name(meta, document, write)


def write_manifest(meta: str, header: dict, folders: DataFrame) -> str:
    """A manifest of any size: ``folders`` (dir, body as JSON) come to the driver one after the other and leave it
    compressed at once; memory holds a partition of them. Returns the path."""
    import zstandard

    temp = Path(manifest_dir(meta, header.get("cloudId", "")))
    temp.mkdir(parents=True, exist_ok=True)
    temp = temp / f".{secrets.token_hex(8)}.tmp"
    with open(temp, "wb") as f:
        with zstandard.ZstdCompressor(level=3).stream_writer(f, closefd=False) as out:
            out.write(json.dumps(header, ensure_ascii=False)[:-1].encode() + b', "dirs": {')
            for n, row in enumerate(folders.toLocalIterator()):
                out.write(f"{', ' if n else ''}{json.dumps(row.dir, ensure_ascii=False)}: {row.body}".encode())
            out.write(b"}}")
        f.flush()
        os.fsync(f.fileno())
    with open(temp, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest().encode()

    def write(path: str) -> bool:
        if os.path.exists(path) or not create_atomic(f"{path}.sha256", digest):
            return False
        os.link(temp, path)
        sync_folder(os.path.dirname(path))
        return True

    try:
        return _free_name(meta, header, write)
    finally:
        temp.unlink()


def load_manifests(spark: SparkSession, folder: str, unseal=None) -> DataFrame:
    """file_name, doc, problem of all manifests below ``folder``: verified against their sidecars, which must exist,
    and decompressed. A bad one has a null doc and a problem. ``unseal`` opens encrypted ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    kept = files.where(is_manifest_name(F.col("path")))
    sums = files.where(F.col("path").endswith(".sha256")).select(F.expr("substring(path, 1, length(path) - 7)").alias("path"), F.lower(F.trim(F.decode("content", "utf-8"))).alias("sum"))

    @F.pandas_udf("struct<doc:string,problem:string>")
    def opened(contents: pd.Series) -> pd.DataFrame:
        zstd = codec("zstd", 3, MANIFEST_LIMIT)

        def one(content) -> tuple[str | None, str | None]:
            if content is None:
                return None, None
            data = bytes(content)
            try:
                if data[:4] == b"GKM1":
                    if unseal is None:
                        return None, "encrypted"
                    data = unseal(data)
                return (zstd.decompress(data) if zstd.recognises(data) else data).decode(), None
            except (ValueError, LookupError, ArithmeticError, zstd.Error) as e:
                return None, f"unreadable: {e}"

        return pd.DataFrame([one(c) for c in contents], columns=["doc", "problem"])

    checked = kept.join(sums, "path", "left").withColumn("problem", F.when(F.col("sum").isNull(), "no checksum").when(F.col("sum") != F.sha2("content", 256), "checksum mismatch"))
    read = checked.withColumn("o", opened(F.when(F.col("problem").isNull(), F.col("content"))))
    told = read.select(base_name(F.col("path")).alias("file_name"), F.col("o.doc").alias("doc"), F.coalesce("problem", "o.problem").alias("problem"))
    no_object = F.col("doc").isNotNull() & F.from_json("doc", "_corrupt_record string, version int", {"columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNotNull()
    return told.withColumns({"problem": F.when(no_object, "no object").otherwise(F.col("problem")), "doc": F.when(~no_object, F.col("doc"))})


def list_manifests(spark: SparkSession, meta: str, cloud_id: str, unseal=None, trash: bool = False) -> tuple[DataFrame, DataFrame]:
    """The manifests of a source (or those in its trash), newest timestamp first, with all their columns; and the names and
    problems of those that cannot be read."""
    folder = os.path.join(meta, "trash", cloud_id) if trash else manifest_dir(meta, cloud_id)
    if not os.path.isdir(folder):
        read = spark.createDataFrame([], "file_name string, doc string, problem string")
    else:
        read = load_manifests(spark, folder, unseal)
    return parsed(read.where("problem is null").drop("problem"), "doc").orderBy(F.desc("timestamp"), "file_name"), read.where("problem is not null").select("file_name", "problem")


def listing(meta: str, root: str = "manifests") -> list[str]:
    """Paths of all manifest files below ``root``, relative to it, the registries left out."""
    base = Path(meta) / root
    found = (p.relative_to(base) for p in base.rglob("*.json*") if p.is_file()) if base.is_dir() else ()
    return sorted(str(p) for p in found if p.parts[0] != "_sources" and not p.name.startswith(".") and not p.name.endswith(".sha256") and ".alive." not in p.name)


def _with_sidecars(meta: str, cloud_id: str) -> list[Path]:
    folder = Path(manifest_dir(meta, cloud_id))
    return sorted(p for p in folder.glob("*.json*") if p.is_file()) if folder.is_dir() else []


def trash_all(meta: str, cloud_id: str) -> int:
    """Move all manifests of a source, sidecars too, to the trash, and its registry; how many manifests."""
    names = [p.name for p in _with_sidecars(meta, cloud_id) if not p.name.endswith(".sha256")]
    for name in names:
        trash_manifest(meta, cloud_id, name)
    device, _, source = cloud_id.rpartition("/")
    for d, s in {(device, cloud_id), (device, source)}:
        registry = registry_path(meta, d, s)
        if registry.exists():
            target = Path(meta) / "trash" / "_sources" / d / registry.name
            target.parent.mkdir(parents=True, exist_ok=True)
            shutil.move(registry, target)
    _remove_empty(Path(manifest_dir(meta, cloud_id)))
    return len(names)


def delete_all(meta: str, cloud_id: str) -> int:
    """Remove all manifests of a source with their sidecars; how many manifests."""
    found = _with_sidecars(meta, cloud_id)
    for path in found:
        path.unlink()
    _remove_empty(Path(manifest_dir(meta, cloud_id)))
    return sum(not p.name.endswith(".sha256") for p in found)


def clean_trash(meta: str, now: float, max_age: float, cloud_id: str | None = None) -> int:
    """Remove files in the trash, or in one source's part of it, that are strictly older than ``max_age`` seconds; how
    many, sidecars included. With the last manifest of a source its trashed registry goes as well."""
    root = Path(meta) / "trash"
    base = root / cloud_id if cloud_id else root
    old = [p for p in base.rglob("*") if p.is_file() and "_sources" not in p.relative_to(root).parts[:1] and now - p.stat().st_mtime > max_age] if base.is_dir() else []
    for path in old:
        path.unlink()
    for folder in {p.parent for p in old}:
        if _remove_empty(folder):
            device, source = folder.relative_to(root).parent, folder.name
            for name in (f"{source}.json.zst", f"{re.sub(r'[^A-Za-z0-9._-]', '_', str(folder.relative_to(root)))}.json.zst"):
                (root / "_sources" / device / name).unlink(missing_ok=True)
    return len(old)


def trash_ids(meta: str) -> list[str]:
    """What lies at the top of the trash, registries left out."""
    root = Path(meta) / "trash"
    return sorted(p.name for p in root.iterdir() if p.is_dir() and p.name != "_sources") if root.is_dir() else []


def _remove_empty(folder: Path) -> bool:
    try:
        folder.rmdir()
        return True
    except OSError:
        return False


def trash_manifest(meta: str, cloud_id: str, file_name: str) -> str:
    """Move a manifest with its sidecar to the trash."""
    target = Path(meta) / "trash" / cloud_id
    target.mkdir(parents=True, exist_ok=True)
    for name in (file_name, file_name + ".sha256"):
        source = Path(manifest_dir(meta, cloud_id)) / name
        if source.exists():
            shutil.move(source, target / name)
    return str(target / file_name)


def expired(listing: DataFrame, now: int, max_age: int) -> DataFrame:
    """Trashed files that are strictly older than ``max_age`` seconds."""
    return listing.where(F.lit(now) - F.col("mod_time") > max_age)


def delete_manifest(meta: str, cloud_id: str, timestamp: str, device: str, unseal=None) -> bool:
    """Remove the first manifest with this timestamp and device, by its content, and its sidecar. Unreadable ones are
    passed over."""
    zstd = codec("zstd", 3, MANIFEST_LIMIT)
    for path in sorted(Path(manifest_dir(meta, cloud_id)).glob("*.json*")):
        if path.name.endswith(".sha256"):
            continue
        data = path.read_bytes()
        try:
            data = unseal(data) if unseal and data[:4] == b"GKM1" else data
            document = json.loads(zstd.decompress(data) if zstd.recognises(data) else data)
        except ValueError:
            continue
        if document.get("timestamp") == timestamp and document.get("deviceId") == device:
            path.unlink()
            path.with_name(path.name + ".sha256").unlink(missing_ok=True)
            return True
    return False


def source_ids(paths: DataFrame) -> DataFrame:
    """Distinct 'device/source' of manifest paths 'device/source/file', registries left out."""
    parts = F.split("path", "/")
    return paths.where((F.size(parts) >= 3) & (parts[0] != "_sources")).select(F.concat_ws("/", parts[0], parts[1]).alias("cloud_id")).distinct()


def registry_path(meta: str, device: str, cloud_id: str, root: str = "manifests") -> Path:
    return Path(meta) / root / "_sources" / (device or "") / f"{re.sub(r'[^A-Za-z0-9._-]', '_', cloud_id)}.json.zst"


def save_registry(meta: str, document: dict) -> str:
    """Insert or replace one source's registry."""
    path = registry_path(meta, document.get("deviceId"), document["cloudId"])
    path.parent.mkdir(parents=True, exist_ok=True)
    write_atomic(str(path), codec("zstd").compress(json.dumps(document, ensure_ascii=False).encode()))
    return str(path)


def load_registry(meta: str, device: str, cloud_id: str, trash: bool = False) -> dict | None:
    """One source's registry, of the trash where told so; None if there is none."""
    path = registry_path(meta, device, cloud_id, "trash" if trash else "manifests")
    return json.loads(codec("zstd").decompress(path.read_bytes())) if path.exists() else None


def delete_registry(meta: str, device: str, cloud_id: str) -> bool:
    """Remove a source's registry; whether there was one."""
    path = registry_path(meta, device, cloud_id)
    there = path.exists()
    path.unlink(missing_ok=True)
    return there


def load_registries(spark: SparkSession, meta: str, trash: bool = False) -> DataFrame:
    """All source registries, device folders included."""
    folder = f"{meta}/{'trash' if trash else 'manifests'}/_sources"
    if not os.path.isdir(folder):
        return spark.createDataFrame([], REGISTRY)
    return spark.read.schema(REGISTRY).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json.zst").json(folder)
