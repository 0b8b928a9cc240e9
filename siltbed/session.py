"""Session settings, the shared working folder, and size checks before a broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size of a join side that is broadcast on purpose.
BROADCAST_BYTES = 8 << 20

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8, **more: str) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory)
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``.
    Only where neither is set, on a single machine, a temporary folder is made; on a cluster that is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = getattr(context, "_siltbed_dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            folder = "file://" + tempfile.mkdtemp(prefix="siltbed-")
            context._siltbed_dir = folder
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may have ended first
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/siltbed/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: it cuts the lineage, survives the
    loss of any executor, and gives the optimiser the true size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate; the file size, compressed, for a table that was read and only narrowed."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def memory_bytes(df: DataFrame) -> int:
    """Rows times width as they lie in memory, strings, binaries and arrays by their true lengths: one aggregate."""
    width, lengths = 16, []
    for name, kind in df.dtypes:
        width += 16
        if kind in ("string", "binary"):
            lengths.append(F.octet_length(F.col(f"`{name}`")))
        elif kind.startswith(("array", "map", "struct")):
            lengths.append(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))))
    sums = [F.coalesce(F.sum(n.cast("bigint")), F.lit(0)) for n in lengths]
    row = df.agg(F.count(F.lit(1)), *sums).first()
    return row[0] * width + sum(row[1:])


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimate is below ``limit`` and so is the size in memory, which is measured then
    (a scan of at most ``limit`` bytes of files); beyond it the join is shuffled, where adaptive execution splits hot
    keys."""
    return F.broadcast(df) if estimated_bytes(df) <= limit and memory_bytes(df) <= limit else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per session."""
    context = spark.sparkContext
    if getattr(context, "_siltbed_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="siltbed-code-")) / "siltbed.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, f"siltbed/{source.relative_to(root)}")
    context.addPyFile(str(archive))
    context._siltbed_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
