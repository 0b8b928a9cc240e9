"""Incremental intake by Structured Streaming: each micro-batch stores the blobs that are new, then its counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltbed.operators.store import put


def intake(stream: DataFrame, content: str, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Store the contents of ``stream`` by hash. Putting is idempotent, so a batch that is run again after a failure
    adds nothing twice. Admission is limited by the source's maxFilesPerTrigger or maxBytesPerTrigger."""

    def each(batch: DataFrame, _: int) -> None:
        data = F.col(content).cast("binary")
        blobs = batch.where(F.col(content).isNotNull()).select(F.sha2(data, 256).alias("hash"), data.alias("payload"), F.octet_length(data).cast("bigint").alias("stored_size"))
        put(blobs, store)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Tumbling counts per key with a watermark; works on streams and on tables."""
    marked = events.withWatermark(time, late)
    return marked.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
