"""Incremental ingestion with Structured Streaming: new snapshot files are diffed, chunked, embedded and applied once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.store import CorpusStore


def ingest(spark: SparkSession, path: str, schema: StructType, store: CorpusStore, prepare: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Upsert prepare(batch) -> (id, text, meta, embedding) for all files that are there now and were not taken before.

    A batch that is run again after a failure replaces the same ids, so documents come once.
    """
    stream = spark.readStream.schema(schema).json(path)
    return stream.writeStream.foreachBatch(lambda batch, _: store.upsert(prepare(batch)) if not batch.isEmpty() else None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str, late: str, *, time: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts and sums of events(ts, value) by window and type; later rows than `late` are dropped. Works on batches and streams."""
    from pyspark.sql import functions as F

    own = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return own.groupBy(F.window(time, window), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), by, "n", "total")
