"""Queries of the sync as a stream and of embeddings kept by content, over the driver's tables, each with its SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _SYNC, _query, _sync_tables, _t, _texts
from .catalog_pages import QUERIES, SQL
from .plans.providers import embed
from .sources.embed_cache import EmbeddingCache
from .sources.scratch import fresh_path
from .sources.store import CorpusStore
from .streaming.sync_stream import follow, into, statuses

__all__ = ["QUERIES", "SQL"]

_DAYS = [f"2024-03-0{n}T00:00:00Z" for n in (1, 2)]


@_query(f"WITH {_SYNC} SELECT page_id, status FROM diff")
def sync_stream(spark: SparkSession, d: str) -> DataFrame:
    """The statuses of sync_diff by keyed state: the old state is what the stream begins with, the source is its first snapshot."""
    source, known = _sync_tables(spark, d, "text")
    pages, out = fresh_path(spark, "pages"), fresh_path(spark, "statuses")
    source.withColumns({"title": F.lit(""), "seen_at": F.lit(_DAYS[1]).cast("timestamp")}).write.parquet(pages)
    stream = spark.readStream.schema(spark.read.parquet(pages).schema).parquet(pages)
    found = statuses(stream, known.withColumn("title", F.lit("")), _DAYS[0], patience=timedelta(hours=12))
    follow(found, lambda batch, n: batch.select("page_id", "status").write.mode("overwrite").parquet(f"{out}/n={n}"), fresh_path(spark, "progress")).awaitTermination()
    return spark.read.schema("page_id string, status string").parquet(out).select("page_id", "status")


@_query(
    """SELECT doc_id::VARCHAR AS page_id, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'new,changed' WHEN doc_id % 4 = 1 THEN 'new,hash_unchanged' ELSE 'new,skipped' END AS statuses, sha256(text) AS stored FROM documents
UNION ALL SELECT (-doc_id - 1)::VARCHAR, 'new,removed', NULL FROM documents WHERE doc_id % 9 = 0"""
)
def sync_stream_store(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of a source, the second one taken by a stream started anew: what each page went through, and what the store then holds of it."""
    docs, number = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("page_id"), "doc_id", "text"), F.col("doc_id")
    old = docs.where(number % 7 != 0).withColumn("text", F.when(number % 5 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text")))
    gone = docs.where(number % 9 == 0).withColumn("page_id", (-number - 1).cast("string"))
    later = (number % 5 == 0) | (number % 4 == 1)
    pages, out, progress = (fresh_path(spark, n) for n in ("pages", "statuses", "progress"))
    store = CorpusStore(spark, fresh_path(spark, "store"), buckets=8)
    meta = F.create_map(F.lit("source_type"), F.lit("wiki"), F.lit("page_id"), F.col("page_id"))
    apply = into(store, lambda rows: rows.select(F.concat("page_id", F.lit("_0")).alias("id"), "text", meta.alias("meta"), F.array(F.lit(1.0).cast("float")).alias("embedding")))

    def sink(batch: DataFrame, n: int) -> None:
        batch.select("page_id", "status", "seen").write.mode("overwrite").parquet(f"{out}/n={n}")
        apply(batch, n)

    for k, (day, snapshot) in enumerate(zip(_DAYS, (old.unionByName(gone), docs), strict=True)):
        edited = F.when(later & F.lit(k == 1), day).otherwise("2024-01-01T00:00:00Z")
        rows = snapshot.select("page_id", F.sha2("text", 256).alias("content_hash"), F.lit("").alias("remote_hash"), edited.alias("last_edited_time"), F.lit("").alias("title"), "text", F.lit(day).cast("timestamp").alias("seen_at"))
        rows.write.mode("append").parquet(pages)
        stream = spark.readStream.schema(rows.schema).parquet(pages)
        follow(statuses(stream, patience=timedelta(hours=12)), sink, progress).awaitTermination()
    told = spark.read.schema("page_id string, status string, seen bigint, n bigint").parquet(out)
    told = told.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "status"))), lambda s: s["status"]), ",").alias("statuses"))
    held = store.get().select(F.col("meta")["page_id"].alias("page_id"), F.sha2("text", 256).alias("stored"))
    return told.join(held, "page_id", "left")


def _letters(texts: list[str]) -> list[list[float]]:
    """An embedding that SQL can tell: characters, blanks and the letter e."""
    return [[float(len(t)), float(t.count(" ")), float(t.count("e"))] for t in texts]


@_query(
    """SELECT doc_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS es, 1::BIGINT AS kept FROM documents WHERE trim(text) <> ''"""
)
def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents by a cache that had those of every other one; and how often the cache holds each."""
    docs, cache = _texts(spark, d).select("doc_id", "text"), EmbeddingCache(spark, fresh_path(spark, "vectors"), "letters")
    ask = lambda rows: embed(rows, provider=_letters)
    cache.fill(docs.where("doc_id % 2 = 0"), ask)
    got = cache.embed(docs, ask)
    kept = cache.read().groupBy("sha").agg(F.count("*").alias("kept"))
    part = lambda n, name: F.col("embedding")[n].cast("double").alias(name)
    return got.join(kept, got["text"].isNotNull() & (EmbeddingCache.key() == kept["sha"])).select("doc_id", part(0, "chars"), part(1, "blanks"), part(2, "es"), "kept")
