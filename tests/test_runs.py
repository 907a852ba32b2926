"""The sync as a stream, embeddings by content, counters gathered while writing."""

import os
from datetime import timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import catalog_runs
from lodestone.operators import sync
from lodestone.plans.providers import embed
from lodestone.sources.embed_cache import EmbeddingCache
from lodestone.sources.scratch import observed
from lodestone.sources.store import CorpusStore
from lodestone.streaming.sync_stream import follow, into, statuses

DIR = "/root/testdata/sf0.001"
PAGES = "page_id string, content_hash string, remote_hash string, last_edited_time string, title string, text string, seen_at string"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
@pytest.mark.parametrize("name", "sync_stream sync_stream_store embedding_cache".split())
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.execute(catalog_runs.SQL[name])
    names = [c[0] for c in want.description]
    got = catalog_runs.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_stream_restarts_after_a_failed_batch(spark, tmp_path):
    """Each page once a day; a sink that fails once, blank ids, repeated sights, null fields, a page that comes back."""
    pages, progress, store, told = str(tmp_path / "in"), str(tmp_path / "c"), CorpusStore(spark, str(tmp_path / "s"), buckets=2), []
    prepare = lambda rows: rows.select("page_id", F.concat("page_id", F.lit("_0")).alias("id"), "text", F.create_map(F.lit("source_type"), F.lit("x"), F.lit("page_id"), F.col("page_id")).alias("meta"), F.array(F.lit(1.0).cast("float")).alias("embedding")).drop("page_id")
    apply, broken = into(store, prepare), [True]

    def sink(batch, n):
        apply(batch, n)
        if broken:
            broken.clear()
            raise ValueError("lost after the store was changed")
        told.extend((r.page_id, r.status) for r in batch.collect())

    def day(n, *rows):
        own = [(p, h, "", e, "", t, f"2024-03-0{n}T00:00:00Z") for p, h, e, t in rows]
        spark.createDataFrame(own, PAGES).withColumn("seen_at", F.to_timestamp("seen_at")).coalesce(1).write.mode("append").parquet(pages)
        stream = spark.readStream.schema(spark.read.parquet(pages).schema).parquet(pages)
        return follow(statuses(stream, patience=timedelta(hours=12)), sink, progress)

    with pytest.raises(Exception, match="lost after"):
        day(1, ("a", "1", "x", "first"), ("b", "1", "x", "first"), ("n", None, None, None), (" ", "1", "x", "blank"), (None, "1", "x", "none")).awaitTermination()
    day(2, ("a", "2", "y", "second"), ("a", "3", "z", "third"), ("n", None, None, None)).awaitTermination()
    assert sorted(told) == [("a", "changed"), ("a", "changed"), ("a", "new"), ("b", "new"), ("b", "removed"), ("n", "changed"), ("n", "new")]
    assert {r.id: r.text or "" for r in store.get().collect()} == {"a_0": "third", "n_0": ""}
    told.clear()
    day(3, ("a", "3", "z", "third"), ("b", "1", "x", "again")).awaitTermination()
    assert sorted(told) == [("a", "skipped"), ("b", "new"), ("n", "removed")]
    assert sorted(r.id for r in store.get().collect()) == ["a_0", "b_0"]


def test_cache_asks_once_for_each_text(spark, tmp_path):
    """Copies, blank and null texts, a second run, another writer, compaction, an empty table."""
    asked = spark.sparkContext.accumulator(0)

    def provider(texts):
        asked.add(len(texts))
        return [[float(len(t))] for t in texts]

    ask = lambda rows: embed(rows, provider=provider)
    rows = lambda *texts: spark.createDataFrame([(n, t, "mine") for n, t in enumerate(texts)], "id int, text string, sha string")
    cache, other = (EmbeddingCache(spark, str(tmp_path / "c"), "m") for _ in range(2))
    assert [r.embedding for r in cache.embed(rows("aa", "aa", "b", "", " ", None), ask).orderBy("id").collect()] == [[2.0], [2.0], [1.0]]
    assert asked.value == 2
    got = cache.embed(rows("b", "ccc", "ccc"), ask)
    assert got.columns == ["id", "text", "sha", "embedding"] and {r.sha for r in got.collect()} == {"mine"} and asked.value == 3

    def slower(found):
        other.fill(rows("dddd", "eeeee"), ask)
        return ask(found)

    cache.fill(rows("dddd", "ffffff"), slower)
    assert cache.read().count() == cache.read().select("sha").distinct().count() == 6
    versions = len(cache.log.versions())
    cache.fill(rows(), ask)
    cache.fill(rows("b"), ask)
    assert len(cache.log.versions()) == versions
    cache.compact()
    assert cache.read().count() == 6 and EmbeddingCache(spark, str(tmp_path / "c"), "other model").read().count() == 0


def test_counters_need_no_scan(spark, tmp_path):
    status = spark.range(100).selectExpr("if(id < 30, 'new', if(id < 90, 'skipped', 'removed')) as status")
    rows, counts = observed(status.repartition(3), "changes", **sync.counters())
    assert counts == {"pages_seen": 90, "pages_new": 30, "pages_changed": 0, "pages_hash_unchanged": 0, "pages_skipped": 60, "pages_removed": 10}
    assert counts == {k: v for k, v in sync.summary(rows).first().asDict().items() if k != "sync_mode"}
    none = spark.createDataFrame([], "status string")
    assert set(observed(none.join(status, "status"), "none", **sync.counters())[1].values()) == {0}
