import threading

import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.errors import StoreError
from lodestone.operators import sync
from lodestone.sources.files import report_formats, write_report
from lodestone.sources.state import StateStore
from lodestone.sources.store import CorpusStore
from lodestone.streaming.ingest import ingest

ROW = "id string, text string, meta map<string,string>, embedding array<float>"


def rows(spark, *items):
    return spark.createDataFrame([(i, t, m, [1.0]) for i, t, m in items], ROW)


def test_store_round_trip(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"))
    assert store.count() == 0
    store.upsert(rows(spark, ("a", "1", {"source_type": "pdf", "document_id": "d1"}), ("b", "2", {"source_type": "notion", "page_id": "p1"})))
    store.upsert(rows(spark, ("a", "new", {"source_type": "pdf", "document_id": "d1"}), ("c", "3", {"source_type": "pdf", "document_id": "d2"})))
    assert {r.id: r.text for r in store.get().collect()} == {"a": "new", "b": "2", "c": "3"}
    assert [r.id for r in store.get({"document_id": "d2"}).collect()] == ["c"]
    store.delete({"document_id": ""})
    assert store.count() == 3
    store.delete({"document_id": "d2"})
    store.delete({"source_type": "notion"})
    assert [r.id for r in store.get().collect()] == ["a"]
    store.replace_source("notion", rows(spark, ("n", "x", {"source_type": "notion"})))
    assert sorted(r.id for r in store.get().collect()) == ["a", "n"]
    with pytest.raises(StoreError):
        store.upsert(spark.createDataFrame([("q", "t", {}, None)], ROW))


def tables(spark):
    state = [("same_hash", "h", "t0", "2024-02-01T00:00:00Z", "", []), ("edited", "h", "t0", "2024-01-01T00:00:00Z", "", []), ("same_time", "x", "t1", "", "", ["k"]), ("equal", "h", "t0", "", "", ["e"]), ("gone", "h", "", "", "", [])]
    source = [("same_hash", "h2", "h", "2024-01-15T00:00:00Z"), ("edited", "h2", "h", "2024-01-15T00:00:00Z"), ("same_time", "y", "", "t1"), ("equal", "h", "", "t9"), ("fresh", "n", "", "t"), ("", "n", "", "t")]
    return (
        spark.createDataFrame(source, "page_id string, content_hash string, remote_hash string, last_edited_time string"),
        spark.createDataFrame(state, "page_id string, content_hash string, last_edited_time string, hash_written_at string, title string, indexed_ids array<string>"),
    )


def test_diff_and_next_state(spark):
    source, state = tables(spark)
    got = {r.page_id: r.status for r in sync.diff(source, state).collect()}
    assert got == {"same_hash": "skipped", "edited": "changed", "same_time": "skipped", "equal": "hash_unchanged", "fresh": "new", "gone": "removed"}
    loaded = {r.page_id: r.status for r in sync.diff(source, state, live=False).collect()}
    assert loaded["same_hash"] == "changed" and loaded["same_time"] == "changed"
    changes = sync.diff(source, state).selectExpr("*", "'T' as title")
    top = sync.summary(changes).first()
    assert (top.pages_seen, top.pages_new, top.pages_removed) == (5, 1, 1)
    after = {r.page_id: r for r in sync.next_state(changes, state, source.selectExpr("page_id", "array(page_id) as indexed_ids"), "now").collect()}
    assert set(after) == {"same_hash", "edited", "same_time", "equal", "fresh"}
    assert after["equal"].last_edited_time == "t9" and after["equal"].indexed_ids == ["e"] and after["edited"].content_hash == "h2"
    assert {r.page_id for r in sync.outbox(changes).collect()} == {"edited", "fresh"}


def test_apply_swaps_once(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"))
    store.upsert(rows(spark, ("gone_1", "x", {"page_id": "gone", "source_type": "notion"}), ("keep_1", "y", {"page_id": "equal", "source_type": "notion"})))
    source, state = tables(spark)
    sync.apply(store, sync.diff(source, state), rows(spark, ("fresh_1", "z", {"page_id": "fresh", "source_type": "notion"})))
    assert sorted(r.id for r in store.get().collect()) == ["fresh_1", "keep_1"]


def test_streaming_ingest_takes_files_once(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "a", "text": "t"}\n')
    store = CorpusStore(spark, str(tmp_path / "s"))
    prepare = lambda b: b.withColumns({"meta": F.create_map(F.lit("source_type"), F.lit("x")), "embedding": F.array(F.lit(1.0).cast("float"))})
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), StructType.fromDDL("id string, text string"), store, prepare, str(tmp_path / "c")).awaitTermination()
    assert store.count() == 1


def test_settings_and_formats(spark, tmp_path):
    s = Settings.from_env({"LODESTONE_TOP_K": "7", "LODESTONE_MMR_ENABLED": "Yes", "LODESTONE_RRF_K": "x", "LODESTONE_SECRETS": "a, b,"})
    assert (s.top_k, s.mmr_enabled, s.rrf_k, s.secrets) == (7, True, 60, ("a", "b")) and "secrets" not in s.public()
    assert report_formats([" .MD", "markdown", "csv"]) == ["md", "csv"] and report_formats([]) == ["json", "csv", "md"]
    with pytest.raises(ValueError):
        report_formats(["xls"])
    out = write_report(spark.createDataFrame([(1,)], "a int"), "# x", str(tmp_path / "r"), ["json", "md"])
    assert spark.read.json(out["json"]).count() == 1 and spark.read.text(out["md"]).first().value == "# x"


def test_state_store(spark, tmp_path):
    _, state = tables(spark)
    store = StateStore(spark, str(tmp_path / "state"))
    assert store.read().count() == 0
    store.write(state.unionByName(state.where("page_id = 'gone'")))
    store.upsert(state.where("page_id = 'edited'").withColumn("content_hash", F.lit("z")))
    store.remove(state.where("page_id = 'gone'"))
    assert {r.page_id: r.content_hash for r in store.read().collect()} == {"same_hash": "h", "edited": "z", "same_time": "x", "equal": "h"}
    store.clear()
    assert store.read().count() == 0 and len(list((tmp_path / "state").glob("CURRENT-*"))) == 2


def test_a_whole_sync_counts_failures_and_repairs(spark, tmp_path):
    source, state = tables(spark)
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=3)
    store.upsert(rows(spark, *((f"{p}_1", "x", {"page_id": p, "source_type": "notion"}) for p in ("gone", "equal", "edited"))))
    make = lambda b: b.select(F.concat("page_id", F.lit("_2")).alias("id"), F.lit("t").alias("text"), F.create_map(F.lit("page_id"), F.col("page_id"), F.lit("source_type"), F.lit("notion")).alias("meta"), F.array(F.lit(1.0).cast("float")).alias("embedding"))

    def refuse(page, sha):
        if page == "fresh":
            raise ValueError("down")

    got = sync.run(store, source.withColumn("title", F.lit("T")), state, make, "now", write_back=refuse)
    top = got.summary.first()
    assert (top.pages_new, top.pages_changed, top.hashes_written, top.hash_write_failures) == (1, 1, 1, 1)
    assert sorted(r.id for r in store.get().collect()) == ["edited_2", "equal_1", "fresh_2"]
    after = {r.page_id: list(r.indexed_ids) for r in got.state.collect()}
    assert after["fresh"] == ["fresh_2"] and after["edited"] == ["edited_2"] and "gone" not in after
    fixed = {r.page_id: (r.content_hash, list(r.indexed_ids)) for r in sync.repair_state(got.state, store).collect()}
    assert fixed["equal"] == ("h", ["equal_1"]) and fixed["same_time"] == ("", [])


def test_a_small_change_leaves_other_buckets(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=16)
    store.upsert(rows(spark, *((f"k{i}", "x", {"source_type": "pdf"}) for i in range(60))))
    before = store._current()["at"]
    store.upsert(rows(spark, ("k7", "y", {"source_type": "pdf"})))
    after = store._current()["at"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.count() == 60
    store.delete({"source_type": "pdf"})
    assert store.count() == 0


def test_a_value_opens_only_buckets_that_may_hold_it(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=32)
    store.upsert(rows(spark, *((f"k{i}", "x", {"source_type": "pdf", "document_id": f"d{i // 3}", "page_id": f"p{i // 2}"}) for i in range(240)), ("odd", "x", None)))
    homes = {r.id: r.b for r in store.read().select("id", F.pmod(F.xxhash64("id"), F.lit(32)).alias("b")).collect()}
    assert sorted(r.id for r in store.get({"document_id": "d5"}).collect()) == ["k15", "k16", "k17"]
    own = {homes[f"k{i}"] for i in (15, 16, 17)}
    assert own <= store.opened and len(store.opened) <= len(own) + 3
    assert store.get({"document_id": "d5", "page_id": "p0"}).count() == 0 and len(store.opened) <= 2
    assert store.get({"document_id": "none"}).count() == 0 and len(store.opened) <= 2
    assert store.get({"id": "odd"}).count() == 1 and len(store.opened) <= 3
    assert store.get({"source_type": "pdf"}).count() == 240
    store.delete({"document_id": "d5"})
    assert store.count() == 238 and len(store.opened) <= len(own) + 3
    store.replace_pages(spark.createDataFrame([("p0",), ("nowhere",)], "page_id string"), rows(spark, ("k0", "y", {"source_type": "pdf", "page_id": "p0"})))
    assert store.count() == 237 and len(store.opened) <= 8
    assert [r.text for r in store.get({"page_id": "p0"}).collect()] == ["y"]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=8, keep=50)
    store.upsert(rows(spark, *((f"k{i}", "x", {"source_type": "pdf", "page_id": f"p{i}"}) for i in range(20))))
    failed = []

    def write(i):
        try:
            own = CorpusStore(spark, store.path, keep=50)
            own.upsert(rows(spark, (f"n{i}", "y", {"source_type": "pdf", "page_id": f"n{i}"})))
            own.delete({"page_id": f"p{i}"})
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert sorted(r.id for r in store.read().collect()) == sorted([f"k{i}" for i in range(3, 20)] + ["n0", "n1", "n2"])
    assert store.versions() == list(range(1, 8)) and store.read(1).count() == 20
    store.rebucket(3)
    assert store.count() == 20 and set(store._current()["at"]) <= {"0", "1", "2"} and [r.id for r in store.get({"page_id": "p9"}).collect()] == ["k9"]
