"""Paged sources, lessons, layout units with a budget of images, resumable runs."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import catalog_sources
from lodestone.plans.lessons import lessons
from lodestone.plans.slow_run import SlowRun
from lodestone.sources import layout
from lodestone.sources.paged import Page, PagedSource, fetch_from, fetch_with, follow

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
@pytest.mark.parametrize("name", "lesson_units lesson_pages ocr_units slow_run".split())
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(catalog_sources.SQL[name])
    names = [c[0] for c in want.description]
    got = catalog_sources.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


class Tree:
    """A client that keeps its lists in a file and pages them by twos; it fails the first time that a page is asked for."""

    def __init__(self, options):
        self.path, self.lists = options["path"], json.load(open(f"{options['path']}/lists.json"))

    def starts(self, name):
        return [str(k) for k in range(0, len(self.lists[name]), 2)]

    def page(self, name, cursor):
        mark = f"{self.path}/asked-{name}-{cursor or 0}"
        with open(mark, "a") as f:
            f.write("x")
        if os.path.getsize(mark) == 1:
            raise ConnectionError("try again")
        own, at = self.lists.get(name, []), int(cursor or 0)
        return Page([{"id": i, "has_children": i is None or i in self.lists, "body": None} for i in own[at : at + 2]], str(at + 2) if at + 2 < len(own) else None)


@pytest.fixture
def tree(tmp_path):
    # z is below itself; b is below two parents; m is no list; one item has no id.
    lists = {"top": ["a", "b", "c", "d", "z"], "a": ["b", "m", None], "b": ["x", "x"], "z": ["y"], "y": ["z", "b"]}
    (tmp_path / "lists.json").write_text(json.dumps(lists))
    return {"client": "tests.test_sources:Tree", "path": str(tmp_path)}, lists


def walk(lists, name, path=(), trail=()):
    for k, i in enumerate(lists.get(name, [])):
        cycle = i in (*trail, name)
        yield (*path, k), i, cycle
        if i is not None and not cycle:
            yield from walk(lists, i, (*path, k), (*trail, name))


@pytest.mark.parametrize("chain", [1, 64])
def test_lists_are_followed_to_their_end(spark, tree, chain):
    options, lists = tree
    roots = spark.createDataFrame([("top",), ("top",), (None,), ("none",)], "list string")
    got = follow(roots, fetch_with(options, chain=chain, wait=0)).orderBy("path").collect()
    assert [(tuple(r.path), r.id, r.cycle) for r in got] == sorted(walk(lists, "top"))
    # A page is asked for once in a round, whoever waits for it, and again only after a failure.
    assert os.path.getsize(f"{options['path']}/asked-top-0") == 2
    table = [(n, at, [(i, i is None or i in lists, None) for i in own[at : at + 2]]) for n, own in lists.items() for at in range(0, len(own), 2)]
    held = spark.createDataFrame(table, "list string, at bigint, items array<struct<id string, has_children boolean, body string>>")
    assert [(r.path, r.id) for r in follow(roots, fetch_from(held)).orderBy("path").collect()] == [(r.path, r.id) for r in got]
    assert follow(roots.limit(0), fetch_from(held)).count() == 0


def test_source_by_cursors_and_as_a_stream(spark, tree, tmp_path):
    options, lists = tree
    spark.dataSource.register(PagedSource)
    options = options | {"list": "top", "wait": "0"}
    got = spark.read.format("paged").options(**options).load()
    assert got.rdd.getNumPartitions() == 3
    assert [r.id for r in got.orderBy(F.col("cursor").cast("int"), "position").collect()] == lists["top"]
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def take():
        stream = spark.readStream.format("paged").options(**options).load()
        stream.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert take() == sorted(lists["top"])
    lists["top"] += ["e", "f", "g"]  # the page that was open gets another item, and a new one comes
    (tmp_path / "lists.json").write_text(json.dumps(lists))
    assert take() == sorted(lists["top"])
    assert take() == sorted(lists["top"])
    with pytest.raises(Exception, match="the source failed"):
        spark.read.format("paged").options(**options | {"list": "gone", "tries": "1", "client": "tests.test_sources:Broken"}).load().collect()


class Broken(Tree):
    def starts(self, name):
        return ["0"]

    def page(self, name, cursor):
        raise ConnectionError("down\nfor good")


def test_lessons_of_nested_blocks(spark):
    text = lambda kind, t: json.dumps({"type": kind, kind: {"rich_text": [{"plain_text": t}]}})
    row = lambda *cells: json.dumps({"type": "table_row", "table_row": {"cells": [[{"plain_text": c}] for c in cells]}})
    image = json.dumps({"type": "image", "image": {"type": "file", "file": {"url": "u"}}})
    page = lambda i, t: (i, json.dumps({"id": i, "properties": {"Name": {"type": "title", "title": [{"plain_text": t}]}, "Week": {"type": "number", "number": 3}}}))
    pages = spark.createDataFrame([page("p", "First"), page("p", "First"), page("q", "Untitled Notion lesson"), (None, "{}")], "id string, body string")
    table = [
        ("p", 0, [("h", False, text("heading_1", "Head")), ("l", True, text("bulleted_list_item", "outer"))]),
        ("p", 2, [("t", True, json.dumps({"type": "table", "table": {}})), ("i", False, image), ("n", False, None)]),
        ("l", 0, [("k", False, text("bulleted_list_item", "inner"))]),
        ("t", 0, [("r", False, row("a", "b")), (None, False, row("c", "d"))]),
    ]
    got = lessons(pages, fetch_from(spark.createDataFrame(table, "list string, at bigint, items array<struct<id string, has_children boolean, body string>>")))
    assert [r.text for r in got.units.orderBy("ordinal").collect()] == ["# Head", "- outer", "- inner", "| a | b |\n| --- | --- |\n| c | d |", "[Image: image block]"]
    p, q = got.pages.orderBy("page_id").collect()
    assert (p.title, p.n_units, p.block_types, p.image_refs, p.skipped_empty) == ("First", 5, ["heading", "image", "list", "table"], ["u"], False)
    assert "Week: 3" in p.metadata_document
    assert (q.n_units, q.block_types, q.metadata_document, q.skipped_empty) == (0, [], None, True)


def test_budget_of_images(spark):
    """Images and pages without text share the budget, in page order; tables come last; what is beyond the budget is not read."""
    page = lambda *b, **more: {"blocks": [{"lines": [[x]]} if x else {"image": b"img"} for x in b]} | more
    docs = {b"1": [page("one", None, None), page(None, scan=b"scan", tables=[[["h"], ["v"]]]), page("", None, scan=b"scan")], b"2": [page("two", None)]}
    files = spark.createDataFrame([("d1", "a/1.pdf", bytearray(b"1")), ("d2", None, bytearray(b"2"))], "document_id string, path string, content binary")
    read = lambda b: {"text": b.decode()} if b == b"scan" else {"error": "no model"}
    own = layout.units(layout.layout(files, lambda c: docs[bytes(c)]), read, 4)
    got = [r for r in own.orderBy("meta.document_id", "ordinal").collect()]
    assert [(r.ordinal, r.text) for r in got if r.meta["document_id"] == "d1"] == [(0, "one"), *((n, "[Image without text]") for n in (1, 2, 3)), (4, "scan"), (5, "| h |\n| --- |\n| v |")]
    assert [(r.ordinal, r.text, r.meta.get("ocr_error")) for r in got if r.meta["document_id"] == "d2"] == [(0, "two", None), (1, "[Image without text]", "no model")]
    assert [r.meta["image_index"] for r in got if "image_index" in r.meta] == ["0", "1", "2", "3", "0"]
    with pytest.raises(Exception, match="no pages"):
        layout.layout(files, lambda c: []).collect()
    plan = layout.admitted(layout.layout(files, lambda c: docs[bytes(c)]), 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_killed_run_ends_like_one_that_was_not(spark, tmp_path):
    samples = spark.createDataFrame([(str(k), f"question {k}", None if k == 3 else "truth") for k in range(8)] + [("1", "question 1", "truth"), (None, "x", "y")], "sample_id string, question string, ground_truth string")
    retrieve = lambda rows: rows.where("sample_id <> '5'").select("pipeline_name", "sample_id", F.array(F.lit("c")).alias("contexts"), F.array(F.lit(1)).alias("source_ids"))

    def generate(prompt):
        if prompt.endswith("2"):
            raise ValueError("key k1 refused")
        return prompt.upper()

    judge = lambda q, a, c, t: {"faithfulness": 1.0, "context_recall": float("nan")}
    options = {"batch": 3, "attempts": 1, "secrets": ("k1",)}
    want = SlowRun(spark, str(tmp_path / "a"), **options)
    want.plan(samples, ["one", "two"])
    want.run(retrieve, generate, judge)
    told = {(r.pipeline_name, r.sample_id): r for r in want.records().collect()}
    assert len(told) == 16
    assert (told["one", "2"].error, told["one", "2"].attempt_count, told["one", "2"].source_ids) == ("key <redacted> refused", 2, ["1"])
    assert told["two", "4"].metrics == {"faithfulness": 1.0}
    assert told["two", "5"].ragas_error == "skipped: there are no contexts"

    class Killed(SlowRun):
        left, after = 2, False

        def _write(self, rows, folder):
            self.left -= 1
            if self.after:
                super()._write(rows, folder)
            if self.left == 0:
                raise RuntimeError("killed")
            if not self.after:
                super()._write(rows, folder)

    for after in (False, True):  # once before a batch is committed, once after that and before the stream knows
        run = Killed(spark, str(tmp_path / "b"), **options)
        run.after = after
        run.plan(samples, ["one", "two"])
        with pytest.raises(Exception, match="killed"):
            run.run(retrieve, generate, judge)
    run = SlowRun(spark, str(tmp_path / "b"), **options)
    run.plan(samples.limit(0), ["other"])
    assert 0 < run.records().count() < 16
    run.run(retrieve, generate, judge)
    assert {(r.pipeline_name, r.sample_id): r for r in run.records().collect()} == told
    assert run.retry(retrieve, str.upper, judge) == 2
    assert run.records().where("error <> ''").count() == 0 and run.records().count() == 16


def test_sources_are_filled_in_later(spark, tmp_path):
    samples = spark.createDataFrame([("1", "q", "t"), ("2", None, None)], "sample_id string, question string, ground_truth string")
    good = lambda rows: rows.where("sample_id = '1'").select("pipeline_name", "sample_id", F.array(F.lit("c")).alias("contexts"), F.array(F.lit("s")).alias("source_ids"))

    def down(rows):
        raise ConnectionError("down")

    run = SlowRun(spark, str(tmp_path / "r"))
    run.plan(samples, ["one"])
    run.run(down, str.upper)
    assert [(r.error, r.contexts, r.attempt_count) for r in run.records().collect()] == [("retrieval: down", [], 0)] * 2
    assert run.backfill(down) == 0
    assert run.backfill(good) == 1
    assert {r.sample_id: (r.error, r.source_ids) for r in run.records().collect()} == {"1": ("retrieval: down", ["s"]), "2": ("retrieval: down", [])}
    empty = SlowRun(spark, str(tmp_path / "e"))
    empty.plan(samples.limit(0), ["one"])
    empty.run(good, None)
    assert empty.records().count() == 0
