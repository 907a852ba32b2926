import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.errors import ConfigError
from lodestone.operators import blocks, chunk
from lodestone.sources import files


def test_settings_are_checked(spark):
    for size, overlap in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ConfigError):
            chunk.check(size, overlap)


def test_pieces_fall_from_paragraphs_to_sentences_to_windows():
    assert chunk.pieces("short", 10, 2) == ["short"]
    assert chunk.pieces("aaaa\n\nbbbb\n\ncccc", 10, 0) == ["aaaa\n\nbbbb", "cccc"]
    assert chunk.pieces("One two. Three four. Five.", 12, 0) == ["One two.", "Three four.", "Five."]
    assert chunk.windows("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert chunk.pack(["aaaa", "bbbb", "cccc"], 10, 4) == ["aaaa\n\nbbbb", "bbbb\n\ncccc"]
    assert all(len(c) <= 50 for c in chunk.pieces("word " * 200 + ". End. " * 30, 50, 10))


def test_simple_mode_keeps_long_lines():
    assert chunk.simple("aa\nbb\n" + "c" * 20, 6, 0) == ["aa\nbb", "c" * 20]


def test_documents(spark):
    docs = spark.createDataFrame([("d", "aaaa\n\nbbbb\n\ncccc", "m"), ("e", None, "m"), ("f", " ", "m")], "id string, text string, lang string")
    got = chunk.chunk_documents(docs, 10, 0).orderBy("chunk_id").collect()
    assert [(r.id, r.parent_id, r.text, r.lang) for r in got] == [("d_chunk_0", "d", "aaaa\n\nbbbb", "m"), ("d_chunk_1", "d", "cccc", "m")]


def units(spark, *rows):
    return spark.createDataFrame([(f"u{i}", i, t, m) for i, (t, m) in enumerate(rows)], "id string, ordinal long, text string, meta map<string,string>")


def test_units_stay_in_their_scope_under_their_heading(spark):
    page = lambda n, kind="paragraph": {"document_id": "d", "page_number": n, "block_type": kind, "source_granularity": "page_block"}
    got = chunk.chunk_units(units(spark, ("# Top", page("1", "heading")), ("one", page("1")), ("two", page("1")), ("three", page("2")), ("x" * 25, page("2", "equation"))), 20, 0).orderBy("chunk_id").collect()
    assert [(r.id, r.text) for r in got][:2] == [("d_page_1_page_block_chunk_0", "Top\none\n\ntwo"), ("d_page_2_page_block_chunk_1", "three")]
    assert [(r.text, r.split_part) for r in got][2:] == [("x" * 20, 0), ("x" * 5, 1)]
    assert got[0].text.count("Top") == 1 and got[0].unit_ids == ["u1", "u2"]


def text(*parts):
    return {"rich_text": [{"plain_text": p} for p in parts]}


def test_block_trees(spark):
    tree = [
        {"id": "h", "type": "heading_1", "heading_1": text("Intro")},
        {"id": "p", "type": "paragraph", "paragraph": text("# Pasted\n- item\nplain\nmore\n2) two")},
        {"id": "b", "type": "bulleted_list_item", "bulleted_list_item": text("- dot"), "children": [{"id": "t", "type": "to_do", "to_do": text("do") | {"checked": True}}]},
        {"id": "c", "type": "code", "code": text("x = 1") | {"language": "python"}},
        {"id": "i", "type": "image", "image": {"type": "external", "external": {"url": "http://x/y.png"}, "caption": [{"plain_text": "cap"}]}},
        {"id": "g", "type": "table", "table": {}, "children": [{"type": "table_row", "table_row": {"cells": [[{"plain_text": "a"}], [{"plain_text": "b|c"}]]}}]},
        {"id": "z", "type": "divider", "divider": {}},
    ]
    pages = spark.createDataFrame([("pg", json.dumps(tree), {"title": "T"}), ("none", None, None)], "page_id string, blocks string, meta map<string,string>")
    got = blocks.parse_pages(pages, lambda url: {"text": "seen", "provider": "stub"}).orderBy("ordinal").collect()
    assert [r.text for r in got] == ["# Intro", "Pasted", "- item", "plain more", "2. two", "- dot", "- [x] do", "```python\nx = 1\n```", "[Image: cap]\n\nOCR/Vision:\nseen", "| a | b\\|c |\n| --- | --- |", "---"]
    assert got[1].meta["heading_path"] == "Pasted" and got[2].meta["line_index"] == "1" and got[0].id == "notion_pg_block_h"
    assert got[8].image_url == "http://x/y.png" and got[9].meta["table_row_count"] == "1"
    assert blocks.to_markdown(blocks.parse_pages(pages)).first().markdown.startswith("# Intro\n\nPasted")


def test_a_page_is_read_once_in_order_wherever_batches_end(spark):
    r = random.Random(4)
    choice = ["# A", "## B", "### C", "#### D", "- [x] t", "* b", "3) n", "plain", "more", "", "  ", "#", "# \u00a0x"]
    trees, want = [], {}
    for page in range(12):
        found, at = [], 0
        page_blocks = [[r.choice(choice) for _ in range(r.randrange(7))] for _ in range(5)]
        for lines in page_blocks:
            live = [x.strip() for x in lines if x.strip(" ")]
            got = [blocks.line_parts(x) for x in ([x.strip(" ") for x in lines] if len(live) > 1 else live)]
            for key, group in itertools.groupby(enumerate(got), lambda x: -1 if x[1][0] == "paragraph" and x[1][1] else x[0]):
                group = [g for _, g in group]
                text = " ".join(g[1] for g in group)
                if text:
                    found.append((at, group[0][0], text, group[0][2]))
                    at += 1
        tree = [{"id": str(i), "type": "paragraph", "paragraph": {"rich_text": [{"plain_text": "\n".join(lines)}]}} for i, lines in enumerate(page_blocks)]
        trees.append((f"p{page}", json.dumps(tree), {"page": str(page)}))
        want[f"p{page}"] = found
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = blocks.parse_pages(spark.createDataFrame(trees, "page_id string, blocks string, meta map<string,string>").repartition(3))
        got = df.collect()
        flat = blocks.flatten(spark.createDataFrame(trees, "page_id string, blocks string, meta map<string,string>")).orderBy(F.rand(1))
        assert sorted((x.page_id, x.ordinal, x.text) for x in blocks.parse_flat(flat).collect()) == sorted((x.page_id, x.ordinal, x.text) for x in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not re.search("Window|Aggregate", df._jdf.queryExecution().optimizedPlan().toString())
    rows = [(p, n, level, text) for p, found in want.items() for n, _, text, level in found]
    paths = {(x.page, x.n): x.heading_path for x in blocks.heading_paths(spark.createDataFrame(rows, "page string, n long, level long, text string"), "page", "n").collect()}
    assert {(x.page_id, x.ordinal): (x.meta["block_type"], x.text, x.meta["heading_path"]) for x in got} == {(p, n): (kind, text, paths[p, n]) for p, found in want.items() for n, kind, text, _ in found}


def test_line_parts_equal_line_class(spark):
    lines = ["# A", "####### x", "#x", "## a ## ", "- [X] done", "- [ ] ", "- [y] b", "+ b", "• c", "12. d", "3)e", "x - y", "#\tq", "-  [x] z", "１. wide"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", blocks.line_class(F.col("line")).alias("c")).collect()
    assert [tuple(x.c) for x in got] == [blocks.line_parts(x.line) for x in got]


def test_heading_paths_forget_deeper_levels(spark):
    rows = [("d", 0, 1, "A"), ("d", 1, 3, "B"), ("d", 2, None, "x"), ("d", 3, 2, "C"), ("d", 4, 1, "D")]
    df = spark.createDataFrame(rows, "doc string, n long, level long, text string")
    got = blocks.heading_paths(df, "doc", "n").orderBy("n").collect()
    assert [r.heading_path for r in got] == ["A", "A > B", "A > B", "A > C", "D"]


def test_heading_paths_equal_a_stack(spark):
    r = random.Random(5)
    rows = [(f"d{i % 7}", i, r.choice([None, 1, 2, 3, 3]), f"t{i}") for i in range(300)]
    got = {x.n: x.heading_path for x in blocks.heading_paths(spark.createDataFrame(rows, "doc string, n long, level long, text string"), "doc", "n").collect()}
    stacks: dict = {}
    for doc, n, level, text_ in rows:
        own = stacks.setdefault(doc, [])
        if level:
            own[level - 1 :] = [text_]
        assert got[n] == " > ".join(own)


def test_block_tree_by_recursion(spark):
    rows = [("p", "a", None, 0), ("p", "b", "a", 0), ("p", "c", "b", 1)]
    got = blocks.block_tree(spark.createDataFrame(rows, "page_id string, id string, parent_id string, position int")).orderBy("depth").collect()
    assert [(r.id, r.depth, list(r.path)) for r in got] == [("a", 1, [0]), ("b", 2, [0, 0]), ("c", 3, [0, 0, 1])]


def test_pdf_units_with_a_parser(spark):
    page = {"blocks": [{"lines": [["Hello ", "world"], [" "]], "bbox": [0, 1, 2, 3]}, {"image": b"x"}], "tables": [[["a", None], ["b", "c\nd"]]]}
    docs = spark.createDataFrame([("/x/a.pdf", b"raw", "sha")], "path string, content binary, document_id string")
    got = files.pdf_units(docs, lambda c: [page, {"blocks": []}], ocr=lambda b: {"error": "no model"}).orderBy("ordinal").collect()
    assert [r.text for r in got] == ["Hello world", "[Image without text]", "| a |  |\n| --- | --- |\n| b | c d |"]
    assert got[0].meta["bbox"] == "0.00,1.00,2.00,3.00" and got[1].meta["ocr_error"] == "no model"
    assert [r.text for r in files.pdf_pages(docs, lambda c: [page]).collect()] == ["Hello world"]


def test_testset_counts_physical_lines(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"question": "a", "ground_truth": "g"}\n\n{"query": "b", "tags": ["x"]}\n')
    got = files.read_testset(spark, str(tmp_path / "t.jsonl")).collect()
    assert [(r.sample_id, r.question, r.ground_truth, r.tags) for r in got] == [("q001", "a", "g", []), ("q003", "b", "", ["x"])]
