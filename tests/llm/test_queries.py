"""The queries' columns over a small folder of tables, against brute force."""

import random
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import html_extract, queries
from test_pairs import brute_join, brute_repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, path = random.Random(21), str(tmp_path_factory.mktemp("tables"))
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    base, passage = prose(60), prose(30)
    rows = [(k, prose(r.randint(1, 60)), "en", f"s{k % 3}", 0) for k in range(40)]
    rows += [(50 + k, base + " " + prose(k), "de", "s0", 0) for k in range(6)] + [(60, None, None, None, None), (61, "", "en", "s1", 0), (62, passage + " x", "en", "s1", 0), (63, "Token = \"a8Kd93LmQx72VbNw56TyUi01\"", "en", "s1", 0)]
    rows += [(100 + k, prose(30) + (" vileone grotty vileone" if k % 3 == 0 else ""), "en", "s2", 0) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(100 + k, 1, int(k % 3 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "u", f"<article><p>{base}</p></article>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, rows


def test_html_and_leaks_and_secrets(spark, folder):
    path, rows = folder
    for r in queries.op1_html_extraction(spark, path).collect():
        html = next(x.html for x in spark.read.parquet(f"{path}/pages.parquet").collect() if x.page_id == r.page_id)
        assert (r.text, r.n_chars) == (html_extract.main_text(html), len(html_extract.main_text(html)))
    assert [(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, path).collect()] == [(62, 1)]
    assert [r.doc_id for r in queries.op4_secret_scan(spark, path).where("is_secret").collect()] == [63]


def test_toxicity(spark, folder):
    path, rows = folder
    got = queries.op5_toxicity(spark, path).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(r.predicted == int(100 <= r.doc_id and r.doc_id % 3 == 1) for r in got if r.held_out) >= 0.9 * sum(r.held_out for r in got)


def test_repeats_and_links(spark, folder):
    path, rows = folder
    own = [(k, t) for k, t, *_ in rows]
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op6_suffix_dedup(spark, path).collect()}
    assert got == set(brute_repeats(own))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_jaccard_join(spark, path).collect()} == brute_join(own)


def test_packing(spark, folder):
    path, rows = folder
    tok, got = Tokenizer.from_file(queries.tokenizer_path()), {}
    for r in queries.op10_packing(spark, path).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, t, *_ in rows:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(got[k], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert r.start == at and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)


def test_pipeline_of_odd_tables(spark, folder, tmp_path):
    path, rows = folder
    got = {r.doc_id for r in corpus_pipeline.run(spark, path).select("doc_id").collect()}
    assert {k for k, t, *_ in rows if len((t or "").split()) >= 20} - got <= {62, *range(51, 56)} and not got & {60, 61, 62}
    # Repeated rows are one document; rows without an id and extra columns do no harm; an empty table gives no rows.
    docs = spark.read.parquet(f"{path}/documents.parquet")
    more = docs.unionByName(docs.where("doc_id = 50")).unionByName(docs.where("doc_id = 100").withColumn("doc_id", docs.doc_id * None))
    for name, table in (("more", more.selectExpr("*", "1 as _bad", "2 as component_id", "'x' as kept")), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    again = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/more").where("start = 0").select("doc_id").collect()]
    assert sorted(again, key=str) == sorted([*got, None], key=str)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
