import random

import corpus_pipeline


def test_pipeline_on_planted_documents(spark, tmp_path):
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = prose(40)
    base = prose(200)
    rows = [(i, prose(80), "en", f"s{i % 3}", 0) for i in range(30)]
    rows += [(100, base, "en", "s0", 0), (101, base + " more", "en", "s1", 0), (102, base, "en", "s2", 0)]
    rows += [(200, prose(50) + "\n" + passage.upper(), "en", "s0", 0), (300, "too short", "en", "s0", 0), (301, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert got == {*range(30), 100}


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "a " * 30, "en", "s", 60)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, "").columns == docs.columns


def test_rows_without_an_id_pass_unless_they_leak(spark, tmp_path):
    passage = "which river runs through the old copper town and turns north before it meets the sea"
    rows = [(None, "a clean text without an id"), (None, passage), (1, "another clean text with an id")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    left = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert sorted(x.text for x in left.collect()) == sorted(t for _, t in rows)
    clean = stages["decontamination"](spark, left, str(tmp_path))
    assert {x.text for x in clean.collect()} == {rows[0][1], rows[2][1]}


def test_near_duplicates_do_not_move_texts(spark, monkeypatch):
    """Over tables too large for Spark's own broadcast, no plan of the last step deals texts out; beyond SENT ids they are, with equal results."""
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    base = prose(200)
    rows = [(i, prose(60), "en", "s", 0) for i in range(20)] + [(50 + i, base + f" w{i}", "en", "s", 0) for i in range(5)]
    rows += [(3, rows[3][1], "de", "t", 0), (None, prose(9), "en", "s", 0), (60, "", "en", "s", 0), (61, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = stage(spark, docs, "")
        plan = left._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
        got = sorted((x.doc_id for x in left.collect()), key=str)
        assert got == sorted([*range(20), 50, 60, 61, None], key=str)
        monkeypatch.setattr(corpus_pipeline, "SENT", 1)
        assert sorted((x.doc_id for x in stage(spark, docs, "").collect()), key=str) == got
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
