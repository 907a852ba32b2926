import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lodestone.functions import terms
from lodestone.functions.text import tokens
from lodestone.operators import bm25, fuse, rank, vectors
from lodestone.plans import answer, evaluate
from lodestone.plans.providers import NOT_FOUND, embed, first_of, hashed, rotate, with_retries

DOCS = [(1, "the range function counts", "a"), (2, "match-case in python", "a"), (3, "nothing here", "b"), (4, None, "b")]


def corpus(spark):
    return spark.createDataFrame(DOCS, "id long, text string, kind string")


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, question string")


def brute_bm25(docs, query):
    toks = {i: (t or "").split() for i, t, _ in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    out = {}
    for i, ts in toks.items():
        s = 0.0
        for q in dict.fromkeys(query.split()):
            df, tf = sum(q in x for x in toks.values()), ts.count(q)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avg))
        if s > 0:
            out[i] = round(s, 9)
    return out


def test_bm25_equals_the_formula(spark):
    got = bm25.search(corpus(spark), questions(spark, "python match-case python", "absent"), 5).collect()
    assert {r.id: r.keyword_score for r in got} == brute_bm25(DOCS, "python match-case")
    assert all(r.query_id == 0 for r in got)


def test_bm25_scores_in_place_and_keeps_ties_to_the_smaller_id(spark, monkeypatch):
    """Pairs of a document and a query are neither joined nor dealt out, however queries, documents and terms are cut."""
    r = random.Random(5)
    docs = [(i, " ".join(r.choice("a b c d e f g".split()) for _ in range(r.randrange(9))), "") for i in range(80)] + [(80 + i, "a b b rare", "") for i in range(9)]
    asked = ["a b", "c d e a", "rare g", "f", "nowhere", ""]
    for name, value in {"BLOCK": 3, "CELLS": 10, "ROWS": 7, "WIDE": 2}.items():
        monkeypatch.setattr(bm25, name, value)
    df = spark.createDataFrame(docs, "id long, text string, kind string").repartition(3)
    got = bm25.search(df, questions(spark, *asked), 4)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {(q, i, s, n) for q, text in enumerate(asked) for n, (i, s) in enumerate(sorted(brute_bm25(docs, text).items(), key=lambda x: (-x[1], x[0]))[:4], 1)}
    assert {(x.query_id, x.id, x.keyword_score, x.keyword_rank) for x in got.collect()} == want


def test_terms_counted_by_batches_are_the_tokens_of_columns(spark):
    texts = ["Crème brûlée, crème. .x. ... a..b v1.0.", "ΣΑΣ Ǆ ŉ İstanbul ẞ ﬁ K", "\u0301 e\u0301é \u0301", "plain ASCII, twice twice.", "", None, "Tiếng Việt ỹ Ỹ ё й", "一二 ab\u00a0c\x85d", "." * 50 + "é" + "." * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {x.id: (len(x.t), Counter(x.t)) for x in df.select("id", tokens(F.col("text")).alias("t")).collect()}
    assert {x.id: (x.dl, Counter({y.term: y.tf for y in x.t})) for x in terms.postings(df).collect()} == want
    asked = ["creme", "e", "twice", "viet"]
    assert {x.id: (x.dl, {asked[t]: f for t, f in zip(x.t, x.f, strict=True)}) for x in terms.counted(df, asked).collect()} == {i: (n, {t: c[t] for t in asked if c[t]}) for i, (n, c) in want.items()}


def test_filter_comes_before_statistics(spark):
    q = questions(spark, "range")
    whole = answer.retrieve(corpus(spark), q, 3, mode="keyword").first().keyword_score
    part = answer.retrieve(corpus(spark), q, 3, mode="keyword", where=F.col("kind") == "a").first().keyword_score
    assert whole != part and part == brute_bm25(DOCS[:2], "range")[1]


def test_vectors_are_exact_and_ties_go_to_the_smaller_id(spark):
    own = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, [])], "id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "query_id long, vector array<float>")
    got = vectors.search(own, q, 3).orderBy("vector_rank").collect()
    assert [(r.id, r.distance, r.vector_score) for r in got] == [(1, 0.0, 1.0), (3, 0.0, 1.0), (2, 2.0, round(1 / 3, 9))]


def test_lsh_finds_nine_of_ten_neighbours_and_k_rows(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 0.5) for _ in range(16)]) for i in range(400)] + [(500, None)]
    asked = [(i, rows[i][1]) for i in range(0, 400, 40)] + [(900, [50.0] * 16)]
    df, qs = spark.createDataFrame(rows, "id long, embedding array<double>"), spark.createDataFrame(asked, "query_id long, vector array<double>")
    found, exact = ({(x.query_id, x.id) for x in f(df, qs, 10).collect()} for f in (vectors.lsh_search, vectors.search))
    assert len(found) == len(exact) == 110 and len(found & exact) >= 0.9 * len(exact)


def test_lsh_compares_rows_of_shared_buckets_in_place(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(300)] + [(300, [math.nan] * 4)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    qs = df.where("id < 20").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    got = vectors.lsh_search(df, qs, 3, bucket=0.1, tables=2)
    # Pairs are not written: neither hashes of tables nor pairs that share one become rows of the plan.
    assert "hash" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    own, asked = (d.select(i, array_to_vector(F.col(v)).alias("features")) for d, i, v in ((df.where("id < 300"), "id", "embedding"), (qs, "query_id", "vector")))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=0.1, numHashTables=2, seed=7).fit(own)
    pairs = model.approxSimilarityJoin(own, asked, math.inf).select("datasetB.query_id", "datasetA.id").collect()
    met = {q: sorted((round(sum((a - b) ** 2 for a, b in zip(rows[q][1], rows[i][1], strict=True)), 9), i) for p, i in pairs if p == q) for q in range(20)}
    exact = {q: sorted((round(sum((a - b) ** 2 for a, b in zip(rows[q][1], v, strict=True)), 9), i) for i, v in rows[:300]) for q in range(20)}
    want = {q: [i for _, i in (met[q] if len(met[q]) >= 3 else exact[q])[:3]] for q in range(20)}
    assert any(len(m) < 3 for m in met.values()) and any(want[q] != [i for _, i in exact[q][:3]] for q in range(20))
    assert {q: [x.id for x in sorted(got.where(f"query_id = {q}").collect(), key=lambda x: x.vector_rank)] for q in range(20)} == want


def test_a_row_that_is_not_a_number_hides_no_other(spark):
    own = spark.createDataFrame([(1, [math.nan, 0.0]), (2, [math.nan, 1.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0])], "id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r.id for r in vectors.search(own, q, 3).orderBy("vector_rank").collect()] == [3, 4]


def test_rrf_prefers_both_channels_then_the_vector_hit(spark):
    v = spark.createDataFrame([(0, "a", 0.1, 0.9, 1), (0, "b", 0.2, 0.8, 2)], "query_id long, id string, distance double, vector_score double, vector_rank long")
    k = spark.createDataFrame([(0, "c", 5.0, 1), (0, "b", 4.0, 2)], "query_id long, id string, keyword_score double, keyword_rank long")
    got = fuse.rrf(v, k, 3, 3).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "c"] and got[0].rrf_score == round(2 / 62, 12)


def candidates(spark):
    rows = [(0, "q", 1, "a", "red apple pie", 0.9), (0, "q", 2, "b", "red apple pie", 0.8), (0, "q", 3, "c", "red apple pie now", 0.7), (0, "q", 4, "d", "blue sky", 0.6)]
    return spark.createDataFrame(rows, "query_id long, question string, rank long, id string, text string, rrf_score double")


def test_rerank_orders_drops_bad_indexes_and_survives_failures(spark):
    good = rank.rerank(candidates(spark), 3, lambda q, t: [(3, 0.9), (9, 0.5), (0, 0.1)], provider="x").orderBy("rerank_rank").collect()
    assert [(r.id, r.rerank_rank) for r in good] == [("d", 1), ("a", 3)]

    def fails(q, t):
        raise RuntimeError("down")

    bad = rank.rerank(candidates(spark), 2, fails).orderBy("rerank_rank").collect()
    assert [r.id for r in bad] == ["a", "b"] and bad[0].rerank_error == "down"
    assert [r.id for r in rank.rerank(candidates(spark), 2).orderBy("rank").collect()] == ["a", "b"]


def test_mmr_drops_the_duplicate_and_picks_the_diverse(spark):
    got = rank.mmr(candidates(spark), 2).orderBy("mmr_rank").collect()
    assert [r.id for r in got] == ["a", "d"]
    assert [r.id for r in rank.dedupe(candidates(spark)).orderBy("rank").collect()] == ["a", "c", "d"]
    few = rank.mmr(candidates(spark), 10).orderBy("mmr_rank").collect()
    assert [r.mmr_score for r in few] == [1.0] * 3


def test_flat_relevance(spark):
    flat = candidates(spark).withColumn("rrf_score", F.col("rrf_score") * 0)
    assert [r.relevance for r in rank.relevance(flat).orderBy("rank").collect()] == [1.0, 0.75, 0.5, 0.25]


def test_answers_cite_and_refuse(spark):
    own = embed(corpus(spark).where("id < 4"), 32)
    q = embed(questions(spark, "what does range count", "zzz"), 32, text="question", into="vector")
    got = {r.query_id: r for r in answer.answer(own, q, mode="keyword", top_k=2).collect()}
    assert got[0].answer == "the range function counts" and got[0].source_ids == ["1"]
    assert got[1].answer == NOT_FOUND and got[1].contexts == []


def test_baseline_answers_from_plain_chunks(spark):
    got = {r.query_id: r for r in answer.baseline(corpus(spark), questions(spark, "the range function counts", "")).collect()}
    assert got[0].answer == "the range function counts" and got[0].final_count == 2 and got[0].source_ids[0] == "1_chunk_0"
    assert got[1].answer == NOT_FOUND if 1 in got else True


def test_holders_of_passages(spark):
    docs = spark.createDataFrame([(1, "aa the quick brown fox jumps bb"), (2, "xthe quick brown fox jumpsy"), (3, "the quick brown"), (4, None), (5, "one two three")], "id long, text string")
    asked = [(0, "the quick brown fox jumps"), (1, "one two three"), (2, "fox j"), (3, None), (4, "quick brown fox jumps over a dog")]
    got = {(r.query_id, r.id) for r in evaluate.holders(docs, spark.createDataFrame(asked, "query_id long, question string")).collect()}
    assert got == {(0, 1), (0, 2), (1, 5), (2, 1), (2, 2)}


def test_judge_is_tried_again_and_tells_errors(spark):
    def judge(q, a, c, t):
        if q == "bad":
            raise ValueError("key s3cret refused")
        return {"faithfulness": 0.5}

    rows = [(f"s{i}", q, "an answer", "", ["c"], "truth") for i, q in enumerate(["good", "bad", "good"])] + [("s9", "good", "", "", ["c"], "truth")]
    df = spark.createDataFrame(rows, "sample_id string, question string, answer string, error string, contexts array<string>, ground_truth string")
    got = {r.sample_id: r for r in evaluate.score(df, judge, batch=2, attempts=1, secrets=("s3cret",)).collect()}
    assert got["s0"].metrics == {"faithfulness": 0.5} and got["s1"].ragas_error == "failed: key <redacted> refused" and got["s9"].ragas_error.startswith("skipped")
    open_ = evaluate.score(df, None).withColumn("metrics", F.lit(None).cast("map<string,double>"))
    again = {r.sample_id: r for r in evaluate.backfill(open_, judge).collect()}
    assert again["s2"].metrics == {"faithfulness": 0.5} and len(again) == 4


def test_judge_tries_all_keys_at_each_attempt(spark, tmp_path):
    def judge(q, a, c, t, key):
        calls = tmp_path / q
        with calls.open("a") as f:
            f.write(key)
        if q == "bad" or len(calls.read_text()) < 3:
            raise ValueError(f"{key} is used up")
        return {"faithfulness": 1.0}

    rows = [(q, q, "" if q == "none" else "an answer", "", ["c"], "truth") for q in ("good", "bad", "none")]
    df = spark.createDataFrame(rows, "sample_id string, question string, answer string, error string, contexts array<string>, ground_truth string")
    got = {r.sample_id: (r.metrics, r.ragas_error) for r in evaluate.score(df, judge, attempts=1, keys=("x", "y")).collect()}
    assert got["good"] == ({"faithfulness": 1.0}, None) and (tmp_path / "good").read_text() == "xyx"
    assert got["bad"] == (None, "failed: key 2/2: <redacted> is used up") and (tmp_path / "bad").read_text() == "xyxy"
    assert got["none"][1].startswith("skipped") and not (tmp_path / "none").exists()
    assert {r.sample_id: r.ragas_error for r in evaluate.score(df, judge, keys=()).collect()}["good"] == "failed: the judge has no key"


def test_providers():
    assert abs(sum(x * x for x in hashed("a b c", 16)) - 1) < 1e-9
    calls = []

    def flaky(prompt):
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("no\nnetwork")
        return "ok"

    assert with_retries(flaky, 2)("p") == ("ok", "", 3)
    assert with_retries(lambda p: 1 / 0, 1)("p")[1:] == ("division by zero", 2)

    def keyed(prompt, key):
        if key == "bad":
            raise ValueError(f"{key} refused")
        return key

    assert rotate(keyed, ("bad", "good"))("p") == "good"
    assert first_of(lambda p: 1 / 0, lambda p: "b")("p") == "b"


def test_evaluation_summary_and_report(spark):
    own = embed(corpus(spark).where("id < 4"), 32)
    samples = spark.createDataFrame([("s1", "range function", "counts", "", ["t"]), ("s2", "", "", "", [])], "sample_id string, question string, ground_truth string, expected_source_notes string, tags array<string>")
    samples = samples.join(embed(samples, 32, text="question", into="vector").select("sample_id", "vector"), "sample_id", "left")
    got = evaluate.run(own, samples, ["keyword"], judge=lambda q, a, c, t: {"faithfulness": 1.0, "context_recall": float("nan")})
    rows = {r.sample_id: r for r in evaluate.report_rows(got).collect()}
    assert list(rows["s1"].asDict()) == evaluate.REPORT_COLUMNS and rows["s1"].faithfulness == 1.0 and rows["s1"].context_recall is None
    assert rows["s2"].ragas_error.startswith("skipped")
    top = evaluate.summarize(got).first()
    assert top.question_count == 2 and top.faithfulness == 1.0 and top.context_recall is None
    assert "| keyword | 2 |" in evaluate.markdown(got, "x.jsonl", "now")


def test_candidates_are_written_before_they_meet_the_texts(spark):
    """A small written table tells its size, so it goes to the texts."""
    from lodestone import catalog

    assert any("lodestone-fused" in f for f in catalog.mmr_topk(spark, "/root/testdata/sf0.001").inputFiles())


def test_presets_read_only_texts_that_a_channel_found(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} common" if i < 3 else f"w{i}", [float(i)]) for i in range(40)], "id long, text string, embedding array<double>")
    samples = spark.createDataFrame([("a", "common", [1.0])], "sample_id string, question string, vector array<double>")
    seen = []
    monkeypatch.setattr(evaluate, "answer", lambda corpus, *a, **k: seen.append({r.id for r in corpus.collect()}) or answer.answer(corpus, *a, **k))
    got = {r.pipeline_name: r.source_ids for r in evaluate.run(docs, samples, ["vector", "keyword", "hybrid_rrf"], top_k=2, candidate_k=3, generator=None).collect()}
    assert seen == [{0, 1, 2}] * 3 and got["vector"] == ["1", "0"] and got["keyword"] == ["0", "1"]
