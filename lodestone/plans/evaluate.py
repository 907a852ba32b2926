"""Evaluation of pipelines over a test set: records, summaries and reports."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Settings
from ..errors import one_line
from ..functions.text import escape_markdown, finite, join_list, metric_summary, preview
from ..sources.scratch import materialize
from .answer import MODES, answer, channels

# Metrics of the judge, the presets, and the columns of the report.
METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
PRESETS = {
    "vector": {"label": "Vector only", "mode": "vector", "rerank": False, "mmr": False},
    "keyword": {"label": "BM25 keyword only", "mode": "keyword", "rerank": False, "mmr": False},
    "hybrid_rrf": {"label": "Hybrid RRF", "mode": "hybrid_rrf", "rerank": False, "mmr": False},
    "hybrid_rrf_rerank": {"label": "Hybrid RRF + rerank", "mode": "hybrid_rrf", "rerank": True, "mmr": False},
    "hybrid_rrf_rerank_mmr": {"label": "Hybrid RRF + rerank + MMR", "mode": "hybrid_rrf", "rerank": True, "mmr": True},
}
REPORT_COLUMNS = (
    "pipeline_name pipeline_label sample_id question answer error attempt_count generation_skipped ground_truth expected_source_notes tags source_count "
    "source_ids source_titles retrieved_count reranked_count final_count retrieval_mode candidate_k rerank_enabled mmr_enabled faithfulness "
    "answer_relevancy context_precision context_recall ragas_error"
).split()

#: judge(question, answer, contexts, ground_truth) -> metric values; runs on executors. With keys, a key comes last.
Judge = Callable[..., dict[str, float]]
#: Records that go to a judge between two delays.
JUDGE_BATCH = 4


def run(corpus: DataFrame, samples: DataFrame, presets: list[str], *, top_k: int = 4, candidate_k: int | None = None, limit: int | None = None, judge: Judge | None = None, **options: object) -> DataFrame:
    """Records of samples(sample_id, question, ground_truth, ..., [vector]) for each preset, as one plan."""
    if limit:
        samples = samples.orderBy("sample_id").limit(limit)
    asked = samples.withColumnRenamed("sample_id", "query_id")
    # The channels are searched once, as deep as any preset needs.
    settings = options.get("settings") or Settings()
    deep = {n: candidate_k or (settings.rerank_candidates if PRESETS[n]["rerank"] or PRESETS[n]["mmr"] else top_k) for n in presets}
    found = channels(corpus, asked, max([top_k, *deep.values()]), {MODES[PRESETS[n]["mode"]] for n in presets}, settings=settings, where=options.get("where"))
    # Texts are looked up once, for what any channel found; presets then read these rows alone.
    ids = None
    for hits in found.values():
        ids = hits.select("id") if ids is None else ids.unionByName(hits.select("id"))
    if ids is not None:
        corpus = materialize(corpus.join(materialize(ids.distinct(), "found"), "id", "left_semi"), "held")
    out = None
    for name in presets:
        p = PRESETS[name]
        got = answer(corpus, asked, mode=p["mode"], rerank=p["rerank"], mmr=p["mmr"], top_k=top_k, candidate_k=candidate_k, found=found, **options)
        got = got.withColumnRenamed("query_id", "sample_id").withColumns(
            {"pipeline_name": F.lit(name), "pipeline_label": F.lit(p["label"]), "retrieval_mode": F.lit(p["mode"]), "candidate_k": F.lit(deep[name]).cast("long"), "rerank_enabled": F.lit(p["rerank"]), "mmr_enabled": F.lit(p["mmr"])}
        )
        out = got if out is None else out.unionByName(got)
    extra = [c for c in ("ground_truth", "expected_source_notes", "tags") if c in samples.columns]
    out = out.join(samples.select("sample_id", *extra), "sample_id")
    return score(out, judge)


def skip_reason(error: Column, answer_: Column, contexts: Column, truth: Column) -> Column:
    """Why a record cannot be judged; null if it can. The first reason of four counts, for each record by itself."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(~blank(error), F.concat(F.lit("skipped: the answer failed: "), error))
        .when(blank(answer_), "skipped: the answer is empty")
        .when(F.coalesce(F.size(contexts), F.lit(0)) < 1, "skipped: there are no contexts")
        .when(blank(truth), "skipped: there is no reference")
    )


def score(records: DataFrame, judge: Judge | None, *, batch: int = JUDGE_BATCH, delay: float = 0.0, attempts: int = 0, secrets: tuple[str, ...] = (), keys: tuple[str, ...] | None = None) -> DataFrame:
    """records with metrics map<string,double> (finite values only) and ragas_error.

    Records that cannot be judged are not sent and tell why. After each batch a task waits for the delay; a record whose
    judge fails is tried again up to `attempts` times, each time with all keys in order, and then tells the last error and
    which key had it, keys and secrets masked. Given no keys (an empty tuple), records that could be judged tell that;
    keys=None is a judge that needs none.
    """
    truth = F.col("ground_truth") if "ground_truth" in records.columns else F.lit(None).cast("string")
    own = records.withColumn("ragas_error", skip_reason(F.col("error"), F.col("answer"), F.col("contexts"), truth))
    if judge is None:
        return own.withColumns({"metrics": F.lit(None).cast("map<string,double>"), "ragas_error": F.lit(None).cast("string")})

    @F.pandas_udf("metrics map<string,double>, error string")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        sent = 0
        for asked in batches:
            out: list[tuple[dict | None, str | None]] = []
            for skip, *row in zip(*asked, strict=True):
                if skip is not None:
                    out.append((None, None))
                    continue
                if sent and sent % batch == 0:
                    time.sleep(delay)
                sent += 1
                out.append(_judged(judge, row, attempts, delay, secrets, keys))
            yield pd.DataFrame({"metrics": pd.Series([m for m, _ in out], dtype=object), "error": pd.Series([e for _, e in out], dtype=object)})

    own = own.withColumn("_got", run("ragas_error", "question", "answer", "contexts", truth))
    return own.withColumns({"metrics": F.map_filter("_got.metrics", lambda k, v: finite(v).isNotNull()), "ragas_error": F.coalesce("ragas_error", "_got.error")}).drop("_got")


def _judged(judge: Judge, row: list, attempts: int, delay: float, secrets: tuple[str, ...], keys: tuple[str, ...] | None) -> tuple[dict | None, str | None]:
    if keys == ():
        return None, "failed: the judge has no key"
    question, answer_, contexts, truth = row
    asked = (question, answer_, [] if contexts is None else list(contexts), truth)
    tries = [("", ())] if keys is None else [(f"key {k}/{len(keys)}: ", (key,)) for k, key in enumerate(keys, 1)]
    error = ""
    for n in range(attempts + 1):
        for which, key in tries:
            try:
                return {k: float(v) for k, v in judge(*asked, *key).items()}, None
            except Exception as e:  # noqa: BLE001  told in the record
                error = which + one_line(e, (*secrets, *(keys or ())))
        if n < attempts:
            time.sleep(delay)
    return None, f"failed: {error}"


def backfill(records: DataFrame, judge: Judge, **options: object) -> DataFrame:
    """records with those judged anew that have an answer but neither metrics nor a reason; the others stay as they are."""
    open_ = F.col("metrics").isNull() & F.col("ragas_error").isNull()
    done = records.where(~open_)
    return done.unionByName(score(records.where(open_).drop("metrics", "ragas_error"), judge, **options).select(*done.columns))


def summarize(records: DataFrame) -> DataFrame:
    """One row per pipeline: questions, mean contexts and sources, and means of the finite metric values (null if none)."""
    means = [F.avg(finite(F.col("metrics").getItem(m))).alias(m) for m in METRICS]
    return records.groupBy("pipeline_name").agg(F.count("*").alias("question_count"), F.coalesce(F.avg(F.size("contexts")), F.lit(0.0)).alias("average_context_count"), F.coalesce(F.avg(F.size("source_ids")), F.lit(0.0)).alias("average_source_count"), *means)


def report_rows(records: DataFrame) -> DataFrame:
    """Records as the report's 26 columns; lists are joined, missing values blank or null."""
    have = set(records.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    titles = F.col("source_titles") if "source_titles" in have else F.col("source_ids")
    metric = {m: finite(F.col("metrics").getItem(m)) for m in METRICS}
    special = metric | {"tags": join_list(F.col("tags")) if "tags" in have else F.lit(""), "source_count": F.size("source_ids").cast("long"), "source_ids": join_list(F.col("source_ids")), "source_titles": join_list(titles)}
    typed = {"attempt_count", "generation_skipped", "retrieved_count", "reranked_count", "final_count", "candidate_k", "rerank_enabled", "mmr_enabled"}
    return records.select(*(special[c].alias(c) if c in special else F.col(c) if c in typed else text(c).alias(c) for c in REPORT_COLUMNS))


def pending(samples: DataFrame, done: DataFrame) -> DataFrame:
    """(pipeline_name, sample) pairs that have no complete record yet: an answer or an error, with metrics or an error of them."""
    complete = done.where((F.trim(F.coalesce("answer", F.lit(""))) != "") | (F.coalesce("error", F.lit("")) != "")).where(F.col("metrics").isNotNull() | F.col("ragas_error").isNotNull() | (F.coalesce("error", F.lit("")) != ""))
    return samples.join(complete.select("pipeline_name", "sample_id"), ["pipeline_name", "sample_id"], "left_anti")


def upsert_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records by pipeline and sample; new ones replace old ones."""
    return old.join(new.select("pipeline_name", "sample_id"), ["pipeline_name", "sample_id"], "left_anti").unionByName(new, allowMissingColumns=True)


def detail_lines(records: DataFrame) -> DataFrame:
    """(pipeline_name, sample_id, line): a Markdown table line for each record."""
    debug = F.format_string("retrieved=%d; reranked=%d; final=%d", "retrieved_count", "reranked_count", "final_count")
    sources = F.array_join(F.transform(F.slice("source_ids", 1, 5), escape_markdown), "<br>")
    error = escape_markdown(preview(F.col("error"), 220))
    cells = [escape_markdown(F.col("sample_id")), escape_markdown(F.col("question")), escape_markdown(preview(F.col("answer"), 180)), F.coalesce(F.nullif(sources, F.lit("")), F.lit("-")), F.concat(F.lit("`"), debug, F.lit("`")), F.col("attempt_count").cast("string"), escape_markdown(metric_summary(F.col("metrics"))), F.coalesce(F.nullif(error, F.lit("")), F.lit("-"))]
    return records.select("pipeline_name", "sample_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown(records: DataFrame, testset: str, now: str) -> str:
    """The Markdown report: a summary line per pipeline, then its records. A report is as long as the test set, not the corpus."""
    top = {r.pipeline_name: r for r in summarize(records).toLocalIterator()}
    lines = ["# Retrieval evaluation", "", f"- Generated at: `{now}`", f"- Test set: `{testset}`", "", "| Pipeline | Questions | Contexts | Sources | Metrics |", "| --- | ---: | ---: | ---: | --- |"]
    for name in sorted(top):
        r = top[name]
        metrics = ", ".join(f"{m}={r[m]:.3f}" for m in METRICS if r[m] is not None) or "not run"
        lines.append(f"| {name} | {r.question_count} | {r.average_context_count:.2f} | {r.average_source_count:.2f} | {metrics} |")
    last = None
    for r in detail_lines(records).orderBy("pipeline_name", "sample_id").toLocalIterator():
        if r.pipeline_name != last:
            last = r.pipeline_name
            lines += ["", f"## {last}", "", "| ID | Question | Answer | Sources | Funnel | Attempts | Metrics | Error |", "| --- | --- | --- | --- | --- | ---: | --- | --- |"]
        lines.append(r.line)
    return "\n".join(lines) + "\n"


#: Words of the window by which passages and documents are joined; windows that are sent to every executor.
WORDS, BROADCAST_WINDOWS = 4, 200_000


def holders(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, id): docs(id, text) that hold the text of passages(query_id, question), whatever stands around it.

    All words of a passage but its first and last are words of a text that holds it; a window of them is joined by its hash, and
    what is found is verified. Passages of fewer than three words are compared with every document.
    """
    cut = lambda c: F.split(c, r"\s+")
    asked = passages.where("question is not null").select("query_id", "question", cut(F.col("question")).alias("_w"))
    inner = F.size("_w") - 2
    out = None
    for n, whose in ((WORDS, inner >= WORDS), (1, (inner > 0) & (inner < WORDS))):
        keys = asked.where(whose).select("query_id", "question", F.xxhash64(F.slice("_w", 2, n)).alias("_key"))
        if keys.isEmpty():
            continue
        if keys.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
            keys = F.broadcast(keys)
        held = docs.select("id", cut(F.col("text")).alias("_w")).where(F.size("_w") >= n)
        held = held.select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.xxhash64(F.slice("_w", i, F.lit(n)))))).alias("_key"))
        met = held.join(keys, "_key").select("id", "query_id", "question").distinct()
        found = met.join(docs.select("id", "text"), "id").where(F.contains("text", "question")).select("query_id", "id")
        out = found if out is None else out.unionByName(found)
    short = asked.where(inner <= 0).select("query_id", "question")
    if out is None or not short.isEmpty():
        found = docs.select("id", "text").join(short, F.contains("text", "question")).select("query_id", "id")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def recall_at_k(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, n_relevant, n_found, recall) over queries with a relevant id."""
    found = hits.where(F.col("rank") <= k).join(relevant, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n_found"))
    return relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant")).join(found, "query_id", "left").select("query_id", "n_relevant", F.coalesce("n_found", F.lit(0)).alias("n_found"), (F.coalesce("n_found", F.lit(0)) / F.col("n_relevant")).alias("recall"))


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    own = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= n).drop("_n")
