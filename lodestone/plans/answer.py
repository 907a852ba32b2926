"""The retrieval pipeline as one lazy plan for a batch of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..errors import ConfigError
from ..functions.metadata import source_label
from ..operators import bm25, fuse, rank, vectors
from ..operators.chunk import chunk_documents
from ..sources.scratch import materialize
from ..sources.store import as_filter
from .providers import NOT_FOUND, embed, extract_answer, with_retries

MODES = {"vector": "vector", "keyword": "keyword", "hybrid_rrf": "hybrid_rrf", "hybrid": "hybrid_rrf"}


def mode_of(name: str) -> str:
    clean = (name or "").strip().lower()
    if clean not in MODES:
        raise ConfigError(f"unknown retrieval mode: {name}")
    return MODES[clean]


def _asked(questions: DataFrame, k: int = 1) -> DataFrame:
    return questions.where(F.trim(F.coalesce("question", F.lit(""))) != "").where(F.lit(k > 0))


def channels(corpus: DataFrame, questions: DataFrame, depth: int, modes: set[str], *, where: Mapping[str, object] | Column | None = None, settings: Settings | None = None) -> dict[str, DataFrame]:
    """The hits of each channel that the modes need, `depth` for each question, written once for several uses."""
    s, condition = settings or Settings(), as_filter(where)
    own = corpus if condition is None else corpus.where(condition)
    out = {}
    if modes & {"vector", "hybrid_rrf"}:
        out["vector"] = materialize(vectors.search(own, _asked(questions), depth), "near")
    if modes & {"keyword", "hybrid_rrf"}:
        out["keyword"] = materialize(bm25.search(own, _asked(questions), depth, k1=s.bm25_k1, b=s.bm25_b), "keyword")
    return out


def retrieve(
    corpus: DataFrame, questions: DataFrame, k: int, *, mode: str = "vector", where: Mapping[str, object] | Column | None = None, candidate_k: int | None = None, settings: Settings | None = None, found: dict[str, DataFrame] | None = None
) -> DataFrame:
    """The k best rows of corpus(id, text, [embedding, meta]) for each of questions(query_id, question, [vector]).

    Returns query_id, question, rank, id, text, the channels' scores and ranks, and retrieval_mode. The filter comes before
    keyword statistics. Keyword mode needs no vectors. Blank questions and k <= 0 give no rows. found: hits of the
    channels that were searched before, as deep at least.
    """
    s, mode = settings or Settings(), mode_of(mode)
    condition = as_filter(where)
    own = corpus if condition is None else corpus.where(condition)
    asked, take = _asked(questions, k), max(k, candidate_k or s.candidate_k)
    near = lambda n: found["vector"].where(F.col("vector_rank") <= n) if found else vectors.search(own, asked, n)
    held = lambda n: found["keyword"].where(F.col("keyword_rank") <= n) if found else bm25.search(own, asked, n, k1=s.bm25_k1, b=s.bm25_b)
    if mode == "vector":
        hits = near(k).withColumns({"rank": F.col("vector_rank"), "retrieval_mode": F.lit(mode)})
    elif mode == "keyword":
        hits = held(k).withColumns({"rank": F.col("keyword_rank"), "retrieval_mode": F.lit(mode)})
    else:
        hits = fuse.rrf(near(take), held(take), k, take, rrf_k=s.rrf_k)
    return hits.join(asked.select("query_id", "question"), "query_id").join(own.drop("embedding", "question"), "id")


def build_context(sources: DataFrame, order: str = "rank") -> DataFrame:
    """(query_id, context): each query's sources in order as "[i] label", line feed, text; blank lines between."""
    meta = (lambda k: F.col("meta").getItem(k)) if "meta" in sources.columns else (lambda k: F.lit(None).cast("string"))
    label = source_label(meta("source_type"), meta("source_file"), meta("page_number"), meta("title"), meta("chunk_id"))
    held = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), label.alias("label"), F.col("text").alias("text"))))
    line = lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["label"], F.lit("\n"), F.coalesce(x["text"], F.lit("")))
    return sources.groupBy("query_id").agg(F.array_join(F.transform(held, line), "\n\n").alias("context"))


def select_sources(corpus: DataFrame, questions: DataFrame, *, top_k: int | None = None, mode: str = "vector", where: Mapping[str, object] | Column | None = None, candidate_k: int | None = None, rerank: bool | None = None, scorer: rank.Scorer | None = None, rerank_top_n: int | None = None, mmr: bool | None = None, mmr_lambda: float | None = None, settings: Settings | None = None, found: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, reranked, sources): the funnel of a question. A value of 0 counts as not given.

    Each step is written, at most a few dozen rows for each question, so none is planned again for the next one or for counts.
    """
    s = settings or Settings()
    final = max(1, top_k or s.final_context_k)
    rerank = s.rerank_enabled if rerank is None else rerank
    mmr = s.mmr_enabled if mmr is None else mmr
    take = max(final, candidate_k or (s.rerank_candidates if rerank or mmr else final))
    found = materialize(retrieve(corpus, questions, take, mode=mode, where=where, candidate_k=take, settings=s, found=found), "candidates")
    better = rank.rerank(found, max(final, rerank_top_n or s.rerank_top_n), scorer, provider="none" if scorer is None else "overlap") if rerank else found
    better = materialize(better, "reranked") if rerank and scorer else better
    order = F.col("rerank_rank") if rerank else F.col("rank")
    ranked = better.withColumn("rank", order)
    if mmr:
        chosen = rank.mmr(ranked, final, lambda_=s.mmr_lambda if mmr_lambda is None else mmr_lambda, similarity=s.mmr_similarity).withColumn("final_rank", F.col("mmr_rank"))
    else:
        chosen = ranked.where(F.col("rank") <= final).withColumn("final_rank", F.col("rank"))
    return found, better, materialize(chosen, "sources") if mmr else chosen


def answer(corpus: DataFrame, questions: DataFrame, *, generator: Callable[[str], str] | None = extract_answer, attempts: int = 0, delay: float = 0.0, **options: object) -> DataFrame:
    """One row per question: answer, error, attempt_count, contexts, source_ids and counts of the funnel.

    Questions without sources get a fixed answer without a call. Without a generator the answer is empty (retrieval only).
    """
    found, better, chosen = select_sources(corpus, questions, **options)
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    held = F.sort_array(F.collect_list(F.struct("final_rank", "id", "text")))
    sources = chosen.groupBy("query_id").agg(F.transform(held, lambda x: x["text"]).alias("contexts"), F.transform(held, lambda x: x["id"].cast("string")).alias("source_ids"), F.count("*").alias("final_count"))
    base = questions.select("query_id", "question").join(sources, "query_id", "left").join(build_context(chosen, "final_rank"), "query_id", "left").join(count(found, "retrieved_count"), "query_id", "left").join(count(better, "reranked_count"), "query_id", "left")
    call = with_retries(generator, attempts, delay) if generator else None

    @F.pandas_udf("answer string, error string, attempt_count long")
    def run(context: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for c, q in context:
            rows = [(NOT_FOUND, "", 0) if x is None else call(f"{x}\n\nQuestion: {y}") if call else ("", "", 0) for x, y in zip(c, q, strict=True)]
            yield pd.DataFrame(rows, columns=["answer", "error", "attempt_count"])

    empty = F.array().cast("array<string>")
    return base.withColumn("_a", run("context", "question")).select(
        "query_id", "question", "_a.answer", "_a.error", "_a.attempt_count", F.lit(generator is None).alias("generation_skipped"), F.coalesce("contexts", empty).alias("contexts"), F.coalesce("source_ids", empty).alias("source_ids"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("retrieved_count", "reranked_count", "final_count")),
    )


def baseline(docs: DataFrame, questions: DataFrame, *, settings: Settings | None = None, generator: Callable[[str], str] | None = extract_answer, provider: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """answer() by the plain way to compare with: docs(id, text) cut by lines, and the few nearest chunks by vectors, without any reordering."""
    s = settings or Settings()
    chunks = embed(chunk_documents(docs, s.chunk_size, s.chunk_overlap, mode="simple"), s.embed_dim, provider=provider, batch=s.embed_batch)
    asked = embed(questions, s.embed_dim, text="question", into="vector", provider=provider, batch=s.embed_batch)
    return answer(chunks, asked, mode="vector", top_k=s.simple_k, rerank=False, mmr=False, settings=s, generator=generator)
