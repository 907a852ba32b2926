"""Reranking, deduplication, relevance and MMR selection of each query's candidates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from ..errors import one_line
from ..functions.text import fingerprint, overlap, tokens

#: First that is not null is a candidate's relevance.
SCORES = ("rerank_score", "rrf_score", "hybrid_score", "vector_score", "keyword_score")
RERANK_CHARS = 6000


def rerank_text(text: Column, *meta: tuple[str, Column]) -> Column:
    """What a reranker reads: the non-blank metadata lines, then the text, cut."""
    lines = [F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{name}: "), c)) for name, c in meta]
    return F.concat_ws("\n", *lines, F.substring(F.coalesce(text, F.lit("")), 1, RERANK_CHARS))


def keep_top(candidates: DataFrame, k: int, *, provider: str = "none", error: str | None = None) -> DataFrame:
    """The first k of each query in their order, with rerank_rank and rerank_provider."""
    return (
        candidates.where(F.col("rank") <= k)
        .withColumns({"rerank_rank": F.col("rank"), "rerank_score": F.lit(None).cast("double"), "rerank_provider": F.lit(provider), "rerank_error": F.lit(error).cast("string")})
    )


def _nullable(df: DataFrame) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in df.schema.fields])


Scorer = Callable[[str, list[str]], list[tuple[int, float]]]


def rerank(candidates: DataFrame, k: int, scorer: Scorer | None = None, *, provider: str = "none") -> DataFrame:
    """Reorder candidates(query_id, question, rank, id, text, ...) by scorer(question, texts) -> [(index, score)], best first.

    Indexes that are out of range or repeated are dropped, and ranks count them. Without a scorer, or if it fails for a
    query, that query's order stays and the error is told. A query's candidates are one group; they are at most k1 rows.
    """
    if scorer is None:
        return keep_top(candidates, k, provider=provider)
    schema = _nullable(candidates.withColumns({"rerank_rank": F.lit(0).cast("long"), "rerank_score": F.lit(0.0), "rerank_provider": F.lit(""), "rerank_error": F.lit("")}))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        try:
            got, seen, rows = scorer(group["question"].iloc[0], group["text"].tolist()), set(), []
            for place, (index, score) in enumerate(got, 1):
                if isinstance(index, int) and 0 <= index < len(group) and index not in seen and place <= k:
                    seen.add(index)
                    rows.append((index, place, float(score)))
            out = group.iloc[[r[0] for r in rows]].assign(rerank_rank=[r[1] for r in rows], rerank_score=[r[2] for r in rows], rerank_provider=provider, rerank_error=None)
        except Exception as e:  # noqa: BLE001  any failure of a provider keeps the order
            out = group.head(k).assign(rerank_rank=group["rank"].head(k), rerank_score=None, rerank_provider=provider, rerank_error=one_line(e))
        return out[schema.names]

    return candidates.groupBy("query_id").applyInPandas(run, schema)


def overlap_scorer(question: str, texts: list[str]) -> list[tuple[int, float]]:
    """An offline reranker: share of the question's words in each text; ties keep their order."""
    want = set(question.lower().split())
    scored = [(i, len(want & set(t.lower().split())) / max(1, len(want))) for i, t in enumerate(texts)]
    return sorted(scored, key=lambda x: (-x[1], x[0]))


def dedupe(candidates: DataFrame) -> DataFrame:
    """First of each id, then first of each non-blank fingerprint, within a query, by rank."""
    one = Window.partitionBy("query_id", "id").orderBy("rank")
    own = candidates.withColumn("_n", F.row_number().over(one)).where("_n = 1").withColumn("_print", fingerprint(F.col("text")))
    two = Window.partitionBy("query_id", F.when(F.col("_print") == "", F.col("id").cast("string")).otherwise(F.col("_print"))).orderBy("rank")
    return own.withColumn("_n", F.row_number().over(two)).where("_n = 1").drop("_n", "_print")


def relevance(candidates: DataFrame, *, digits: int = 9) -> DataFrame:
    """candidates with relevance: its score min-max normalised within the query; 1 - place / n if all are equal."""
    own = Window.partitionBy("query_id")
    place = F.row_number().over(own.orderBy("rank")) - 1
    have = [F.col(c).cast("double") for c in SCORES if c in candidates.columns]
    spare = overlap(tokens(F.col("question")), tokens(F.col("text"))) + 1 / (place + 1) if "question" in candidates.columns else 1 / (place + 1)
    raw = candidates.withColumn("_place", place).withColumn("_raw", F.coalesce(*have, spare))
    lo, hi, n = F.min("_raw").over(own), F.max("_raw").over(own), F.count("*").over(own)
    return raw.withColumn("relevance", F.round(F.when(hi > lo, (F.col("_raw") - lo) / (hi - lo)).otherwise(1 - F.col("_place") / n), digits)).drop("_raw", "_place")


def mmr(candidates: DataFrame, k: int, *, lambda_: float = 0.65, similarity: float = 0.82) -> DataFrame:
    """Maximal marginal relevance over the deduplicated candidates(query_id, rank, id, text, ...).

    Adds mmr_rank, mmr_score, mmr_penalty and mmr_duplicate. With k candidates or fewer all are taken in order with score 1.
    Each step takes the best lambda * relevance - (1 - lambda) * (largest Jaccard similarity with what is taken); those at
    or above `similarity` wait while there are others. Ties go to the more relevant, then the earlier. A query's
    candidates are one group of the fused top, so groups are small.
    """
    lambda_, similarity = min(1.0, max(0.0, lambda_)), min(1.0, max(0.0, similarity))
    own = relevance(dedupe(candidates)).withColumn("_tokens", F.array_distinct(tokens(F.col("text"))))
    schema = _nullable(candidates.withColumns({"relevance": F.lit(0.0), "mmr_rank": F.lit(0).cast("long"), "mmr_score": F.lit(0.0), "mmr_penalty": F.lit(0.0), "mmr_duplicate": F.lit(False)}))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        n = len(group)
        if n <= k:
            return group.assign(mmr_rank=range(1, n + 1), mmr_score=1.0, mmr_penalty=0.0, mmr_duplicate=False)[schema.names]
        sets, rel = [set(t) for t in group["_tokens"]], group["relevance"].tolist()
        worst, left, taken = [0.0] * n, list(range(n)), []
        while left and len(taken) < k:
            free = [i for i in left if worst[i] < similarity]
            score = lambda i: round(lambda_ * rel[i] - (1 - lambda_) * worst[i], 12)
            best = min(free or left, key=lambda i: (-score(i), -rel[i], i))
            taken.append((best, score(best), worst[best], not free))
            left.remove(best)
            for i in left:
                both = len(sets[i] | sets[best])
                near = len(sets[i] & sets[best]) / both if sets[i] and sets[best] else 0.0
                worst[i] = max(worst[i], near)
        out = group.iloc[[t[0] for t in taken]]
        return out.assign(mmr_rank=range(1, len(taken) + 1), mmr_score=[t[1] for t in taken], mmr_penalty=[round(t[2], 9) for t in taken], mmr_duplicate=[t[3] for t in taken])[schema.names]

    return own.groupBy("query_id").applyInPandas(run, schema)
