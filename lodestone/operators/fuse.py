"""Reciprocal rank fusion of two ranked channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rrf_score(vector_rank: Column, keyword_rank: Column, rrf_k: int = 60) -> Column:
    """Sum of 1 / (k + rank) over the channels that hold the item; k is 1 at least."""
    part = lambda r: F.when(r.isNotNull(), 1.0 / (F.lit(max(1, rrf_k)) + r)).otherwise(0.0)
    return part(vector_rank) + part(keyword_rank)


def rrf(vector: DataFrame, keyword: DataFrame, k: int, candidate_k: int, *, rrf_k: int = 60) -> DataFrame:
    """Merge hits by (query_id, id) and keep the k best: by fused score, then vector rank, then keyword rank.

    A missing rank counts as candidate_k + 1 in ties only. Scores of both channels stay, null where it had no hit.
    """
    v = vector.where(F.col("vector_rank") <= candidate_k).select("query_id", "id", "distance", "vector_score", "vector_rank")
    w = keyword.where(F.col("keyword_rank") <= candidate_k).select("query_id", "id", "keyword_score", "keyword_rank")
    both = v.join(w, ["query_id", "id"], "full_outer").withColumn("rrf_score", F.round(rrf_score(F.col("vector_rank"), F.col("keyword_rank"), rrf_k), 12))
    late = F.lit(candidate_k + 1)
    best = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.coalesce("vector_rank", late), F.coalesce("keyword_rank", late), "id")
    return both.withColumns({"rank": F.row_number().over(best).cast("long"), "retrieval_mode": F.lit("hybrid_rrf")}).where(F.col("rank") <= k)
