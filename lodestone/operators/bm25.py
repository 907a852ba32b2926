"""BM25 over a corpus table, for a batch of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import terms as counting
from ..functions.text import tokens
from ..sources.scratch import materialize, small_enough

#: Distinct query terms that are sent to every executor; more go by a shuffled join.
BROADCAST_TERMS = 200_000
#: Queries that are sent to every executor at once; scores, or parts of them, that a task holds at once; documents it scores at once.
BLOCK, CELLS, ROWS = 2_000, 1 << 21, 2_048
#: Share of (document, query) pairs that have a term in common from which the term is scored by a matrix product; terms of such a product.
COMMON, WIDE = 0.001, 2_048


@dataclass
class Index:
    """postings(id, term, tf), lengths(id, dl), terms(term, df) and stats(n, avgdl), all lazy."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame


def build(corpus: DataFrame, *, key: str = "id", text: str = "text") -> Index:
    """Statistics of exactly the given rows; filter the corpus first. Rows without tokens count as documents."""
    tok = corpus.select(F.col(key).alias("id"), tokens(F.col(text)).alias("tokens"))
    lengths = tok.select("id", F.size("tokens").cast("long").alias("dl"))
    postings = tok.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Index(postings, lengths, terms, stats)


def search(corpus: DataFrame, queries: DataFrame, k: int, *, key: str = "id", text: str = "text", k1: float = 1.5, b: float = 0.75, digits: int = 9) -> DataFrame:
    """(query_id, id, keyword_score, keyword_rank) of the k best documents with a score above 0 for each query(query_id, question).

    The corpus is tokenised once: the queries' terms that a document has are written, as numbers, a row a document, and document frequencies,
    number and mean length come from there. Queries go to the executors in blocks; a task scores its documents against a block by
    products of term weights, and only its k best rows of a query leave it. Statistics are of the whole corpus as given.
    Ties go to the smaller id. Repeated ids, and more query terms than BROADCAST_TERMS, go by a join of terms.
    """
    spark = queries.sparkSession
    asked = counting.postings(queries.select(F.col("query_id").alias("id"), F.col("question").alias("text"))).select(F.col("id").alias("query_id"), F.explode("t.term").alias("term"))
    asked = materialize(asked.distinct(), "asked")
    wanted = asked.select("term").distinct()
    own = corpus.select(F.col(key).alias("id"), F.col(text).alias("text"))
    if not small_enough(wanted, BROADCAST_TERMS):
        return _joined(own, asked, k, k1, b, digits)
    names = sorted(r.term for r in wanted.collect())
    schema = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("id", own.schema["id"].dataType), StructField("keyword_score", DoubleType())])
    out = None
    if names:
        held = materialize(counting.counted(own, names), "terms")
        if not held.groupBy("id").count().where("count > 1").isEmpty():
            return _joined(own, asked, k, k1, b, digits)
        n, total = held.agg(F.count("*"), F.sum("dl")).first()
        df, place = counting.frequencies(held, len(names)), {w: i for i, w in enumerate(names)}
        blocks = -(-asked.select("query_id").distinct().count() // BLOCK)
        for i in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
            ids = part["query_id"].unique()
            q, t = pc.index_in(part["query_id"], ids).to_numpy(), np.array([place[w] for w in part["term"].to_pylist()], np.int64)
            live = df[t] > 0
            if live.any():
                found = held.mapInArrow(_best(ids.to_pylist(), to_arrow_type(schema["query_id"].dataType), q[live].astype(np.int64), t[live], df, n, total / n if total else 1.0, max(1, k), k1, b, digits), schema)
                out = found if out is None else out.unionByName(found)
    out = spark.createDataFrame([], schema) if out is None else out
    scored = out.withColumn("keyword_score", F.round("keyword_score", digits)).where("keyword_score > 0")
    best = Window.partitionBy("query_id").orderBy(F.desc("keyword_score"), "id")
    return scored.withColumn("keyword_rank", F.row_number().over(best).cast("long")).where(F.col("keyword_rank") <= k)


def _best(ids: list, kind: pa.DataType, q: np.ndarray, t: np.ndarray, df: np.ndarray, n: int, mean: float, k: int, k1: float, b: float, digits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's k best rows of each query, with their scores: q and t are pairs of a query and a term, by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, wide = np.argsort(t, kind="stable"), len(ids)
        queries, each = q[order], np.bincount(t, minlength=len(df))  # the queries of a term lie together
        start = np.cumsum(each) - each
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        share = df / n * each / wide
        common = np.argsort(-share, kind="stable")[:WIDE]
        common = common[share[common] > COMMON]
        column = np.full(len(df), -1, np.int64)
        column[common] = np.arange(len(common))
        product, theirs = np.zeros((len(common), wide)), column[t] >= 0
        product[column[t[theirs]], q[theirs]] = idf[t[theirs]]
        least, held, waiting = np.full(wide, -np.inf), [], 0

        def merged() -> list[tuple]:
            who, score, own = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pa.concat_arrays([h[2] for h in held])
            table = pa.table({"q": who, "s": np.round(score, digits), "id": own})
            rows = pc.sort_indices(table, sort_keys=[("q", "ascending"), ("s", "descending"), ("id", "ascending")], null_placement="at_start").to_numpy()
            who = who[rows]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            last = place == k - 1
            least[who[last]] = np.round(score[rows[last]], digits)
            rows = rows[place < k]
            return [(who[place < k], score[rows], own.take(pa.array(rows)))]

        for batch in batches:
            keys, dl = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))])
            term, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.float64)
            doc = np.repeat(np.arange(len(keys)), np.diff(at))
            heft = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / mean))
            step = max(1, min(ROWS, CELLS // wide))
            for lo in range(0, len(keys), step):
                hi = min(lo + step, len(keys))
                part = slice(at[lo], at[hi])
                d, w, x = doc[part] - lo, heft[part], term[part]
                c = column[x]
                dense = np.zeros((hi - lo, len(common)))
                dense[d[c >= 0], c[c >= 0]] = w[c >= 0]
                score = dense @ product
                rare = (c < 0) & (each[x] > 0)
                d, w, x = d[rare], w[rare] * idf[x[rare]], x[rare]
                ends = np.cumsum(each[x])
                from_ = 0
                while from_ < len(x):
                    done = ends[from_ - 1] if from_ else 0
                    to = max(from_ + 1, int(np.searchsorted(ends, done + CELLS, "right")))
                    some = slice(from_, to)
                    count = each[x[some]]
                    place = np.repeat(start[x[some]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    score += np.bincount(np.repeat(d[some] * wide, count) + queries[place], np.repeat(w[some], count), score.size).reshape(score.shape)
                    from_ = to
                bound = np.maximum(least - 2 * 10.0**-digits, 0)
                good = (score > 0) & (score >= bound)
                if hi - lo > k and np.count_nonzero(good) > 4 * k * wide:
                    bound = np.maximum(bound, np.partition(score, -k, axis=0)[-k] - 2 * 10.0**-digits)
                    good &= score >= bound
                r, who = np.nonzero(good)
                if len(r):
                    held.append((who, score[r, who], keys.take(pa.array(r + lo))))
                    waiting += len(r)
                if waiting > 4 * k * wide:
                    held = merged()
                    waiting = 0
        if held:
            who, score, own = merged()[0]
            for lo in range(0, len(who), CELLS):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in who[lo : lo + CELLS].tolist()], kind), own.slice(lo, CELLS), pa.array(score[lo : lo + CELLS])], ["query_id", "id", "keyword_score"])

    return run


def _joined(corpus: DataFrame, asked: DataFrame, k: int, k1: float, b: float, digits: int) -> DataFrame:
    """search() by joins of terms: only asked terms of a document are dealt out, by document, so counts and scores need no further shuffle."""
    mark_row = corpus.sparkSession.createDataFrame([("",)], "term string")
    wanted = asked.select("term").distinct()
    wanted = F.broadcast(wanted.unionByName(mark_row)) if small_enough(wanted, BROADCAST_TERMS) else wanted.unionByName(mark_row)
    tok = corpus.select("id", tokens(F.col("text")).alias("tokens"))
    # No token is empty, so an empty one marks the document.
    each = tok.select("id", F.size("tokens").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("term")).where(F.col("term").isNotNull())
    own = each.join(wanted, "term", "left_semi").repartition("id").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    terms = own.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("total"))
    mark = F.col("term") == ""
    stats = terms.agg(F.coalesce(F.max(F.when(mark, F.col("df"))), F.lit(0)).alias("n"), F.max(F.when(mark, F.col("total") / F.col("df"))).alias("avgdl"))
    n, avgdl = F.col("n"), F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    weights = asked.join(terms.crossJoin(F.broadcast(stats)), "term").select("query_id", "term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), avgdl.alias("avgdl"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = own.join(weights, "term").groupBy("query_id", "id").agg(F.round(F.sum(weight), digits).alias("keyword_score")).where("keyword_score > 0")
    best = Window.partitionBy("query_id").orderBy(F.desc("keyword_score"), "id")
    return scored.withColumn("keyword_rank", F.row_number().over(best).cast("long")).where(F.col("keyword_rank") <= k)
