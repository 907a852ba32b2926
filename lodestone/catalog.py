"""Queries of the retrieval engine over the driver's tables, each with its SQL where SQL can express it.

Derived inputs. Hybrid corpus: all documents, with the embedding of the same number where there is one. Questions: all
benchmark passages; their vectors: the embeddings of the same number, where there is one. Query vectors: the embeddings whose id is divisible by 100.
Sync state: documents as they were before a made change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metadata, tables, text
from .operators import blocks, bm25, chunk, fuse, rank, sync, vectors
from .plans import answer, evaluate
from .sources.scratch import materialize, spread
from .streaming.ingest import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K, CANDIDATES, RRF_K = 10, 30, 60


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark: SparkSession, d: str, name: str = "documents") -> DataFrame:
    """A table of texts, which is costly to work on, over all cores."""
    return spread(_t(spark, d, name))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).withColumnRenamed("doc_id", "id")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).join(_t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label"), "id", "left")


def _hybrid_questions(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).join(_t(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id", "left")


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("query_label"))


# SQL of the shared parts.
_RAW = r"list_filter(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[0-9A-Za-zÀ-ỹ_+\-#.]+'), lambda x: trim(x, '.')), lambda x: x <> '')"
_TOKENS = "flatten(list_transform(" + _RAW + ", lambda x: CASE WHEN strip_accents(x) <> x THEN [x, strip_accents(x)] ELSE [x] END))"


def _bm25_sql(corpus: str, key: str, k: int) -> str:
    """CTEs ending in keyword(query_id, id, keyword_score, keyword_rank) over corpus({key}, text)."""
    return f"""
tok AS (SELECT {key} AS id, {_TOKENS.format('text')} AS t FROM {corpus}),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM tok),
postings AS (SELECT id, term, dl, count(*)::DOUBLE AS tf FROM (SELECT id, len(t)::DOUBLE AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
terms AS (SELECT term, count(*)::DOUBLE AS df FROM postings GROUP BY term),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark),
scored AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS keyword_score
           FROM asked JOIN postings USING (term) JOIN terms USING (term) CROSS JOIN stats GROUP BY query_id, id),
keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, id)::BIGINT AS keyword_rank FROM scored WHERE keyword_score > 0
            QUALIFY keyword_rank <= {k})"""


def _vector_sql(corpus: str, key: str, queries: str, k: int) -> str:
    """CTEs ending in near(query_id, id, distance, vector_score, vector_rank); queries: SQL with query_id, vector."""
    return f"""
own AS (SELECT {key} AS id, embedding::DOUBLE[] AS v FROM {corpus} WHERE embedding IS NOT NULL),
qs AS ({queries}),
dist AS (SELECT query_id, id, round(list_sum(list_transform(list_zip(v, vector), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance FROM own CROSS JOIN qs),
near AS (SELECT *, round(1 / (1 + greatest(distance, 0)), 9) AS vector_score, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::BIGINT AS vector_rank FROM dist
         QUALIFY vector_rank <= {k})"""


_HC = "hc AS (SELECT d.doc_id AS id, d.text, e.embedding, e.label FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"
_QV = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id % 100 = 0"
_HQ = "SELECT item_id AS query_id, embedding::DOUBLE[] AS vector FROM benchmark JOIN embeddings ON item_id = vec_id"
_RRF = f"""{_HC}, {_bm25_sql('hc', 'id', CANDIDATES)}, {_vector_sql('hc', 'id', _HQ, CANDIDATES)},
kw AS (SELECT * FROM keyword),
fused AS (SELECT coalesce(n.query_id, k.query_id) AS query_id, coalesce(n.id, k.id) AS id, distance, vector_score, vector_rank, keyword_score, keyword_rank,
                 round(coalesce(1.0::DOUBLE / ({RRF_K} + vector_rank), 0) + coalesce(1.0::DOUBLE / ({RRF_K} + keyword_rank), 0), 12) AS rrf_score
          FROM near n FULL JOIN kw k ON n.query_id = k.query_id AND n.id = k.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, coalesce(vector_rank, {CANDIDATES + 1}), coalesce(keyword_rank, {CANDIDATES + 1}), id)::BIGINT AS rank FROM fused)"""


@_query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    own = _texts(spark, d).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return own.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@_query(f"SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term")
def term_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return bm25.build(_docs(spark, d)).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@_query(f"SELECT count(*)::BIGINT AS n, round(avg(len({_TOKENS.format('text')})), 6) AS avgdl FROM documents")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.build(_docs(spark, d)).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@_query("SELECT doc_id, sha256(strip_accents(lower(text))) AS folded FROM documents")
def fold_accents(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.sha2(text.fold_accents(F.col("text")), 256).alias("folded"))


@_query(r"SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS n FROM documents GROUP BY substring(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 1, 500)")
def fingerprint_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").groupBy(text.fingerprint(F.col("text")).alias("p")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("p")


@_query("SELECT sha256(text) AS sha, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@_query(f"WITH {_bm25_sql('documents', 'doc_id', K)} SELECT query_id, id, keyword_score, keyword_rank FROM keyword")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25.search(_docs(spark, d), _questions(spark, d), K)


@_query(f"WITH {_bm25_sql('''(SELECT * FROM documents WHERE lang = 'en')''', 'doc_id', K)} SELECT query_id, id, keyword_score, keyword_rank FROM keyword")
def bm25_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return bm25.search(_docs(spark, d).where("lang = 'en'"), _questions(spark, d), K)


@_query(
    f"""WITH {_bm25_sql('documents', 'doc_id', K)},
pairs AS (SELECT k.query_id, k.id, list_distinct({_TOKENS.format('b.text')}) AS q, list_distinct({_TOKENS.format('d.text')}) AS t
          FROM keyword k JOIN benchmark b ON b.item_id = k.query_id JOIN documents d ON d.doc_id = k.id)
SELECT query_id, id, round(len(list_intersect(q, t)) / len(list_distinct(q || t)), 9) AS jaccard, round(len(list_intersect(q, t)) / len(q), 9) AS overlap FROM pairs"""
)
def hit_similarity(spark: SparkSession, d: str) -> DataFrame:
    own = _docs(spark, d)
    hits = bm25.search(own, _questions(spark, d), K).join(_questions(spark, d), "query_id").join(own.select("id", "text"), "id")
    q, t = F.array_distinct(text.tokens(F.col("question"))), F.array_distinct(text.tokens(F.col("text")))
    return hits.select("query_id", "id", q.alias("q"), t.alias("t")).select("query_id", "id", F.round(text.jaccard(F.col("q"), F.col("t")), 9).alias("jaccard"), F.round(text.overlap(F.col("q"), F.col("t")), 9).alias("overlap"))


@_query(f"WITH {_vector_sql('embeddings', 'vec_id', _QV, K)} SELECT query_id, id, distance, vector_score, vector_rank FROM near")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.search(_t(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), _query_vectors(spark, d), K)


@_query(f"WITH {_vector_sql('(SELECT * FROM embeddings WHERE label = 3)', 'vec_id', _QV, K)} SELECT query_id, id, distance, vector_score, vector_rank FROM near")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return vectors.search(_t(spark, d, "embeddings").withColumnRenamed("vec_id", "id").where("label = 3"), _query_vectors(spark, d), K)


@_query()
def vector_lsh_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.lsh_search(_t(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), _query_vectors(spark, d), K)


@_query(
    f"""WITH {_vector_sql('embeddings', 'vec_id', _QV, K)}
SELECT n.query_id, count(*)::BIGINT AS n, round(avg((a.label = b.label)::INT), 9) AS precision_at_k
FROM near n JOIN embeddings a ON a.vec_id = n.query_id JOIN embeddings b ON b.vec_id = n.id GROUP BY n.query_id"""
)
def label_precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    own = _t(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    asked = _query_vectors(spark, d)
    hits = vectors.search(own, asked, K).join(own.select("id", "label"), "id").join(asked.select("query_id", "query_label"), "query_id")
    return hits.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("query_label")).cast("int")), 9).alias("precision_at_k"))


def _fused(spark: SparkSession, d: str, k: int) -> DataFrame:
    own, asked = _hybrid(spark, d), _hybrid_questions(spark, d)
    return fuse.rrf(vectors.search(own, asked, CANDIDATES), bm25.search(own, asked, CANDIDATES), k, CANDIDATES, rrf_k=RRF_K)


@_query(f"WITH {_RRF} SELECT query_id, id, rrf_score, vector_rank, keyword_rank, rank FROM ranked WHERE rank <= {K}")
def rrf_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, K).select("query_id", "id", "rrf_score", "vector_rank", "keyword_rank", "rank")


@_query(
    f"""WITH {_RRF} SELECT query_id, count(*) FILTER (vector_rank IS NOT NULL AND keyword_rank IS NOT NULL)::BIGINT AS n_both,
    count(*) FILTER (keyword_rank IS NULL)::BIGINT AS n_vector, count(*) FILTER (vector_rank IS NULL)::BIGINT AS n_keyword FROM ranked GROUP BY query_id"""
)
def rrf_channel_membership(spark: SparkSession, d: str) -> DataFrame:
    v, w = F.col("vector_rank").isNotNull(), F.col("keyword_rank").isNotNull()
    return _fused(spark, d, 2 * CANDIDATES).groupBy("query_id").agg(F.count_if(v & w).alias("n_both"), F.count_if(~w).alias("n_vector"), F.count_if(~v).alias("n_keyword"))


@_query(f"WITH {_RRF} SELECT query_id, id, rank AS rerank_rank, 'none' AS rerank_provider FROM ranked WHERE rank <= {K}")
def rerank_passthrough(spark: SparkSession, d: str) -> DataFrame:
    return rank.rerank(_fused(spark, d, CANDIDATES), K).select("query_id", "id", "rerank_rank", "rerank_provider")


_WORDS = "list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: w <> '')"


@_query(
    f"""WITH {_RRF}, pairs AS (SELECT r.query_id, r.id, r.rank, list_distinct({_WORDS.format('b.text')}) AS q, {_WORDS.format('hc.text')} AS t
                       FROM ranked r JOIN hc USING (id) JOIN benchmark b ON b.item_id = r.query_id WHERE r.rank <= {CANDIDATES}),
sc AS (SELECT query_id, id, rank, len(list_intersect(q, t)) / greatest(1, len(q)) AS s FROM pairs)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank)::BIGINT AS rerank_rank, s AS rerank_score, 'overlap' AS rerank_provider FROM sc QUALIFY rerank_rank <= {K}"""
)
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    own = _fused(spark, d, CANDIDATES).join(_questions(spark, d), "query_id").join(_docs(spark, d).select("id", "text"), "id")
    return rank.rerank(own, K, rank.overlap_scorer, provider="overlap").select("query_id", "id", "rerank_rank", "rerank_score", "rerank_provider")


@_query(
    f"""WITH {_RRF}, top AS (SELECT *, min(rrf_score) OVER (PARTITION BY query_id) AS lo, max(rrf_score) OVER (PARTITION BY query_id) AS hi, count(*) OVER (PARTITION BY query_id) AS n FROM ranked WHERE rank <= {CANDIDATES})
SELECT query_id, id, round(CASE WHEN hi > lo THEN (rrf_score - lo) / (hi - lo) ELSE 1 - (rank - 1) / n END, 9) AS relevance FROM top"""
)
def relevance_normalized(spark: SparkSession, d: str) -> DataFrame:
    return rank.relevance(_fused(spark, d, CANDIDATES)).select("query_id", "id", "relevance")


_PRINT = r"substring(trim(regexp_replace(lower(hc.text), '\s+', ' ', 'g')), 1, 500)"
_MMR_STEP = """
p{i} AS (SELECT *, {i}::BIGINT AS mmr_rank FROM w{j} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY worst >= 0.82, round(0.65 * relevance - 0.35 * worst, 12) DESC, relevance DESC, place) = 1),
w{i} AS (SELECT w.* EXCLUDE (worst), greatest(w.worst, CASE WHEN len(w.t) > 0 AND len(p.t) > 0 THEN len(list_intersect(w.t, p.t)) / len(list_distinct(w.t || p.t)) ELSE 0 END) AS worst
         FROM w{j} w JOIN p{i} p ON w.query_id = p.query_id WHERE w.id <> p.id)"""


@_query(
    f"""WITH {_RRF},
once AS (SELECT r.query_id, r.id, r.rank, r.rrf_score AS raw, list_distinct({_TOKENS.format('hc.text')}) AS t FROM ranked r JOIN hc USING (id) WHERE r.rank <= {CANDIDATES}
         QUALIFY row_number() OVER (PARTITION BY r.query_id, CASE WHEN {_PRINT} = '' THEN r.id::VARCHAR ELSE {_PRINT} END ORDER BY r.rank) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS place, min(raw) OVER q AS lo, max(raw) OVER q AS hi, count(*) OVER q AS n FROM once WINDOW q AS (PARTITION BY query_id)),
w0 AS (SELECT query_id, id, rank, t, n, place, round(CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 1 - place / n END, 9) AS relevance, 0::DOUBLE AS worst FROM o),"""
    + ",".join(_MMR_STEP.format(i=i, j=i - 1) for i in (1, 2, 3, 4))
    + """,
taken AS (SELECT * FROM p1 UNION ALL BY NAME SELECT * FROM p2 UNION ALL BY NAME SELECT * FROM p3 UNION ALL BY NAME SELECT * FROM p4)
SELECT query_id, id, relevance, mmr_rank, round(0.65 * relevance - 0.35 * worst, 12) AS mmr_score, round(worst, 9) AS mmr_penalty, worst >= 0.82 AS mmr_duplicate FROM taken WHERE n > 4
UNION ALL SELECT query_id, id, relevance, place + 1, 1, 0, false FROM w0 WHERE n <= 4"""
)
def mmr_topk(spark: SparkSession, d: str) -> DataFrame:
    # Written, the few candidates of a query tell their size, so they go to the texts and these stay where they are.
    own = materialize(_fused(spark, d, CANDIDATES), "fused").join(_docs(spark, d).select("id", "text"), "id")
    return rank.mmr(own, 4).select("query_id", "id", "relevance", "mmr_rank", "mmr_score", "mmr_penalty", "mmr_duplicate")


@_query(
    f"""WITH {_RRF} SELECT query_id, string_agg('[' || rank || '] Source: unknown' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
FROM ranked JOIN hc USING (id) WHERE rank <= 4 GROUP BY query_id"""
)
def context_block(spark: SparkSession, d: str) -> DataFrame:
    return answer.build_context(_fused(spark, d, 4).join(_docs(spark, d).select("id", "text"), "id"))


_SIZE, _OVERLAP = 1000, 200


@_query(
    f"""WITH w AS (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - {_SIZE}) / {_SIZE - _OVERLAP})::BIGINT))) AS i FROM documents WHERE text <> ''),
c AS (SELECT doc_id, i, trim(substring(text, i * {_SIZE - _OVERLAP} + 1, {_SIZE})) AS chunk FROM w)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS chunk_id, sha256(chunk) AS sha, length(chunk)::BIGINT AS n FROM c WHERE chunk <> ''"""
)
def hard_split_chunks(spark: SparkSession, d: str) -> DataFrame:
    own = _texts(spark, d).select("doc_id", F.posexplode(text.hard_split(F.col("text"), _SIZE, _OVERLAP)).alias("i", "chunk"))
    return own.select("doc_id", F.col("i").cast("long").alias("chunk_id"), F.sha2("chunk", 256).alias("sha"), F.length("chunk").cast("long").alias("n"))


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@_query(
    r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(30), 'g'), chr(30)) AS l FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(l, lambda x: """ + _STRIP.format("x") + r"""), lambda x: x <> '') AS l FROM s)
SELECT doc_id, len(l)::BIGINT AS n_sentences, sha256(array_to_string(l, chr(10))) AS sha FROM p"""
)
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    own = _texts(spark, d).select("doc_id", text.sentences(F.col("text")).alias("l"))
    return own.select("doc_id", F.size("l").cast("long").alias("n_sentences"), F.sha2(F.array_join("l", "\n"), 256).alias("sha"))


@_query(
    r"""WITH b AS (SELECT doc_id, string_split(""" + _STRIP.format("replace(text, chr(10), chr(10) || chr(10))") + r""", chr(10) || chr(10)) AS l FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(l, lambda x: """ + _STRIP.format("x") + r"""), lambda x: x <> '') AS l FROM b)
SELECT doc_id, len(l)::BIGINT AS n_paragraphs, sha256(array_to_string(l, chr(30))) AS sha FROM p"""
)
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    own = _texts(spark, d).select("doc_id", text.paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))).alias("l"))
    return own.select("doc_id", F.size("l").cast("long").alias("n_paragraphs"), F.sha2(F.array_join("l", "\x1e"), 256).alias("sha"))


# A long text without blank lines is packed by sentences; a long sentence is cut into windows.
_CUTS = _STRIP.format("substring({0}, (i * " + str(_SIZE - _OVERLAP) + " + 1)::BIGINT, " + str(_SIZE) + ")")
_WINDOWS = "list_filter(list_transform(range(0, greatest(0, ceil((length({0}) - " + str(_SIZE) + ") / " + str(_SIZE - _OVERLAP) + "))::BIGINT + 1), lambda i: " + _CUTS + "), lambda c: c <> '')"
_TAIL = _STRIP.format(f"right(a.held, {_OVERLAP})")


def _pieces_sql(source: str, key: str) -> str:
    """CTEs ending in pieces({key}, chunks) of the source's texts that are not blank."""
    return (
        f"""d AS (SELECT {key}, {_STRIP.format("regexp_replace(text, '" + chr(92) + "r" + chr(92) + "n?', chr(10), 'g')")} AS t FROM {source}),
s AS (SELECT {key}, t, list_filter(list_transform(string_split(regexp_replace(t, '([.!?。！？])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS l FROM d WHERE t <> ''),
f AS (SELECT {key}, t, len(l) AS n, list_reduce([{{'out': []::VARCHAR[], 'held': '', 'seg': ''}}] || list_transform(l, lambda x: {{'out': []::VARCHAR[], 'held': '', 'seg': x}}), lambda a, b: {{
      'out': CASE WHEN length(b.seg) > {_SIZE} THEN (CASE WHEN a.held <> '' THEN list_append(a.out, a.held) ELSE a.out END) || {_WINDOWS.format("b.seg")}
                  WHEN length(a.held) + (CASE WHEN a.held <> '' THEN 2 ELSE 0 END) + length(b.seg) <= {_SIZE} THEN a.out ELSE list_append(a.out, a.held) END,
      'held': CASE WHEN length(b.seg) > {_SIZE} THEN '' WHEN a.held = '' THEN b.seg WHEN length(a.held) + 2 + length(b.seg) <= {_SIZE} THEN a.held || chr(10) || chr(10) || b.seg
                   WHEN {_TAIL} <> '' AND length({_TAIL}) + 2 + length(b.seg) <= {_SIZE} THEN {_TAIL} || chr(10) || chr(10) || b.seg ELSE b.seg END,
      'seg': ''}}) AS r FROM s),
pieces AS (SELECT {key}, t, CASE WHEN length(t) <= {_SIZE} THEN [t] WHEN n < 2 THEN {_WINDOWS.format("t")} ELSE list_filter(list_append(r.out, {_STRIP.format("r.held")}), lambda x: x <> '') END AS chunks FROM f)"""
    )


@_query(
    f"""WITH {_pieces_sql('documents', 'doc_id')}, u AS (SELECT doc_id, unnest(chunks) AS text, (generate_subscripts(chunks, 1) - 1)::BIGINT AS chunk_id FROM pieces)
SELECT doc_id || '_chunk_' || chunk_id AS id, text, doc_id::VARCHAR AS parent_id, chunk_id, 'text' AS block_types FROM u"""
)
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunk_documents(_texts(spark, d).select(F.col("doc_id").alias("id"), "text"), _SIZE, _OVERLAP)


@_query(
    f"""WITH d AS (SELECT doc_id, {_STRIP.format("regexp_replace(text, '\\r\\n?', chr(10), 'g')")} AS t FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS l FROM d WHERE t <> ''),
f AS (SELECT doc_id, list_reduce([{{'out': []::VARCHAR[], 'held': '', 'seg': ''}}] || list_transform(l, lambda x: {{'out': []::VARCHAR[], 'held': '', 'seg': x}}), lambda a, b: {{
      'out': CASE WHEN length(a.held) + length(b.seg) + 1 <= {_SIZE} OR a.held = '' THEN a.out ELSE list_append(a.out, {_STRIP.format('a.held')}) END,
      'held': CASE WHEN length(a.held) + length(b.seg) + 1 <= {_SIZE} THEN a.held ELSE right(a.held, {_OVERLAP}) END || b.seg || chr(10), 'seg': ''}}) AS r FROM l),
c AS (SELECT doc_id, list_filter(list_append(r.out, {_STRIP.format('r.held')}), lambda x: x <> '') AS chunks FROM f),
u AS (SELECT doc_id, unnest(chunks) AS text, (generate_subscripts(chunks, 1) - 1)::BIGINT AS chunk_id FROM c)
SELECT doc_id || '_chunk_' || chunk_id AS id, text, doc_id::VARCHAR AS parent_id, chunk_id, 'text' AS block_types FROM u"""
)
def simple_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunk_documents(_texts(spark, d).select(F.col("doc_id").alias("id"), "text"), _SIZE, _OVERLAP, mode="simple")


# No turn is a heading, so a conversation is a greedy packing of its turns; one that is too long is cut on its own.
@_query(
    f"""WITH {_pieces_sql('conversations', 'conv_id, turn, role')},
tl AS (SELECT conv_id, list({{'out': []::STRUCT(t VARCHAR, u VARCHAR[], k VARCHAR[], s BIGINT)[], 't': t, 'u': [conv_id || '_' || turn], 'k': [role], 'p': CASE WHEN length(t) > {_SIZE} THEN chunks END}} ORDER BY turn) AS l FROM pieces GROUP BY conv_id),
tf AS (SELECT conv_id, list_reduce([{{'out': []::STRUCT(t VARCHAR, u VARCHAR[], k VARCHAR[], s BIGINT)[], 't': '', 'u': []::VARCHAR[], 'k': []::VARCHAR[], 'p': NULL::VARCHAR[]}}] || l, lambda a, b: CASE
      WHEN b.p IS NOT NULL THEN {{'out': (CASE WHEN a.t <> '' THEN list_append(a.out, {{'t': a.t, 'u': a.u, 'k': a.k, 's': NULL::BIGINT}}) ELSE a.out END)
           || list_transform(list_zip(b.p, range(len(b.p))), lambda x: {{'t': x[1], 'u': b.u, 'k': b.k, 's': x[2]}}), 't': '', 'u': []::VARCHAR[], 'k': []::VARCHAR[], 'p': NULL::VARCHAR[]}}
      WHEN a.t = '' THEN {{'out': a.out, 't': b.t, 'u': b.u, 'k': b.k, 'p': NULL::VARCHAR[]}}
      WHEN length(a.t) + 2 + length(b.t) <= {_SIZE} THEN {{'out': a.out, 't': a.t || chr(10) || chr(10) || b.t, 'u': a.u || b.u, 'k': a.k || b.k, 'p': NULL::VARCHAR[]}}
      ELSE {{'out': list_append(a.out, {{'t': a.t, 'u': a.u, 'k': a.k, 's': NULL::BIGINT}}), 't': b.t, 'u': b.u, 'k': b.k, 'p': NULL::VARCHAR[]}} END) AS r FROM tl),
c AS (SELECT conv_id, CASE WHEN r.t <> '' THEN list_append(r.out, {{'t': r.t, 'u': r.u, 'k': r.k, 's': NULL::BIGINT}}) ELSE r.out END AS chunks FROM tf),
o AS (SELECT conv_id, unnest(chunks) AS c, (generate_subscripts(chunks, 1) - 1)::BIGINT AS chunk_id FROM c)
SELECT conv_id || '_turn_chunk_' || chunk_id AS id, conv_id::VARCHAR AS parent_id, chunk_id, c.t AS text, array_to_string(c.u, ',') AS unit_ids,
       array_to_string(list_transform(list_filter(list_zip(c.k, range(len(c.k))), lambda p: list_position(c.k, p[1]) = p[2] + 1), lambda p: p[1]), ',') AS block_types, NULL::VARCHAR AS block_ids, NULL::VARCHAR AS bbox, c.s AS split_part FROM o"""
)
def units_scoped_chunks(spark: SparkSession, d: str) -> DataFrame:
    turns = _t(spark, d, "conversations")
    meta = F.create_map(F.lit("document_id"), F.col("conv_id").cast("string"), F.lit("block_type"), F.col("role"), F.lit("source_granularity"), F.lit("turn"))
    units = turns.select(F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("turn").alias("ordinal"), "text", meta.alias("meta"))
    return chunk.chunk_units(units, _SIZE, _OVERLAP, call="document_id").drop("meta").withColumn("unit_ids", F.array_join("unit_ids", ","))


@_query(
    """WITH r AS (SELECT r_regionkey, r_name, n_name, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey)
SELECT r_name, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM r GROUP BY r_name"""
)
def markdown_table(spark: SparkSession, d: str) -> DataFrame:
    own = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    held = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_name"], x["n_nationkey"].cast("string")))
    return own.groupBy("r_name").agg(tables.markdown_table(F.concat(F.array(F.array(F.lit("name"), F.lit("key"))), held)).alias("markdown"))


_LINES = """ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_index FROM documents),
tl AS (SELECT doc_id, line_index, trim(raw) AS line FROM ls)"""
_CLASS = r"""CASE WHEN regexp_matches(line, '^(#{1,6})\s+(.+)$') THEN 'heading' WHEN regexp_matches(line, '^[-*+]\s+\[([ xX])\]\s+(.+)$') OR regexp_matches(line, '^[-*+•]\s+(.+)$') OR regexp_matches(line, '^(\d+)[.)]\s+(.+)$') THEN 'list' ELSE 'paragraph' END"""


@_query(f"WITH {_LINES} SELECT doc_id, {_CLASS} AS block_type, count(*)::BIGINT AS n FROM tl WHERE line <> '' GROUP BY ALL")
def markdown_line_classes(spark: SparkSession, d: str) -> DataFrame:
    own = _texts(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).where("line <> ''")
    return own.select("doc_id", blocks.line_class(F.col("line"))["block_type"].alias("block_type")).groupBy("doc_id", "block_type").agg(F.count("*").alias("n"))


@_query(
    """WITH u AS (SELECT conv_id, turn, text, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 END AS level FROM conversations),
k AS (SELECT *, count(level) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM u),
g AS (SELECT *, CASE WHEN level IS NOT NULL THEN k + least(0, min(level - k) FILTER (level IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn)) END AS depth FROM k),
w AS (SELECT conv_id, turn, last_value(CASE WHEN depth = 1 THEN text END IGNORE NULLS) OVER o AS h1, last_value(CASE WHEN depth = 1 THEN k END IGNORE NULLS) OVER o AS a1,
             last_value(CASE WHEN depth = 2 THEN text END IGNORE NULLS) OVER o AS h2, last_value(CASE WHEN depth = 2 THEN k END IGNORE NULLS) OVER o AS a2
      FROM g WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, concat_ws(' > ', h1, CASE WHEN a2 > coalesce(a1, 0) THEN h2 END) AS heading_path FROM w"""
)
def heading_path_fill(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).cast("long")
    own = _t(spark, d, "conversations").select("conv_id", "turn", level.alias("level"), "text")
    return blocks.heading_paths(own, "conv_id", "turn").select("conv_id", "turn", "heading_path")


_PAGE = r"""pm AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '/(en|fr|de|es)/', 1) AS label, url FROM pages)"""


def _page_columns(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("label"), "url")


@_query(
    f"""WITH {_PAGE} SELECT page_id, 'Bài: ' || title || chr(10) || 'Week: ' || chr(10) || 'Date: ' || chr(10) || 'Module: ' || chr(10) || 'Lecturer: ' || chr(10) || 'Label: ' || label || chr(10) || 'Tổng hợp: True' AS text,
    lower(trim(title)) NOT IN ('', 'empty', 'emty', 'untitled notion lesson') AS indexed FROM pm"""
)
def metadata_documents(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    columns = {"title": F.col("title"), "week": none, "date": none, "module": none, "lecturer": none, "label": F.col("label")}
    return _page_columns(spark, d).select("page_id", metadata.metadata_text(**columns, is_summary_done=F.lit(True)).alias("text"), metadata.worth_indexing(**columns).alias("indexed"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props))::BIGINT AS n_keys FROM events")
def property_extract(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@_query("SELECT doc_id, coalesce(array_to_string([lang, source], ', '), '') AS joined, coalesce(lang, '') AS lang, n_chars FROM documents")
def metadata_sanitize(spark: SparkSession, d: str) -> DataFrame:
    own = _t(spark, d, "documents")
    return own.select("doc_id", metadata.sanitized(F.array("lang", "source"), "array<string>").alias("joined"), metadata.sanitized(F.col("lang"), "string").alias("lang"), metadata.sanitized(F.col("n_chars"), "bigint").alias("n_chars"))


@_query("SELECT doc_id, sha256(concat_ws(chr(31), coalesce('+' || source, '-'), coalesce('+' || lang, '-'), coalesce('+' || text, '-'))) AS content_hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", metadata.content_hash(F.col("source"), F.col("lang"), F.col("text")).alias("content_hash"))


@_query(
    """SELECT page_id, 'Notion: ' || title || ', chunk 0' AS label, 'PDF: ' || url || ', page 1, chunk 0' AS pdf_label, 'Notion:' || title || ':heading=:id=' || page_id AS source_title
FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"""
)
def source_names(spark: SparkSession, d: str) -> DataFrame:
    zero, one, none = F.lit("0"), F.lit("1"), F.lit(None).cast("string")
    return _page_columns(spark, d).select(
        "page_id",
        metadata.source_label(F.lit("notion"), none, none, F.col("title"), zero).alias("label"),
        metadata.source_label(F.lit("pdf"), F.col("url"), one, none, zero).alias("pdf_label"),
        metadata.source_title(F.lit("notion"), none, none, F.col("title"), none, F.col("page_id")).alias("source_title"),
    )


@_query(
    r"""WITH c AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM documents)
SELECT doc_id, CASE WHEN length(clean) <= 180 THEN clean ELSE substring(clean, 1, 177) || '...' END AS preview, substring(trim(replace(text, chr(10), ' ')), 1, 180) AS cut, sha256(replace(replace(text, '|', '\|'), chr(10), ' ')) AS escaped FROM c"""
)
def previews(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", text.preview(t, 180).alias("preview"), text.cut_preview(t, 180).alias("cut"), F.sha2(text.escape_markdown(t), 256).alias("escaped"))


# The source as it is, and what a sync before a made change has left.
_SYNC = """src AS (SELECT doc_id::VARCHAR AS page_id, sha256(text) AS content_hash, CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE '' END AS remote_hash,
               CASE WHEN doc_id % 11 = 0 THEN '2024-02-01T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS last_edited_time FROM documents),
st AS (SELECT doc_id::VARCHAR AS page_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(text) END AS content_hash, CASE WHEN doc_id % 2 = 0 THEN '2024-01-01T00:00:00Z' ELSE '2023-12-01T00:00:00Z' END AS last_edited_time,
              '2024-01-15T00:00:00+00:00' AS hash_written_at FROM documents WHERE doc_id % 7 <> 0
       UNION ALL SELECT (-i)::VARCHAR, 'gone', '', '' FROM range(1, 11) t(i)),
diff AS (SELECT coalesce(src.page_id, st.page_id) AS page_id, CASE WHEN src.page_id IS NULL THEN 'removed' WHEN st.page_id IS NULL THEN 'new'
    WHEN (remote_hash <> '' AND remote_hash = st.content_hash AND src.last_edited_time <= '2024-01-15') OR (st.content_hash <> '' AND src.last_edited_time = st.last_edited_time) THEN 'skipped'
    WHEN src.content_hash = st.content_hash THEN 'hash_unchanged' ELSE 'changed' END AS status FROM src FULL JOIN st ON src.page_id = st.page_id)"""


def _sync_tables(spark: SparkSession, d: str, *more: str) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, d, "documents")
    sha = F.sha2("text", 256)
    source = docs.select(
        F.col("doc_id").cast("string").alias("page_id"), sha.alias("content_hash"), F.when(F.col("doc_id") % 3 == 0, sha).otherwise("").alias("remote_hash"),
        F.when(F.col("doc_id") % 11 == 0, "2024-02-01T00:00:00Z").otherwise("2024-01-01T00:00:00Z").alias("last_edited_time"), *more,
    )
    state = docs.where("doc_id % 7 <> 0").select(
        F.col("doc_id").cast("string").alias("page_id"), F.when(F.col("doc_id") % 5 == 0, "old").otherwise(sha).alias("content_hash"),
        F.when(F.col("doc_id") % 2 == 0, "2024-01-01T00:00:00Z").otherwise("2023-12-01T00:00:00Z").alias("last_edited_time"), F.lit("2024-01-15T00:00:00+00:00").alias("hash_written_at"),
    )
    gone = spark.range(1, 11).select((-F.col("id")).cast("string").alias("page_id"), F.lit("gone").alias("content_hash"), F.lit("").alias("last_edited_time"), F.lit("").alias("hash_written_at"))
    return source, state.unionByName(gone)


@_query(f"WITH {_SYNC} SELECT page_id, status FROM diff")
def sync_diff(spark: SparkSession, d: str) -> DataFrame:
    return sync.diff(*_sync_tables(spark, d)).select("page_id", "status")


@_query(
    f"""WITH {_SYNC} SELECT 'incremental' AS sync_mode, count(*) FILTER (status <> 'removed')::BIGINT AS pages_seen, count(*) FILTER (status = 'new')::BIGINT AS pages_new, count(*) FILTER (status = 'changed')::BIGINT AS pages_changed,
    count(*) FILTER (status = 'hash_unchanged')::BIGINT AS pages_hash_unchanged, count(*) FILTER (status = 'skipped')::BIGINT AS pages_skipped, count(*) FILTER (status = 'removed')::BIGINT AS pages_removed FROM diff"""
)
def sync_summary(spark: SparkSession, d: str) -> DataFrame:
    return sync.summary(sync.diff(*_sync_tables(spark, d)))


@_query(
    f"""WITH {_SYNC} SELECT coalesce(src.page_id, st.page_id) AS page_id, CASE WHEN status IN ('new', 'changed') THEN src.content_hash ELSE st.content_hash END AS content_hash
FROM diff LEFT JOIN src USING (page_id) LEFT JOIN st USING (page_id) WHERE status <> 'removed'"""
)
def sync_next_state(spark: SparkSession, d: str) -> DataFrame:
    source, state = _sync_tables(spark, d)
    state = state.withColumns({"title": F.lit(""), "indexed_ids": F.array().cast("array<string>")})
    changes = sync.diff(source, state).withColumn("title", F.lit(""))
    indexed = source.select("page_id", F.array("page_id").alias("indexed_ids"))
    return sync.next_state(changes, state, indexed, "2024-03-01T00:00:00+00:00").select("page_id", "content_hash")


_RELEVANT = "rel AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, id): documents that hold a passage verbatim."""
    return evaluate.holders(_docs(spark, d), _questions(spark, d))


@_query(
    f"""WITH {_RELEVANT}, {_bm25_sql('documents', 'doc_id', K)},
found AS (SELECT rel.query_id, count(*) AS n FROM rel JOIN keyword USING (query_id, id) GROUP BY rel.query_id)
SELECT rel.query_id, count(*)::BIGINT AS n_relevant, coalesce(max(n), 0)::BIGINT AS n_found, round(coalesce(max(n), 0) / count(*), 9) AS recall FROM rel LEFT JOIN found USING (query_id) GROUP BY rel.query_id"""
)
def eval_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    hits = bm25.search(_docs(spark, d), _questions(spark, d), K).withColumn("rank", F.col("keyword_rank"))
    return evaluate.recall_at_k(hits, _relevant(spark, d), K).withColumn("recall", F.round("recall", 9))


def _records(spark: SparkSession, d: str) -> DataFrame:
    samples = _hybrid_questions(spark, d).withColumn("sample_id", F.col("query_id").cast("string")).drop("query_id").withColumns({"ground_truth": F.col("question"), "expected_source_notes": F.lit(""), "tags": F.array(F.lit("benchmark"))})
    corpus = _hybrid(spark, d).select("id", "text", "embedding")
    return evaluate.run(corpus, samples, ["vector", "keyword", "hybrid_rrf"], top_k=4, candidate_k=CANDIDATES, generator=None)


_EVAL = f"""{_RRF}, hits AS (
  SELECT 'vector' AS pipeline_name, query_id, id, vector_rank AS rank FROM near WHERE vector_rank <= 4 UNION ALL
  SELECT 'keyword', query_id, id, keyword_rank FROM kw WHERE keyword_rank <= 4 UNION ALL
  SELECT 'hybrid_rrf', query_id, id, rank FROM ranked WHERE rank <= 4),
rec AS (SELECT pipeline_name, query_id::VARCHAR AS sample_id, string_agg(id::VARCHAR, ' | ' ORDER BY rank) AS source_ids, count(*)::BIGINT AS source_count FROM hits GROUP BY ALL)"""


@_query(f"WITH {_EVAL} SELECT pipeline_name, sample_id, source_ids, source_count FROM rec")
def eval_records(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("pipeline_name", "sample_id", text.join_list(F.col("source_ids")).alias("source_ids"), F.size("source_ids").cast("long").alias("source_count"))


@_query(f"WITH {_EVAL} SELECT pipeline_name, count(*)::BIGINT AS question_count, round(avg(source_count), 9) AS average_context_count, round(avg(source_count), 9) AS average_source_count FROM rec GROUP BY pipeline_name")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    own = evaluate.summarize(_records(spark, d))
    return own.select("pipeline_name", "question_count", F.round("average_context_count", 9).alias("average_context_count"), F.round("average_source_count", 9).alias("average_source_count"))


_LABELS = "CASE pipeline_name " + " ".join(f"WHEN '{n}' THEN '{evaluate.PRESETS[n]['label']}'" for n in ("vector", "keyword", "hybrid_rrf")) + " END"


@_query(
    f"""WITH {_EVAL}, depth AS (SELECT 'vector' AS pipeline_name, query_id::VARCHAR AS sample_id, count(*) AS n FROM near GROUP BY query_id UNION ALL
  SELECT 'keyword', query_id::VARCHAR, count(*) FROM kw GROUP BY query_id UNION ALL SELECT 'hybrid_rrf', query_id::VARCHAR, count(*) FROM ranked WHERE rank <= {CANDIDATES} GROUP BY query_id)
SELECT pipeline_name, {_LABELS} AS pipeline_label, sample_id, b.text AS question, '' AS answer, '' AS error, 0::BIGINT AS attempt_count, true AS generation_skipped, b.text AS ground_truth, '' AS expected_source_notes,
  'benchmark' AS tags, source_count, source_ids, source_ids AS source_titles, n::BIGINT AS retrieved_count, n::BIGINT AS reranked_count, source_count AS final_count, pipeline_name AS retrieval_mode, {CANDIDATES}::BIGINT AS candidate_k,
  false AS rerank_enabled, false AS mmr_enabled, NULL::DOUBLE AS faithfulness, NULL::DOUBLE AS answer_relevancy, NULL::DOUBLE AS context_precision, NULL::DOUBLE AS context_recall, '' AS ragas_error
FROM rec JOIN depth USING (pipeline_name, sample_id) JOIN benchmark b ON b.item_id::VARCHAR = sample_id"""
)
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.report_rows(_records(spark, d))


@_query()
def answer_batch(spark: SparkSession, d: str) -> DataFrame:
    """Whole funnel with offline rerank, MMR and extractive answers."""
    corpus = _hybrid(spark, d).select("id", "text", "embedding")
    return answer.answer(corpus, _hybrid_questions(spark, d), mode="hybrid", rerank=True, scorer=rank.overlap_scorer, mmr=True)


@_query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def chat_history_window(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.last_turns(_t(spark, d, "conversations"), 4).select("conv_id", "turn", "role", "text")


@_query("SELECT time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(_t(spark, d, "events"), "1 hour", "10 minutes").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@_query("SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY event_type")
def event_types(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))

