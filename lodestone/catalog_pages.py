"""Queries of pages, block trees, the store and the sync over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .catalog import _CLASS, _PAGE, _STRIP, _SYNC, QUERIES, SQL, _page_columns, _query, _sync_tables, _t, _texts
from .functions import metadata
from .operators import blocks, sync
from .operators.keyword_index import KeywordIndex
from .operators.vector_index import VectorIndex
from .sources.scratch import fresh_path
from .sources.state import StateStore
from .sources.store import CorpusStore

__all__ = ["QUERIES", "SQL"]

# Each document as a page: its language as a heading, its text as a pasted paragraph, its source as a list item, a code block, a
# formula without text, an image, and a table of two rows.
_BODY = r"""CASE WHEN kind = 'heading' THEN trim(regexp_extract(line, '^(#{1,6})\s+(.+)$', 2))
  WHEN regexp_matches(line, '^[-*+]\s+\[([ xX])\]\s+(.+)$') THEN '- [' || CASE WHEN lower(regexp_extract(line, '^[-*+]\s+\[([ xX])\]\s+(.+)$', 1)) = 'x' THEN 'x' ELSE ' ' END || '] ' || trim(regexp_extract(line, '^[-*+]\s+\[([ xX])\]\s+(.+)$', 2))
  WHEN regexp_matches(line, '^[-*+•]\s+(.+)$') THEN '- ' || trim(regexp_extract(line, '^[-*+•]\s+(.+)$', 1))
  WHEN regexp_matches(line, '^(\d+)[.)]\s+(.+)$') THEN regexp_extract(line, '^(\d+)[.)]\s+(.+)$', 1) || '. ' || trim(regexp_extract(line, '^(\d+)[.)]\s+(.+)$', 2)) ELSE line END"""

_UNITS = rf"""
src AS (SELECT doc_id, lang, source, {_STRIP.format('text')} AS t FROM documents),
raw AS (SELECT doc_id, list_transform(string_split_regex(t, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {_STRIP.format('x')}) AS l FROM src WHERE t <> ''),
pick AS (SELECT doc_id, CASE WHEN len(list_filter(l, lambda x: x <> '')) > 1 THEN l ELSE list_filter(l, lambda x: x <> '') END AS l FROM raw),
ls AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM pick),
cls AS (SELECT doc_id, pos, line, CASE WHEN line = '' THEN '' ELSE {_CLASS} END AS kind FROM ls),
body AS (SELECT doc_id, pos, kind, least(3, length(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 1))) AS level, {_BODY} AS body FROM cls),
isl AS (SELECT *, sum(CASE WHEN kind = 'paragraph' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM body),
par AS (SELECT doc_id, 1 AS block, min(pos) AS pos, any_value(kind) AS kind, CASE WHEN any_value(kind) = 'heading' THEN any_value(level) END AS level, {_STRIP.format("string_agg(body, ' ' ORDER BY pos)")} AS text
        FROM isl WHERE kind <> '' GROUP BY doc_id, g, kind = 'paragraph'),
parts AS (SELECT doc_id, 0 AS block, 0 AS pos, 'heading' AS kind, 2 AS level, '## ' || lang AS text FROM src
  UNION ALL SELECT * FROM par WHERE text <> ''
  UNION ALL SELECT doc_id, 2, 0, 'list', NULL, '- ' || source FROM src
  UNION ALL SELECT doc_id, 3, 0, 'code', NULL, '```sql' || chr(10) || 'x' || chr(10) || '```' FROM src
  UNION ALL SELECT doc_id, 5, 0, 'image', NULL, '[Image: image block]' FROM src
  UNION ALL SELECT doc_id, 6, 0, 'table', NULL, '| a | b\|c |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || lang || ' |  |' FROM src),
heads AS (SELECT *, {_STRIP.format("regexp_replace(text, '^#+', '')")} AS title FROM parts),
k AS (SELECT * REPLACE (CASE WHEN title <> '' THEN level END AS level), count(CASE WHEN title <> '' THEN level END) OVER (PARTITION BY doc_id ORDER BY block, pos) AS k FROM heads),
dp AS (SELECT *, CASE WHEN level IS NOT NULL THEN k + least(0, min(level - k) FILTER (level IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY block, pos)) END AS depth FROM k),
h AS (SELECT *, {', '.join(f"last_value(CASE WHEN depth = {n} THEN title END IGNORE NULLS) OVER o AS h{n}, coalesce(last_value(CASE WHEN depth = {n} THEN k END IGNORE NULLS) OVER o, 0) AS a{n}" for n in (1, 2, 3))}
      FROM dp WINDOW o AS (PARTITION BY doc_id ORDER BY block, pos ROWS UNBOUNDED PRECEDING)),
units AS (SELECT doc_id::VARCHAR AS page_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block, pos) - 1)::BIGINT AS ordinal, kind AS block_type, text,
                 concat_ws(' > ', h1, CASE WHEN a2 > a1 THEN h2 END, CASE WHEN a3 > greatest(a1, a2) THEN h3 END) AS heading_path FROM h)"""


def _pages_of(spark: SparkSession, d: str) -> DataFrame:
    rich = lambda c: F.array(F.struct(c.alias("plain_text")))
    cell = lambda c: F.array(F.struct(c.alias("plain_text")))
    text = lambda c: F.to_json(F.struct(rich(c).alias("rich_text")))
    block = lambda key, kind, payload, more="": F.concat(F.lit(f'{{"id":"{key}","type":"{kind}","{kind}":'), payload, F.lit(f"{more}}}"))
    row = lambda *cells: F.concat(F.lit('{"type":"table_row","table_row":'), F.to_json(F.struct(F.array(*map(cell, cells)).alias("cells"))), F.lit("}"))
    table = F.concat(F.lit('{"id":"t","type":"table","table":{},"children":['), row(F.lit("a"), F.lit("b|c")), F.lit(","), F.concat(F.lit('{"type":"table_row","table_row":'), F.to_json(F.struct(F.array(cell(F.col("lang"))).alias("cells"))), F.lit("}")), F.lit("]}"))
    trees = F.concat(
        F.lit("["), block("h", "heading_2", text(F.col("lang"))), F.lit(","), block("p", "paragraph", text(F.col("text"))), F.lit(","), block("b", "bulleted_list_item", text(F.col("source"))), F.lit(","),
        F.lit('{"id":"c","type":"code","code":{"language":"sql","rich_text":[{"text":{"content":"x"}}]}},{"id":"e","type":"equation","equation":{}},{"id":"i","type":"image","image":{"type":"file","file":{"url":"u"}}},'), table, F.lit("]"),
    )
    return _texts(spark, d).select(F.col("doc_id").cast("string").alias("page_id"), trees.alias("blocks"), F.create_map().cast("map<string,string>").alias("meta"))


@_query(f"WITH {_UNITS} SELECT page_id, ordinal, block_type, heading_path, sha256(text) AS sha FROM units")
def block_units(spark: SparkSession, d: str) -> DataFrame:
    got = blocks.parse_pages(_pages_of(spark, d))
    return got.select("page_id", "ordinal", F.col("meta")["block_type"].alias("block_type"), F.col("meta")["heading_path"].alias("heading_path"), F.sha2("text", 256).alias("sha"))


@_query(f"WITH {_UNITS} SELECT page_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY ordinal)) AS sha FROM units GROUP BY page_id")
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return blocks.to_markdown(blocks.parse_pages(_pages_of(spark, d))).select("page_id", F.sha2("markdown", 256).alias("sha"))


@_query(f"WITH {_UNITS} SELECT page_id, count(*)::BIGINT AS units, count(*) FILTER (block_type = 'table')::BIGINT AS tables, count(*) FILTER (block_type = 'image')::BIGINT AS ocr, count(*) FILTER (block_type = 'image' AND page_id::BIGINT % 2 = 0)::BIGINT AS vision_ok, count(*) FILTER (block_type = 'image' AND page_id::BIGINT % 2 <> 0)::BIGINT AS vision_errors FROM units GROUP BY page_id")
def unit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts over units as an image reader would have left them."""
    units = blocks.parse_pages(_pages_of(spark, d))
    even, image = F.col("page_id").cast("bigint") % 2 == 0, F.col("meta")["block_type"] == "image"
    told = F.create_map(F.lit("image_ocr_text"), F.when(even, "yes").otherwise(""), F.lit("ocr_provider"), F.lit("made"), F.lit("ocr_error"), F.when(even, "").otherwise("failed"))
    return sync.unit_counts(units.withColumn("meta", F.when(image, F.map_concat("meta", told)).otherwise(F.col("meta"))))


@_query(
    f"""WITH {_PAGE} SELECT page_id::VARCHAR AS page_id, CASE WHEN title = '' THEN '{metadata.NO_TITLE}' ELSE trim(title) END AS title, page_id::VARCHAR AS week, '2024-05-0' || (page_id % 9 + 1) AS date, 'm' || label AS module, 'Ana, Bo' AS lecturer,
    label || ', x' AS label, page_id % 2 = 0 AS is_summary_done, url AS notion_url, 't' || page_id AS last_edited_time, sha256(url) AS remote_content_hash FROM pm"""
)
def page_properties(spark: SparkSession, d: str) -> DataFrame:
    """Pages as JSON with properties of many types under names in two languages, and back to columns."""
    p, of = _page_columns(spark, d), lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias(kind))
    named = lambda *names: F.array(*(F.struct(n.alias("name")) for n in names))
    props = F.struct(
        of("title", F.array(F.struct(F.trim("title").alias("plain_text")))).alias("Name"), of("number", F.col("page_id")).alias("Tuần"), of("date", F.struct(F.concat(F.lit("2024-05-0"), F.col("page_id") % 9 + 1).alias("start"))).alias("Ngày_học"),
        of("formula", F.struct(F.lit("string").alias("type"), F.concat(F.lit("m"), "label").alias("string"))).alias("Module"), of("people", named(F.lit("Ana"), F.lit("Bo"))).alias("Giảng-viên"),
        of("multi_select", named(F.col("label"), F.lit("x"))).alias("TAGS"), of("checkbox", F.col("page_id") % 2 == 0).alias("Done"), of("rich_text", F.array(F.struct(F.lit(" ").alias("plain_text"), F.lit(None).cast("struct<content:string>").alias("text")), F.struct(F.lit(None).cast("string").alias("plain_text"), F.struct(F.sha2("url", 256).alias("content")).alias("text")))).alias("Content Hash"),
    )
    page = F.to_json(F.struct(F.col("page_id").cast("string").alias("id"), "url", F.concat(F.lit("t"), "page_id").alias("last_edited_time"), props.alias("properties")))
    return p.select(page.alias("page")).select(*(c.alias(n) for n, c in metadata.page_metadata(F.col("page")).items() if n not in ("source_type", "raw_properties_json")))


_JSON = "coalesce(to_json({0})::VARCHAR, 'null')"


@_query(
    f"""SELECT doc_id, sha256('{{"content_units":[{{"id":"u' || doc_id || '","metadata":{{"block_id":"' || doc_id || '","block_type":"paragraph"}},"text":' || {_JSON.format("coalesce(text, '')")} || '}}],"metadata":{{"label":' || {_JSON.format('lang')}
    || ',"title":' || {_JSON.format('source')} || '}},"metadata_document_text":' || {_JSON.format("coalesce(source, '')")} || '}}') AS lesson_hash FROM documents"""
)
def lesson_hashes(spark: SparkSession, d: str) -> DataFrame:
    meta = F.create_map(F.lit("title"), F.col("source"), F.lit("last_edited_time"), F.lit("now"), F.lit("label"), F.col("lang"))
    unit = F.struct(F.concat(F.lit("u"), "doc_id").alias("id"), F.col("text").alias("text"), F.create_map(F.lit("block_type"), F.lit("paragraph"), F.lit("chunk_id"), F.lit("7"), F.lit("block_id"), F.col("doc_id").cast("string")).alias("meta"))
    return _t(spark, d, "documents").select("doc_id", metadata.lesson_hash(meta, F.col("source"), F.array(unit)).alias("lesson_hash"))


def _stored(docs: DataFrame, text: Column | None = None) -> DataFrame:
    key = lambda name, n: (F.lit(f"{name}_id"), F.concat(F.lit(name[0]), (F.col("doc_id") % n).cast("string")))
    return docs.select(F.col("doc_id").cast("string").alias("id"), (F.col("text") if text is None else text).alias("text"), F.create_map(F.lit("source_type"), F.col("lang"), *key("document", 10), *key("page", 7)).alias("meta"), F.array(F.lit(1.0).cast("float")).alias("embedding"))


@_query(
    """SELECT doc_id::VARCHAR AS id, lang AS source_type, sha256(CASE WHEN doc_id % 5 = 0 THEN 'new ' || text ELSE text END) AS sha FROM documents WHERE lang <> 'fr' AND doc_id % 10 <> 3 AND doc_id % 7 <> 1
UNION ALL SELECT doc_id::VARCHAR, lang, sha256(text) FROM documents WHERE lang = 'fr' AND doc_id % 2 = 0"""
)
def store_mutations(spark: SparkSession, d: str) -> DataFrame:
    """A store after an insert, an update by id, deletes by document and by page, and one source anew."""
    docs, store = _t(spark, d, "documents"), CorpusStore(spark, fresh_path(spark, "store"), buckets=8)
    store.upsert(_stored(docs))
    store.upsert(_stored(docs.where("doc_id % 5 = 0"), F.concat(F.lit("new "), "text")))
    store.delete({"document_id": "d3"})
    store.delete({"page_id": "p1"})
    store.replace_source("fr", _stored(docs.where("lang = 'fr' and doc_id % 2 = 0")))
    return store.get().select("id", F.col("meta")["source_type"].alias("source_type"), F.sha2("text", 256).alias("sha"))


@_query("SELECT count(*)::BIGINT AS n FROM documents WHERE lang = 'en' AND doc_id % 10 = 4")
def store_filter(spark: SparkSession, d: str) -> DataFrame:
    """Stored documents by a metadata filter."""
    store = CorpusStore(spark, fresh_path(spark, "store"), buckets=8)
    store.upsert(_stored(_t(spark, d, "documents")))
    return store.get({"source_type": "en", "document_id": "d4"}).agg(F.count("*").alias("n"))


@_query(
    """SELECT doc_id::VARCHAR AS id, sha256(text) AS sha_before, CASE WHEN doc_id % 7 <> 1 OR doc_id % 5 = 0 THEN sha256(CASE WHEN doc_id % 5 = 0 THEN 'new ' || text ELSE text END) END AS sha_after
FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 1"""
)
def store_versions(spark: SparkSession, d: str) -> DataFrame:
    """What a page's removal and an update by id, by two writers, changed between two versions of a store."""
    docs, store = _t(spark, d, "documents"), CorpusStore(spark, fresh_path(spark, "store"), buckets=8)
    store.upsert(_stored(docs))
    first = store.versions()[-1]
    CorpusStore(spark, store.path).delete({"page_id": "p1"})
    store.upsert(_stored(docs.where("doc_id % 5 = 0"), F.concat(F.lit("new "), "text")))
    before, after = (store.read(v).select("id", F.sha2("text", 256).alias(c)) for v, c in ((first, "sha_before"), (None, "sha_after")))
    return before.join(after, "id", "left").where("sha_after is null or sha_before <> sha_after")


@_query(
    f"""WITH {_SYNC} SELECT page_id, CASE WHEN status IN ('new', 'changed') THEN src.content_hash ELSE st.content_hash END AS content_hash, CASE WHEN status = 'skipped' THEN st.last_edited_time ELSE src.last_edited_time END AS last_edited_time,
    CASE WHEN status IN ('new', 'changed') THEN 'now' ELSE st.hash_written_at END AS hash_written_at, CASE WHEN status IN ('new', 'changed') THEN page_id || '_0' ELSE '' END AS indexed,
    CASE WHEN status IN ('new', 'changed') THEN page_id || '_0' ELSE 'old_' || page_id END AS stored FROM diff LEFT JOIN src USING (page_id) LEFT JOIN st USING (page_id) WHERE status <> 'removed'"""
)
def sync_run(spark: SparkSession, d: str) -> DataFrame:
    """A whole sync: diff, documents of what changed, the store in one swap, and the next state; with what the store then holds."""
    return _synced(spark, d)[0]


@_query(
    f"""WITH {_SYNC} SELECT 'incremental' AS sync_mode, count(*) FILTER (status <> 'removed')::BIGINT AS pages_seen, count(*) FILTER (status = 'new')::BIGINT AS pages_new, count(*) FILTER (status = 'changed')::BIGINT AS pages_changed,
    count(*) FILTER (status = 'hash_unchanged')::BIGINT AS pages_hash_unchanged, count(*) FILTER (status = 'skipped')::BIGINT AS pages_skipped, count(*) FILTER (status = 'removed')::BIGINT AS pages_removed,
    count(*) FILTER (status IN ('new', 'changed') AND page_id::BIGINT % 4 <> 0)::BIGINT AS hashes_written, count(*) FILTER (status IN ('new', 'changed') AND page_id::BIGINT % 4 = 0)::BIGINT AS hash_write_failures FROM diff"""
)
def sync_write_back(spark: SparkSession, d: str) -> DataFrame:
    """The counters of a whole sync whose hashes are written back to a source that refuses some."""
    return _synced(spark, d)[1]


@_query(
    """SELECT doc_id::VARCHAR AS page_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE sha256(text) END AS content_hash FROM documents WHERE doc_id % 4 <> 1
UNION ALL SELECT (-doc_id - 1)::VARCHAR, 'new' FROM documents WHERE doc_id % 3 = 0"""
)
def state_mutations(spark: SparkSession, d: str) -> DataFrame:
    """A sync state after a first write, a clear, a write anew, removals, and an upsert of old and new records."""
    state = _sync_tables(spark, d)[0].select("page_id", "content_hash", "last_edited_time", F.lit("").alias("hash_written_at"), F.lit("").alias("title"), F.array().cast("array<string>").alias("indexed_ids"))
    store, number = StateStore(spark, fresh_path(spark, "state")), F.col("page_id").cast("bigint")
    store.write(state)
    store.clear()
    store.upsert(state)
    store.remove(state.where(number % 4 == 1))
    fresh = state.where(number % 3 == 0).withColumn("content_hash", F.lit("new"))
    store.upsert(fresh.where(number % 4 != 1).unionByName(fresh.withColumn("page_id", (-number - 1).cast("string"))))
    return store.read().select("page_id", "content_hash")


def _refuse(page: str, sha: str) -> None:
    if int(page) % 4 == 0:
        raise ValueError(f"{page} refused")


def _synced(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    source, state = _sync_tables(spark, d)
    state = state.withColumns({"title": F.lit(""), "indexed_ids": F.array().cast("array<string>")})
    row = lambda key: (key.alias("id"), F.lit("text").alias("text"), F.create_map(F.lit("source_type"), F.lit("notion"), F.lit("page_id"), F.col("page_id")).alias("meta"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    store = CorpusStore(spark, fresh_path(spark, "store"), buckets=8)
    store.upsert(state.select(*row(F.concat(F.lit("old_"), "page_id"))))
    got = sync.run(store, source.withColumn("title", F.lit("")), state, lambda lessons: lessons.select(*row(F.concat("page_id", F.lit("_0")))), "now", write_back=_refuse)
    held = store.get().groupBy(F.col("meta")["page_id"].alias("page_id")).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("stored"))
    return got.state.join(held, "page_id", "left").select("page_id", "content_hash", "last_edited_time", "hash_written_at", F.array_join("indexed_ids", ",").alias("indexed"), "stored"), got.summary


def _indexed(spark: SparkSession, d: str) -> VectorIndex:
    """An index of all embeddings after a later batch that replaces and adds rows, and after removals."""
    own = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex(spark, fresh_path(spark, "vectors"))
    index.build(own.where("id % 10 <> 9"))
    index.upsert(own.where("id % 10 = 9").unionByName(own.where("id % 10 = 4").withColumn("embedding", F.transform("embedding", lambda x: -x))))
    index.delete(own.where("id % 10 = 5"))
    return index


@_query()
def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest rows by the index; exact distances, recall by tests."""
    return _indexed(spark, d).search(catalog._query_vectors(spark, d), catalog.K)


@_query("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: (CASE WHEN vec_id % 10 = 4 THEN -x ELSE x END)::DOUBLE)), 6) AS total FROM embeddings WHERE vec_id % 10 <> 5")
def vector_index_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the index holds after all changes, and after its lists were written anew."""
    index = _indexed(spark, d)
    index.compact()
    return index.read().select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


def _keywords(spark: SparkSession, d: str) -> KeywordIndex:
    """A keyword index of all documents, made of a first batch, one that adds and replaces some, and removals that are taken back."""
    docs = catalog._docs(spark, d).select("id", "text")
    index = KeywordIndex(spark, fresh_path(spark, "keywords"))
    index.upsert(docs.where("id % 10 <> 3").withColumn("text", F.when(F.col("id") % 50 == 1, F.concat("text", F.lit(" old"), "text")).otherwise(F.col("text"))))
    index.upsert(docs.where("id % 10 = 3 or id % 50 = 1 or id % 100 = 2"))
    index.delete(docs.where("id % 100 = 2"))
    index.upsert(docs.where("id % 100 = 2"))
    return index


@_query(SQL["bm25_topk"])
def keyword_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """bm25_topk by an index that was changed in steps."""
    return _keywords(spark, d).search(catalog._questions(spark, d), catalog.K)


@_query(SQL["term_document_frequency"].replace(", count(*)::BIGINT AS tf", ""))
def keyword_index_terms(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies by the index after the same steps, its segments then written as one."""
    index = _keywords(spark, d)
    index.merge()
    return index.terms()
