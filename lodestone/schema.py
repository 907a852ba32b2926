"""Schemas of the tables that the pipeline passes on."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, LongType, MapType, StringType, StructField, StructType

_KINDS = {
    "string": StringType(), "bigint": LongType(), "double": DoubleType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType()),
    "array<float>": ArrayType(FloatType()), "map<string,string>": MapType(StringType(), StringType()), "map<string,double>": MapType(StringType(), DoubleType()),
}


def _table(columns: str) -> StructType:
    """A schema from "name type, ..."; unlike Spark's own parser it needs no session."""
    return StructType([StructField(n, _KINDS[k]) for n, k in (c.split() for c in columns.split(", "))])


#: A unit: one layout or page block. ordinal gives the order within the call; scope columns are in meta.
UNIT = _table("id string, ordinal bigint, text string, meta map<string,string>")
#: A chunk or document of the corpus.
DOCUMENT = _table("id string, text string, meta map<string,string>")
#: A stored document with its vector.
STORED = _table("id string, text string, meta map<string,string>, embedding array<float>, source_type string")
#: What is known of a page after a sync.
SYNC_STATE = _table("page_id string, content_hash string, last_edited_time string, hash_written_at string, title string, indexed_ids array<string>")
#: A test question.
SAMPLE = _table("sample_id string, question string, ground_truth string, expected_source_notes string, tags array<string>, top_k bigint")
#: Answer of one pipeline to one question.
RECORD = _table(
    "pipeline string, sample_id string, question string, answer string, error string, attempt_count bigint, generation_skipped boolean, ground_truth string, "
    "expected_source_notes string, tags array<string>, contexts array<string>, source_ids array<string>, source_titles array<string>, "
    "retrieved_count bigint, reranked_count bigint, final_count bigint, metrics map<string,double>, metric_error string"
)
