"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, decontam, jaccard_join, line_dedup, packing, quality
from lodestone.llm.queries import tokenizer_path
from lodestone.sources.scratch import spread

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

ORACLE_SQL = None

#: Ids of removed or repeated documents that are sent to every executor; more are joined by a shuffle.
SENT = 2_000_000


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null or empty text fails them, repeated rows are judged alike."""
    return quality.quality_rules(docs).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their site's boilerplate lines. Every row stays; a null text stays null."""
    return line_dedup.drop_lines(docs).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Of repeated rows one stays. Rows without an id, and empty texts, are in no group and pass.
    """
    stays = F.col("doc_id") == F.col("component_id")
    found = jaccard_join.similar(docs).where("doc_id is not null").groupBy("doc_id").agg(F.count_if(stays).alias("n"))
    # Texts stay where they are: the ids that go, or come again, are few and are sent to them.
    other = common.materialize(found.where("n <> 1"), "near")
    sent = F.broadcast if common.small_enough(other, SENT) else lambda df: df
    docs = docs.select(*COLUMNS)
    alone = docs.join(sent(other.select("doc_id")), "doc_id", "left_anti")
    again = docs.join(sent(other.where("n > 1").select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return alone.unionByName(again).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null and empty texts hold none; repeated rows go or stay together."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # Rows without an id go by their text.
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null").withColumn("_text", F.xxhash64("text"))
    leaks = decontam.find_leaks(named, benchmark).select("doc_id").distinct()
    other = decontam.find_leaks(nameless, benchmark, key="_text").select(F.col("doc_id").alias("_text")).distinct()
    clean = named.join(common.materialize(leaks, "leaks"), "doc_id", "left_anti").select(*COLUMNS)
    return clean.unionByName(nameless.join(common.materialize(other, "leaks"), "_text", "left_anti").select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of all rows; a null or empty text is its end id alone."""
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again before the next."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
