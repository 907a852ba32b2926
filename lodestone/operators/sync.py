"""Incremental sync: what changed between a source and the state of the last sync."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import one_line
from ..functions.text import parse_iso
from ..schema import SYNC_STATE
from ..sources.scratch import materialize, observed
from ..sources.store import CorpusStore

COUNTERS = ("new", "changed", "hash_unchanged", "skipped", "removed")


def skip_by_hash() -> Column:
    """The remote hash is the known one, and the page was not edited after the hash was written."""
    edited, written = parse_iso(F.col("last_edited_time")), parse_iso(F.col("s_hash_written_at"))
    return F.coalesce((F.coalesce(F.col("remote_hash"), F.lit("")) != "") & (F.col("remote_hash") == F.col("s_content_hash")) & (edited <= written), F.lit(False))


def skip_by_time() -> Column:
    """There is a known hash, and the edit time is the known one, as text."""
    have = (F.coalesce(F.col("s_content_hash"), F.lit("")) != "") & (F.coalesce(F.col("last_edited_time"), F.lit("")) != "")
    return F.coalesce(have & (F.col("last_edited_time") == F.col("s_last_edited_time")), F.lit(False))


def diff(source: DataFrame, state: DataFrame, *, live: bool = True) -> DataFrame:
    """(page_id, status) of source(page_id, content_hash, remote_hash, last_edited_time) against state; live allows the cheap skips.

    Statuses: skipped, hash_unchanged, changed, new, and removed for pages of the state that the source lacks. Blank ids are left out.
    """
    own = source.where(F.trim(F.coalesce("page_id", F.lit(""))) != "").withColumn("_in", F.lit(True))
    known = state.select("page_id", *(F.col(c).alias(f"s_{c}") for c in ("content_hash", "last_edited_time", "hash_written_at")), F.lit(True).alias("_known"))
    both = own.join(known, "page_id", "full_outer")
    status = F.when(F.col("_in").isNull(), "removed").when(F.col("_known").isNull(), "new")
    if live:
        status = status.when(skip_by_hash() | skip_by_time(), "skipped")
    status = status.when(F.col("content_hash") == F.col("s_content_hash"), "hash_unchanged").otherwise("changed")
    return both.withColumn("status", status).drop("_in", "_known")


def counters() -> dict[str, Column]:
    """Aggregates over the rows of diff(): pages seen, and pages of each status."""
    return {"pages_seen": F.count_if(F.col("status") != "removed")} | {f"pages_{s}": F.count_if(F.col("status") == s) for s in COUNTERS}


def summary(changes: DataFrame, mode: str = "incremental") -> DataFrame:
    """One row of counters."""
    return changes.agg(F.lit(mode).alias("sync_mode"), *(c.alias(n) for n, c in counters().items()))


def _row(spark: SparkSession, counts: dict[str, int], mode: str = "incremental") -> DataFrame:
    return spark.range(1).select(F.lit(mode).alias("sync_mode"), *(F.lit(v).cast("bigint").alias(n) for n, v in counts.items()))


def unit_counts(units: DataFrame, page: str = "page_id") -> DataFrame:
    """Units of each page: all, tables, images read by OCR, read by vision, and with vision errors."""
    meta = lambda k: F.coalesce(F.col("meta").getItem(k), F.lit(""))
    return units.groupBy(page).agg(
        F.count("*").alias("units"),
        F.count_if(meta("block_type") == "table").alias("tables"),
        F.count_if((meta("ocr_provider") != "") | (meta("image_ocr_text") != "")).alias("ocr"),
        F.count_if(meta("image_ocr_text") == "yes").alias("vision_ok"),
        F.count_if(meta("ocr_error") != "").alias("vision_errors"),
    )


def next_state(changes: DataFrame, state: DataFrame, indexed: DataFrame, now: str) -> DataFrame:
    """The state after a sync: records of changes(page_id, status, content_hash, last_edited_time, title) with indexed(page_id, indexed_ids).

    Skipped pages keep their record; unchanged ones take the new edit time and keep their ids; removed ones go.
    """
    fresh = changes.where(F.col("status").isin("new", "changed")).join(indexed, "page_id", "left")
    fresh = fresh.select("page_id", "content_hash", "last_edited_time", F.lit(now).alias("hash_written_at"), "title", F.coalesce("indexed_ids", F.array().cast("array<string>")).alias("indexed_ids"))
    same = changes.where(F.col("status") == "hash_unchanged").select("page_id", F.col("last_edited_time").alias("_time"), F.col("title").alias("_title"))
    kept = state.join(changes.where(F.col("status").isin("skipped", "hash_unchanged")).select("page_id"), "page_id", "left_semi").join(same, "page_id", "left")
    kept = kept.select("page_id", "content_hash", F.coalesce("_time", "last_edited_time").alias("last_edited_time"), "hash_written_at", F.coalesce("_title", "title").alias("title"), "indexed_ids")
    return kept.unionByName(fresh).to(SYNC_STATE)


def apply(store: CorpusStore, changes: DataFrame, documents: DataFrame) -> None:
    """Bring the store up to date: rows of changed and removed pages go and documents(id, text, meta, embedding) of new and changed pages come, in one swap."""
    stale = changes.where(F.col("status").isin("changed", "removed", "new")).select("page_id")
    store.replace_pages(stale, documents)


def run(store: CorpusStore, lessons: DataFrame, state: DataFrame, prepare: Callable[[DataFrame], DataFrame], now: str, *, live: bool = True, write_back: Callable[[str, str], None] | None = None) -> Synced:
    """One sync of lessons(page_id, content_hash, remote_hash, last_edited_time, title, ...) against the state of the last one.

    Only new and changed lessons are prepared: prepare(lessons) -> (id, text, meta with page_id, embedding). The store changes in
    one swap; then hashes are written back, on the executors; failures are counted and do not stop the sync. Lessons
    with a blank page_id are left out. live: allow the cheap skips, which trust the remote hash and edit time. Counters are
    gathered while statuses and errors are written.
    """
    lessons = lessons.where(F.trim(F.coalesce("page_id", F.lit(""))) != "")
    changes, counts = observed(diff(lessons.select("page_id", "content_hash", "remote_hash", "last_edited_time", "title"), state, live=live), "changes", **counters())
    due = changes.where(F.col("status").isin("new", "changed")).select("page_id")
    documents = materialize(prepare(lessons.join(due, "page_id", "left_semi")), "documents")
    apply(store, changes, documents)
    indexed = documents.groupBy(F.col("meta").getItem("page_id").alias("page_id")).agg(F.sort_array(F.collect_list("id")).alias("indexed_ids"))
    after = materialize(next_state(changes, state, indexed, now), "state")
    written = write_hashes(outbox(changes), write_back) if write_back else outbox(changes).select("page_id", F.lit(None).cast("string").alias("error")).limit(0)
    written, failures = observed(written, "written", hashes_written=F.count_if(F.col("error") == ""), hash_write_failures=F.count_if(F.col("error") != ""))
    return Synced(changes, documents, after, _row(store.spark, counts | failures), written)


@dataclass
class Synced:
    """What a sync did: status of each page, its new documents, the next state, one row of counters, and each write-back's error."""

    changes: DataFrame
    documents: DataFrame
    state: DataFrame
    summary: DataFrame
    written: DataFrame


def write_hashes(outbox_: DataFrame, write_back: Callable[[str, str], None]) -> DataFrame:
    """(page_id, error) of write_back(page_id, content_hash) for each row; error is "" if it worked."""

    def run_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for page, sha in zip(batch["page_id"], batch["content_hash"], strict=True):
                try:
                    write_back(page, sha)
                    errors.append("")
                except Exception as e:  # noqa: BLE001  counted
                    errors.append(one_line(e))
            yield pd.DataFrame({"page_id": batch["page_id"], "error": errors})

    return outbox_.mapInPandas(run_, "page_id string, error string")


def repair_state(state: DataFrame, store: CorpusStore, *, page: str = "page_id") -> DataFrame:
    """state with indexed_ids as the store holds them; pages of which the store holds nothing lose their hash, so that the next sync takes them anew."""
    held = store.get().groupBy(F.col("meta").getItem(page).alias("page_id")).agg(F.sort_array(F.collect_list("id")).alias("_ids"))
    own = state.join(held, "page_id", "left")
    return own.withColumns({"content_hash": F.when(F.col("_ids").isNotNull(), F.col("content_hash")).otherwise(""), "indexed_ids": F.coalesce("_ids", F.array().cast("array<string>"))}).select(*state.columns)


def outbox(changes: DataFrame) -> DataFrame:
    """Hashes to write back to the source: (page_id, content_hash) of new and changed pages; blank ones are refused."""
    return changes.where(F.col("status").isin("new", "changed") & (F.coalesce("content_hash", F.lit("")) != "")).select("page_id", "content_hash")
