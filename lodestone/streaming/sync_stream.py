"""The sync as a stream: what is known of a page is keyed state, and a timer removes pages that come no more."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import parse_iso
from ..schema import _table
from ..sources.scratch import materialize
from ..sources.store import CorpusStore

#: What is known of a page: times of the hash (microseconds) and of the last sight (milliseconds) beside the fields of a sync's state.
KNOWN = _table("content_hash string, last_edited_time string, written bigint, title string, seen bigint")
STATUS = "page_id string, status string, content_hash string, last_edited_time string, title string, text string, seen bigint, latest boolean"
_Out = Row(*(c.split()[0] for c in STATUS.split(", ")))
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class PageSync(StatefulProcessor):
    """The statuses of `sync.diff` for one page, sight by sight, and `removed` once it was not seen for `patience` ms of event time.

    A page has one timer: when it goes off although the page was seen since, it is set anew.
    """

    def __init__(self, patience: int, live: bool):
        self.patience, self.live = patience, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.known = handle, handle.getValueState("known", KNOWN)

    def _status(self, r: Row, known: tuple | None) -> str:
        if known is None:
            return "new"
        sha, edited, written = known[:3]
        if self.live:
            by_hash = bool(r.remote_hash) and r.remote_hash == sha and None not in (r.edited, written) and r.edited <= written
            if by_hash or (sha and r.last_edited_time and r.last_edited_time == edited):
                return "skipped"
        return "hash_unchanged" if sha is not None and r.content_hash == sha else "changed"

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:
        self.known.update(tuple(initialState[c] for c in KNOWN.names))
        self.handle.registerTimer(initialState.seen + self.patience)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        known, out, taken = self.known.get(), [], -1
        first = known is None
        for r in sorted(rows, key=lambda r: (r.seen, r.last_edited_time or "", r.content_hash or "")):
            status, seen = self._status(r, known), max(r.seen, known[4] if known else r.seen)
            if status in ("new", "changed"):
                taken, known = len(out), (r.content_hash, r.last_edited_time, r.seen * 1000, r.title, seen)
            elif status == "hash_unchanged":
                known = (known[0], r.last_edited_time, known[2], r.title, seen)
            else:
                known = (*known[:4], seen)
            out.append((key[0], status, r.content_hash, r.last_edited_time, r.title, r.text if status in ("new", "changed") else None, r.seen))
        self.known.update(known)
        if first:
            self.handle.registerTimer(known[4] + self.patience)
        return iter([_Out(*o, n == taken) for n, o in enumerate(out)])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        known = self.known.get()
        if known is None:
            return iter(())
        if known[4] + self.patience > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(known[4] + self.patience)
            return iter(())
        self.known.clear()
        return iter([_Out(key[0], "removed", known[0], known[1], known[3], None, known[4], True)])


def statuses(pages: DataFrame, known: DataFrame | None = None, known_at: str = "1970-01-01T00:00:00Z", *, patience: timedelta, late: str = "1 second", live: bool = True) -> DataFrame:
    """The status of each sight of a page in a stream of pages(page_id, content_hash, remote_hash, last_edited_time, title, text, seen_at).

    known: the state of a sync at known_at, to begin with. Returns page_id, status, content_hash, last_edited_time, title, text (of new and
    changed pages), seen (milliseconds) and latest: whether a row has the last content of its page in this batch, or removes it. A page not
    seen for `patience` of event time is removed, so snapshots have to come less than that apart, or else (removal by the next
    snapshot) each in one batch and at least patience + late apart. Sights more than `late` behind are dropped. Rows of one page in a batch
    are taken in order of their time; blank ids are left out. State is as large as the pages, by hash of page_id, on disk.
    """
    micros = lambda c: F.unix_micros(parse_iso(F.col(c)))
    own = pages.where(F.trim(F.coalesce("page_id", F.lit(""))) != "").withWatermark("seen_at", late)
    own = own.select("page_id", "content_hash", "remote_hash", "last_edited_time", micros("last_edited_time").alias("edited"), "title", "text", "seen_at", F.unix_millis("seen_at").alias("seen"))
    if known is not None:
        at = F.unix_millis(parse_iso(F.lit(known_at)))
        known = known.select("page_id", "content_hash", "last_edited_time", micros("hash_written_at").alias("written"), "title", at.alias("seen")).groupBy("page_id")
    steps = PageSync(patience // timedelta(milliseconds=1), live)
    return own.groupBy("page_id").transformWithState(statefulProcessor=steps, outputStructType=STATUS, outputMode="Append", timeMode="EventTime", initialState=known)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, as timers and keyed state need; the session's own setting comes back after."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old) if old else spark.conf.unset(_PROVIDER)


def follow(found: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give each batch of statuses to sink(batch, number) for all that is there now; goes on where it stopped."""
    with keyed_state(found.sparkSession):
        return found.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into(store: CorpusStore, prepare: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink that replaces new and changed pages by prepare(rows) -> (id, text, meta with page_id, embedding), and drops removed ones.

    A batch that comes again after a failure replaces the same pages by the same documents.
    """

    def sink(batch: DataFrame, number: int) -> None:
        due = materialize(batch.where("latest"), "statuses")
        if not due.isEmpty():
            store.replace_pages(due.select("page_id"), prepare(due.where("status <> 'removed'")))

    return sink
