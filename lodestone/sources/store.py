"""The corpus store: a bucketed Parquet table, with a list of the buckets of each version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from ..schema import STORED
from .log import KEEP, VersionLog
from .scratch import materialize


def as_filter(where: Mapping[str, object] | Column | None) -> Column | None:
    """A condition from equalities on columns or metadata keys, or the Column itself."""
    if where is None or isinstance(where, Column):
        return where
    out = None
    for name, value in where.items():
        column = F.col(name) if name in ("id", "source_type") else F.col("meta").getItem(name)
        out = (column == F.lit(value)) if out is None else out & (column == F.lit(value))
    return out


#: Buckets of a new store. A change rewrites the buckets that it touches.
BUCKETS = 64
#: Bits and hashes of a bucket's filter for each value of an attribute: about one bucket in a hundred is opened in vain.
BITS, HASHES = 10, 7


class CorpusStore:
    """Documents with vectors under a path, in buckets by id; any number of writers and readers.

    A mutation writes the buckets that it touches anew, and then commits a version of where each bucket is. So readers see one
    version or another, a failed write leaves the old one, and what a small change costs does not grow with the store. A writer that finds
    others' versions before its own joins them if they touched other buckets, and starts anew if not. Beside the buckets lie Bloom filters of ids,
    source types and metadata values, so that a change or a query by such a value opens only buckets that may hold it. Files go
    through Hadoop's file systems. opened has the buckets that the last change or filtered read opened; None for all.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, keep: int = KEEP):
        self.spark, self.path, self.new_buckets, self.keep = spark, path.rstrip("/"), buckets, keep
        self.log = VersionLog(spark, self.path)
        self.opened: set[int] | None = None

    def _current(self, version: int | None = None) -> dict:
        """{"buckets": their number, "at": {bucket: folder}} of a version, by default the newest."""
        version = self.log.latest() if version is None else version
        return self.log.read(version) if version else {"buckets": self.new_buckets, "at": {}}

    def versions(self) -> list[int]:
        """Versions that can be read."""
        return self.log.versions()

    def _read(self, current: dict, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{folder}" for b, folder in current["at"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(STORED).parquet(*paths) if paths else self.spark.createDataFrame([], STORED)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the newest."""
        return self._read(self._current(version))

    def _write_filters(self, name: str) -> None:
        """Bloom filters of what a folder's buckets hold: the words that have bits, for each bucket and attribute."""
        rows = self.spark.read.parquet(f"{self.path}/{name}").select("bucket", "id", "source_type", "meta")
        pairs = F.concat(F.array(F.struct(F.lit("id").alias("key"), F.col("id").alias("value")), F.struct(F.lit("source_type").alias("key"), F.col("source_type").alias("value"))), F.map_entries(F.coalesce("meta", F.create_map().cast("map<string,string>"))))
        held = rows.select("bucket", F.explode(pairs).alias("p")).select("bucket", "p.key", "p.value").where("value is not null").distinct()
        held = materialize(held, "values")
        # A power of two of words, so that a value is looked up by few sizes.
        sizes = held.groupBy("bucket", "key").agg(F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.count("*") * BITS / 64)))).cast("long").alias("words"))
        bits = held.join(sizes, ["bucket", "key"]).withColumn("bit", F.explode(self._bits(F.col("value"), F.col("words"))))
        words = bits.groupBy("bucket", "key", "words", F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
        words.repartition("key").sortWithinPartitions("key", "words", "word").write.parquet(f"{self.path}/{name}-filters")

    @staticmethod
    def _bits(value: Column, words: Column) -> Column:
        return F.array(*(F.pmod(F.xxhash64(value, F.lit(i)), words * 64) for i in range(HASHES)))

    def _holding(self, current: dict, key: str, values: DataFrame) -> set[int]:
        """The buckets that may hold one of values(value) as that attribute; some may not."""
        live: dict[str, set[int]] = {}
        for b, folder in current["at"].items():
            live.setdefault(folder.partition("/")[0], set()).add(int(b))
        out: set[int] = set()
        filters = None
        for name in live:
            part = self.spark.read.schema("bucket int, key string, words long, word long, bits long").parquet(f"{self.path}/{name}-filters").where(F.col("key") == key).withColumn("name", F.lit(name))
            filters = part if filters is None else filters.unionByName(part)
        if filters is None:
            return out
        filters = materialize(filters, "filters")
        sizes = [r.words for r in filters.select("words").distinct().collect()]  # powers of two
        if not sizes:
            return out
        asked = values.where("value is not null").distinct().withColumn("words", F.explode(F.array(*(F.lit(n).cast("long") for n in sizes))))
        bits = asked.withColumn("bit", F.explode(F.array_distinct(self._bits(F.col("value"), F.col("words"))))).withColumn("word", F.expr("bit div 64"))
        need = bits.groupBy("words", "value").agg(F.count("*").alias("need"))
        hit = filters.join(bits, ["words", "word"]).where("(bits & shiftleft(1L, cast(bit % 64 as int))) != 0").groupBy("name", "bucket", "words", "value").agg(F.count("*").alias("n"))
        for r in hit.join(need, ["words", "value"]).where("n = need").select("name", "bucket").distinct().collect():  # a row for each bucket at most
            if r.bucket in live[r.name]:
                out.add(r.bucket)
        return out

    def _candidates(self, current: dict, where: Mapping[str, object] | Column | None) -> set[int] | None:
        """The buckets that may hold rows that match; None for all."""
        out = None
        if isinstance(where, Mapping):
            for key, value in where.items():
                if isinstance(value, str):
                    own = self._holding(current, key, self.spark.createDataFrame([(value,)], "value string"))
                    out = own if out is None else out & own
        return out

    def _rewrite(self, opened: Callable[[dict], set[int] | None], touched: Callable[[DataFrame, Column], DataFrame], keep: Callable[[DataFrame], DataFrame], fresh: DataFrame | None = None) -> None:
        """Write anew the buckets of touched(rows, bucket of an id): what keep() leaves of their rows, and the fresh rows.

        Rows are those of the buckets opened(version), to find out which are touched.
        """

        def write(base: int, current: dict) -> dict | None:
            bucket = F.pmod(F.xxhash64("id"), F.lit(current["buckets"])).cast("int").alias("bucket")
            self.opened = opened(current)
            numbers = {r.bucket for r in touched(self._read(current, self.opened), bucket).distinct().collect()}  # at most as many as there are buckets
            if not numbers:
                return None
            self.opened = None if self.opened is None else self.opened | numbers
            return self._put(current, numbers, keep(self._read(current, numbers)), fresh, bucket)

        def merge(newer: dict, own: dict) -> dict | None:
            if newer["buckets"] != own["buckets"] or set(newer["touched"]) & set(own["touched"]):
                return None
            at = {b: folder for b, folder in newer["at"].items() if int(b) not in own["touched"]}
            return own | {"at": at | {b: folder for b, folder in own["at"].items() if int(b) in own["touched"]}}

        self.log.change(write, merge, {"buckets": self.new_buckets, "at": {}})
        self.log.vacuum(self._folders, self.keep)

    def _put(self, current: dict, numbers: set[int], table: DataFrame, fresh: DataFrame | None, bucket: Column) -> dict:
        table = table.select(*STORED.names)
        table = table if fresh is None else table.unionByName(fresh.select(*STORED.names))
        name = f"data-{uuid.uuid4().hex}"
        table.select("*", bucket).repartition(len(numbers), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        written = [n for s in self.log.fs.listStatus(self.log._p(f"{self.path}/{name}")) if (n := s.getPath().getName()).startswith("bucket=")]
        if written:
            self._write_filters(name)
        at = {b: folder for b, folder in current["at"].items() if int(b) not in numbers} | {n.partition("=")[2]: f"{name}/{n}" for n in written}
        return {"buckets": current["buckets"], "at": at, "touched": sorted(numbers)}

    @staticmethod
    def _folders(told: dict) -> set[str]:
        return set(told["at"].values()) | {f"{folder.partition('/')[0]}-filters" for folder in told["at"].values()}

    def rebucket(self, buckets: int) -> None:
        """Deal all rows anew to so many buckets, for a store that has grown or shrunk; other writers start anew."""

        def write(base: int, current: dict) -> dict | None:
            bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")
            return None if current["buckets"] == buckets else self._put({"buckets": buckets, "at": {}}, set(range(buckets)), self._read(current), None, bucket)

        self.log.change(write, lambda newer, own: None, {"buckets": self.new_buckets, "at": {}})
        self.log.vacuum(self._folders, self.keep)

    def _checked(self, rows: DataFrame) -> DataFrame:
        """The rows to store, written once: of repeated ids one; a row without a vector is refused."""
        rows = rows.withColumn("source_type", F.coalesce(F.col("meta").getItem("source_type"), F.lit("unknown"))).dropDuplicates(["id"]).select(*STORED.names)
        rows = materialize(rows, "upsert")
        if not rows.where(F.col("embedding").isNull() | (F.size("embedding") < 1)).isEmpty():
            raise StoreError("every document needs a vector")
        return rows

    def upsert(self, rows: DataFrame) -> None:
        """Replace by id, add what is new. Of repeated ids in the batch one wins; a row without a vector is refused."""
        rows = self._checked(rows)
        self._rewrite(lambda now: set(), lambda _, bucket: rows.select(bucket), lambda old: old.join(rows.select("id"), "id", "left_anti"), rows)

    def delete(self, where: Mapping[str, object] | Column | None) -> None:
        """Delete the rows that match; nothing for an empty condition or a blank value."""
        if where is None or (isinstance(where, Mapping) and (not where or any(v in (None, "") for v in where.values()))):
            return
        gone = F.coalesce(as_filter(where), F.lit(False))
        self._rewrite(lambda now: self._candidates(now, where), lambda held, bucket: held.where(gone).select(bucket), lambda old: old.where(~gone))

    def replace_source(self, source_type: str, rows: DataFrame) -> None:
        """One source's rows anew, other sources as they are, in one swap."""
        rows = self._checked(rows).withColumn("source_type", F.lit(source_type))
        own = F.col("source_type") == source_type
        self._rewrite(lambda now: self._candidates(now, {"source_type": source_type}), lambda held, bucket: held.where(own).select(bucket).unionByName(rows.select(bucket)), lambda old: old.where(~own).join(rows.select("id"), "id", "left_anti"), rows)

    def replace_pages(self, pages: DataFrame, rows: DataFrame) -> None:
        """Remove all rows of pages(page_id), and add or replace the rows, in one swap."""
        rows, stale = self._checked(rows), pages.select(F.col("page_id").alias("_page")).distinct()
        of = F.col("meta").getItem("page_id") == F.col("_page")
        self._rewrite(
            lambda now: self._holding(now, "page_id", stale.select(F.col("_page").alias("value"))),
            lambda held, bucket: held.join(stale, of, "left_semi").select(bucket).unionByName(rows.select(bucket)),
            lambda old: old.join(stale, of, "left_anti").join(rows.select("id"), "id", "left_anti"),
            rows,
        )

    def get(self, where: Mapping[str, object] | Column | None = None, limit: int | None = None) -> DataFrame:
        """id, text, meta; only buckets that may hold a value asked for are opened, the filter reaches the scan, and vectors are not read."""
        current = self._current()
        self.opened = self._candidates(current, where)
        own = self._read(current, self.opened).select("id", "text", "meta", "source_type")
        condition = as_filter(where)
        own = own if condition is None else own.where(condition)
        return (own if limit is None else own.limit(limit)).drop("source_type")

    def count(self) -> int:
        return self.read().count()
