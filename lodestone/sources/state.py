"""The state of the last sync, kept between runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SYNC_STATE
from .scratch import materialize


class StateStore:
    """SYNC_STATE rows under a path; one writer at a time.

    A write goes to a folder of its own, which an empty file with a higher number then names; the highest number counts. So a failed
    write leaves the old state, and a path without any is an empty state.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._p(self.path))

    def _names(self) -> list[str]:
        return sorted(n for s in self._fs.listStatus(self._p(self.path)) if (n := s.getPath().getName()).startswith("CURRENT-"))

    def read(self) -> DataFrame:
        names = self._names()
        if not names:
            return self.spark.createDataFrame([], SYNC_STATE)
        return self.spark.read.schema(SYNC_STATE).parquet(f"{self.path}/{names[-1].partition('-v-')[2]}")

    def write(self, state: DataFrame) -> None:
        """Replace the whole state. Rows with a blank page_id are left out; of repeated ids one stays."""
        name, old = f"state-{uuid.uuid4().hex}", self._names()
        state.where(F.trim(F.coalesce("page_id", F.lit(""))) != "").dropDuplicates(["page_id"]).to(SYNC_STATE).write.parquet(f"{self.path}/{name}")
        self._fs.create(self._p(f"{self.path}/CURRENT-{int(old[-1][8:20]) + 1 if old else 0:012d}-v-{name}")).close()
        for o in old[:-1]:  # readers of the last state may still run
            self._fs.delete(self._p(f"{self.path}/{o.partition('-v-')[2]}"), True)
            self._fs.delete(self._p(f"{self.path}/{o}"), False)

    def upsert(self, rows: DataFrame) -> None:
        """Replace the records of the rows' pages, add those of new ones."""
        rows = materialize(rows.to(SYNC_STATE), "records")
        self.write(self.read().join(rows.select("page_id"), "page_id", "left_anti").unionByName(rows))

    def remove(self, pages: DataFrame) -> None:
        """Drop the records of pages(page_id)."""
        self.write(self.read().join(pages.select("page_id"), "page_id", "left_anti"))

    def clear(self) -> None:
        self.write(self.spark.createDataFrame([], SYNC_STATE))
