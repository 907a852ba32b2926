"""Vectors by content: a text is given to the embedding provider once, however often and wherever it comes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import KEEP, VersionLog


class EmbeddingCache:
    """(sha, embedding) rows of one model under a path: SHA-256 of a text and its vector; any number of writers.

    Each fill writes a folder of vectors that the cache lacks and commits it to a log of versions. Of two writers at once the later
    one adds only what the other has not, so no text has two rows. A failed fill leaves nothing.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, keep: int = KEEP):
        self.spark, self.path, self.keep = spark, f"{path.rstrip('/')}/{hashlib.sha256(model.encode()).hexdigest()[:16]}", keep
        self.log = VersionLog(spark, self.path)

    def _rows(self, parts: list[str]) -> DataFrame:
        schema = "sha string, embedding array<float>"
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], schema)

    def _parts(self) -> list[str]:
        version = self.log.latest()
        return self.log.read(version)["parts"] if version else []

    def read(self) -> DataFrame:
        return self._rows(self._parts())

    @staticmethod
    def key(text: str = "text") -> Column:
        return F.sha2(F.col(text), 256)

    def fill(self, texts: DataFrame, embed: Callable[[DataFrame], DataFrame], *, text: str = "text") -> None:
        """Add the vectors that texts lack: embed(rows with `text`) -> rows with `embedding`. Blank texts are left out.

        The provider gets each distinct text once, unless a task is run again or another writer asks at the same time.
        """
        made: list[str] = []

        def write(base: int, content: dict) -> dict | None:
            have, folder = self._rows(content["parts"]).select("sha"), f"part-{uuid.uuid4().hex}"
            if made:  # another writer was first: its vectors stay
                fresh = self._rows(made[:1])
            else:
                fresh = texts.where(F.trim(F.coalesce(text, F.lit(""))) != "").select(self.key(text).alias("sha"), F.col(text).alias("text"))
            fresh = fresh.join(have, "sha", "left_anti")
            if not made:
                fresh = embed(fresh.dropDuplicates(["sha"]))
            fresh.select("sha", "embedding").write.parquet(f"{self.path}/{folder}")
            made.append(folder)
            return {"parts": [*content["parts"], folder]} if not self._rows([folder]).isEmpty() else None

        self._commit(write)

    def compact(self, files: int = 1) -> None:
        """Write all vectors into one folder of so many files."""

        def write(base: int, content: dict) -> dict | None:
            if len(content["parts"]) < 2:
                return None
            folder = f"part-{uuid.uuid4().hex}"
            self._rows(content["parts"]).repartition(files, "sha").write.parquet(f"{self.path}/{folder}")
            return {"parts": [folder]}

        self._commit(write)

    def _commit(self, write: Callable[[int, dict], dict | None]) -> None:
        self.log.change(write, lambda newer, own: None, {"parts": []})
        self.log.vacuum(lambda content: set(content["parts"]), self.keep)

    def embed(self, rows: DataFrame, embed: Callable[[DataFrame], DataFrame], *, text: str = "text", into: str = "embedding") -> DataFrame:
        """rows with the vectors of their texts, of which the cache is filled with those it lacks. Rows with blank texts are dropped."""
        self.fill(rows, embed, text=text)
        have = self.read().select(F.col("sha").alias("_sha"), F.col("embedding").alias(into))
        return rows.drop(into).withColumn("_sha", self.key(text)).join(have, "_sha").drop("_sha")
