"""Evaluations that take long: rate-bounded batches that resume where they stopped, with records kept by key."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import one_line
from ..sources.log import VersionLog
from ..sources.scratch import materialize
from .evaluate import Judge, score
from .providers import Generator, with_retries

KEY = ["pipeline_name", "sample_id"]
RECORDS = (
    "pipeline_name string, sample_id string, question string, ground_truth string, answer string, error string, attempt_count bigint, generation_skipped boolean, "
    "contexts array<string>, source_ids array<string>, metrics map<string,double>, ragas_error string"
)
#: retrieve(rows with KEY and question) -> KEY, contexts, source_ids; rows that it leaves out have no sources.
Retrieve = Callable[[DataFrame], DataFrame]


class SlowRun:
    """A run under a path, for pipelines times samples; whoever opens the path goes on with it.

    The work is written once, in files of `batch` pairs, which a stream takes one at a time; `at_once` tasks call the services, each
    waiting `delay` seconds between calls, so calls come at a bounded rate. A batch's records are written to a folder of its
    number and committed to a log, so a batch that comes again after a failure changes nothing. Later passes (backfill, retry)
    commit folders that replace records by key; the last one counts.
    """

    def __init__(self, spark: SparkSession, path: str, *, batch: int = 64, at_once: int = 1, delay: float = 0.0, attempts: int = 0, secrets: tuple[str, ...] = ()):
        self.spark, self.path = spark, path.rstrip("/")
        self.batch, self.at_once, self.delay, self.attempts, self.secrets = batch, at_once, delay, attempts, secrets
        self.log = VersionLog(spark, self.path)

    def plan(self, samples: DataFrame, pipelines: list[str]) -> None:
        """Write the work, unless it is there: samples(sample_id, question, ground_truth) for each pipeline. Rows without an id are left out, repeated ids count once."""
        if "work" in self._parts("plan"):
            return
        own = samples.where("sample_id is not null").select(F.col("sample_id").cast("string").alias("sample_id"), "question", "ground_truth").dropDuplicates(["sample_id"])
        work = own.withColumn("pipeline_name", F.explode(F.array(*map(F.lit, pipelines)))).select(*KEY, "question", "ground_truth")
        work.repartitionByRange(max(1, self.at_once), *KEY).sortWithinPartitions(*KEY).write.mode("overwrite").option("maxRecordsPerFile", self.batch).parquet(f"{self.path}/work")
        self._commit("plan", "work")

    def _parts(self, kind: str) -> list[str]:
        version = self.log.latest()
        return self.log.read(version).get(kind, []) if version else []

    def _commit(self, kind: str, folder: str) -> None:
        def write(base: int, content: dict) -> dict | None:
            have = content.get(kind, [])
            return None if folder in have else content | {kind: [*have, folder]}

        self.log.change(write, lambda newer, own: None, {})

    def records(self) -> DataFrame:
        """RECORDS by key: of each the one committed last."""
        parts = self._parts("records")
        if not parts:
            return self.spark.createDataFrame([], RECORDS)
        if len(parts) == 1 or all(p.startswith("batch-") for p in parts):
            return self.spark.read.schema(RECORDS).parquet(*(f"{self.path}/records/{p}" for p in parts))
        place = F.create_map(*(F.lit(x) for kv in enumerate(parts) for x in kv[::-1]))
        own = self.spark.read.schema(RECORDS).parquet(*(f"{self.path}/records/{p}" for p in parts))
        own = own.withColumn("_n", place[F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)])
        rest = [c.split()[0] for c in RECORDS.split(", ")][2:]
        return own.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "_n").alias("r")).select(*KEY, *(f"r.{c}" for c in rest))

    def _write(self, rows: DataFrame, folder: str) -> None:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.path}/records/{folder}")
        self._commit("records", folder)

    def run(self, retrieve: Retrieve, generate: Generator | None, judge: Judge | None = None) -> None:
        """Take all batches that no record tells of yet, in order, and end. Without a generator, answers are skipped.

        A question whose generator fails keeps the error and what was retrieved. If retrieval itself fails for a batch, its
        records have that error and no sources, until backfill().
        """
        work = self.spark.readStream.schema("pipeline_name string, sample_id string, question string, ground_truth string")
        stream = work.option("maxFilesPerTrigger", 1).parquet(f"{self.path}/work").writeStream.trigger(availableNow=True)

        def step(batch: DataFrame, n: int) -> None:
            folder = f"batch-{n:09d}"
            if folder not in self._parts("records"):
                self._write(self._answered(batch, retrieve, generate, judge), folder)

        stream.foreachBatch(step).option("checkpointLocation", f"{self.path}/progress").start().awaitTermination()

    def _found(self, rows: DataFrame, retrieve: Retrieve) -> tuple[DataFrame, str]:
        """rows with contexts and source_ids, and why retrieval failed; then they are empty."""
        none = F.array().cast("array<string>")
        bare = rows.drop("contexts", "source_ids")
        try:
            got = materialize(retrieve(bare.select(*KEY, "question")).select(*KEY, "contexts", F.col("source_ids").cast("array<string>")), "retrieved")
        except Exception as e:  # noqa: BLE001  told in the records
            return bare.withColumns({"contexts": none, "source_ids": none}), f"retrieval: {one_line(e, self.secrets, 200)}"
        return bare.join(got, KEY, "left").withColumns({"contexts": F.coalesce("contexts", none), "source_ids": F.coalesce("source_ids", none)}), ""

    def _answered(self, batch: DataFrame, retrieve: Retrieve, generate: Generator | None, judge: Judge | None) -> DataFrame:
        rows, failed = self._found(batch.select(*KEY, "question", "ground_truth"), retrieve)
        call, delay = with_retries(generate, self.attempts, self.delay, self.secrets) if generate else None, self.delay

        @F.pandas_udf("answer string, error string, attempt_count long")
        def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            first = True
            for questions, contexts in batches:
                out = []
                for q, held in zip(questions, contexts, strict=True):
                    if failed or call is None:
                        out.append(("", failed, 0))
                        continue
                    if not first:
                        time.sleep(delay)
                    first = False
                    out.append(call("\n\n".join([*held, f"Question: {q}"])))
                yield pd.DataFrame(out, columns=["answer", "error", "attempt_count"])

        # Calls are made once, by few tasks: what they gave is written before it is judged.
        rows = rows.repartition(self.at_once, *KEY).withColumn("_a", ask("question", "contexts"))
        rows = rows.select(*KEY, "question", "ground_truth", "_a.answer", "_a.error", "_a.attempt_count", F.lit(generate is None).alias("generation_skipped"), "contexts", "source_ids")
        return score(materialize(rows, "answered"), judge, delay=self.delay, attempts=self.attempts, secrets=self.secrets)

    def backfill(self, retrieve: Retrieve) -> int:
        """Retrieve for failed records without sources; their error stays. How many have sources now."""
        bare = self.records().where("error <> '' AND size(source_ids) = 0").drop("contexts", "source_ids")
        rows, failed = self._found(bare, retrieve)
        return 0 if failed else self._pass(rows.where("size(source_ids) > 0"), "backfill")

    def retry(self, retrieve: Retrieve, generate: Generator | None, judge: Judge | None = None) -> int:
        """Answer and judge failed records anew; how many that were."""
        bare = self.records().where("error <> ''").select(*KEY, "question", "ground_truth")
        return 0 if bare.isEmpty() else self._pass(self._answered(bare, retrieve, generate, judge), "retry")

    def _pass(self, rows: DataFrame, name: str) -> int:
        rows = materialize(rows, name)
        n = rows.count()
        if n:
            self._write(rows, f"{name}-{self.log.latest():09d}")
        return n
