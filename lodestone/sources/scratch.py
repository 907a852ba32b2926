"""Intermediate tables in the folder that the driver and all executors share, and tables of few partitions."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Where it is unset (tests, a single machine), a temporary folder is set for the session and used.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have gone first
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, dict[str, int]]:
    """materialize(), and aggregates over the rows written, which the writing tasks gather: there is no further scan. A task that is run again counts once."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = materialize(df.observe(seen, *(c.alias(n) for n, c in counters.items())), name)
    return out, seen.get


def spread(table: DataFrame) -> DataFrame:
    """A table as read from files, over all cores if its rows lie in fewer partitions than there are cores; else as it is.

    A small file is one partition, and costly columns would keep one core busy. No column is read to find out.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.select(F.spark_partition_id().alias("p")).distinct().count() < cores else table


def small_enough(table: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows: the check before a broadcast."""
    return table.limit(rows + 1).count() <= rows
