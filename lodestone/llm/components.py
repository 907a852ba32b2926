"""Connected components of an edge table, by large-star and small-star steps on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize


class Forest:
    """Union-find over 0 ... n - 1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


#: Edges that a task joins in memory at once.
AT_ONCE = 1 << 20


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield tuple(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))


def contract(edges: DataFrame) -> DataFrame:
    """Replace the edges of each task by stars around the smallest nodes: the same components with at most as many edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _gathered(batches):
            node, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            forest = Forest(len(node))
            for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist(), strict=True):
                forest.join(x, y)
            root = np.array([forest.root(x) for x in range(len(node))], np.int64)
            live = root != np.arange(len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[live]), pa.array(node[root[live]])], ["a", "b"])

    return edges.select("a", "b").mapInArrow(lean(run), "a bigint, b bigint")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    if large:
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    linked = both.join(least, "a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(linked.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b): component is the smallest node that it reaches.

    Each round is written to the shared folder. Nodes on no edge are not returned; loops and repeated edges do no harm.
    """
    # The larger node of an edge points to the smaller one.
    now = materialize(contract(edges.where("a <> b")).distinct(), "edges")
    mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    while mark.n:
        now = materialize(contract(_star(_star(now, True), False)).distinct(), "edges")
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
