"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

Vectors get one more component that makes all of them equally long, so that a larger inner product with an anchor is a smaller
distance to it. Each row lies in the cell of its nearest pivot. An anchor knows from a sample how good its results are at
least, so by the triangle inequality it can tell how far from a cell's pivot those rows lie that may serve it. Anchors of
neighbouring cells form groups; a row is sent to the groups that it may serve, and there joined exactly, in slices of a bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, materialize, small_batches, small_enough
from .int_vectors import even_width, matrix, whole_numbers

#: Vectors of the sample that bounds come from, and how many of them are pivots.
SAMPLE, PIVOTS = 2_048, 64
#: Anchors of a group, and rows of a slice that is joined in one go, on average; rows that are compared with a group at once.
GROUP, SLICE, CHUNK = 1_024, 65_536, 1_024
#: Bounds of groups and cells that are sent to every executor (more go by a shuffled join); rings of a cell that rows are counted by.
BROADCAST_BOUNDS, RINGS = 200_000, 64
#: Results of a chunk that are kept before they are sorted out.
HELD = 1 << 19


@dataclass
class Space:
    """The sample, pivots first, and the common length of vectors."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    pivots: int
    square: int  # of the common length

    def pads(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square - (x * x).sum(1), 0).astype(np.float64))

    def cells(self, x: np.ndarray, padded: bool) -> np.ndarray:
        """Distances of rows to pivots; anchors have no pad."""
        p = self.x[: self.pivots]
        dots = x.astype(np.float64) @ p.astype(np.float64).T
        own = np.full(len(x), float(self.square)) if padded else (x * x).sum(1).astype(np.float64)
        if padded:
            dots = dots + self.pads(x)[:, None] * self.pads(p)[None, :]
        return np.sqrt(np.maximum(own[:, None] + self.square - 2 * dots, 0))

    def distance(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distances from anchors at which rows have a score."""
        return np.sqrt(np.maximum((x * x).sum(1).astype(np.float64)[:, None] + self.square - 2.0 * score, 0))

    @property
    def slack(self) -> float:
        """More than what rounding can do to a distance."""
        return 1e-5 * (1 + float(np.sqrt(self.square)))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 1 << 53 else a @ b.T


def _space(rows: DataFrame, width: int) -> Space:
    """A sample by hashes of vectors, so that a vector of many rows comes once."""
    hashed = rows.withColumn("h", F.xxhash64("x"))
    least = hashed.select("h").groupBy("h").agg(F.count("*").alias("n")).orderBy("h").limit(SAMPLE).select("h")  # at most SAMPLE rows
    got = hashed.join(F.broadcast(materialize(least, "sample")), "h", "left_semi").groupBy("h").agg(F.min(F.struct("id", "label", "x")).alias("r")).orderBy("h").collect()
    square = rows.agg(F.max(F.aggregate("x", F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c))).first()[0] or 0
    x = np.array([g.r.x for g in got], np.int64).reshape(len(got), width)
    # Pivots: each one as far as can be from those before it.
    away, first = np.full(len(got), np.inf), []
    while len(first) < min(PIVOTS, len(got)):
        first.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[first[-1]]).astype(np.float64) ** 2).sum(1))
        away[first] = -1
    order = np.array(first + sorted(set(range(len(got))) - set(first)), np.int64)
    ids, labels = (np.array([g.r[c] for g in got], np.int64) for c in ("id", "label"))
    return Space(ids[order], labels[order], x[order], len(first), square)


def _to_cells(space: Space, width: int, padded: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with cell, that of the nearest pivot, and far, the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = space.cells(matrix(batch.column("x"), width), padded)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | {"cell": pa.array(cell.astype(np.int32)), "far": pa.array(d[np.arange(len(cell)), cell])})

    return run


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.array(v, np.int64) for v in column.to_pylist()]


def _wanted(space: Space, width: int, k: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors whose lists low and high hold the scores wanted: low raised to the k-th best score of the sample, near and away with the distances of results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, lows, highs = matrix(batch.column("x"), width), _lists(batch.column("low")), _lists(batch.column("high"))
            label, ids = batch.column("label").to_numpy(), batch.column("id").to_numpy()
            s = dots(x, space.x)
            fits = (label[:, None] == space.labels[None, :]) == same
            fits &= ids[:, None] != space.ids[None, :]
            near, away = np.zeros(len(x)), np.zeros(len(x))
            for i in range(len(x)):
                for q in range(len(lows[i])):
                    own = s[i, fits[i] & (s[i] >= lows[i][q]) & (s[i] <= highs[i][q])]
                    if len(own) >= k:
                        lows[i][q] = np.partition(own, len(own) - k)[len(own) - k]
                near[i], away[i] = space.distance(x[i : i + 1], np.array([[highs[i].max(), lows[i].min()]]))[0]
            out = {c: batch.column(c) for c in batch.schema.names} | {"low": pa.array([v.tolist() for v in lows], pa.list_(pa.int64())), "near": pa.array(near), "away": pa.array(away)}
            yield pa.RecordBatch.from_pydict(out)

    return run


def _bounds(space: Space, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each group of a task's anchors and each cell, at which distances from the pivot rows may serve one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            d = space.cells(matrix(batch.column("x"), width), False)
            near, away = batch.column("near").to_numpy()[:, None], batch.column("away").to_numpy()[:, None]
            low, high = np.maximum(d - away, near - d) - space.slack, d + away + space.slack
            groups = batch.column("group").to_numpy()
            for g in np.unique(groups).tolist():
                own = groups == g
                lo, hi = found.get(g, (np.inf, -np.inf))
                found[g] = np.minimum(lo, low[own].min(0)), np.maximum(hi, high[own].max(0))
        for g, (lo, hi) in found.items():
            n = len(lo)
            yield pa.RecordBatch.from_pydict({"group": pa.array([g] * n, pa.int32()), "cell": pa.array(range(n), pa.int32()), "from": pa.array(lo), "to": pa.array(hi)})

    return run


def _best(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, rows))
    own = rows[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return order[np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)])) < k]


class _Join:
    """The anchors of a group against rows of one slice, which come in chunks."""

    def __init__(self, anchors: list[dict], width: int, k: int, same: bool):
        self.k, self.same = k, same
        self.uid, self.label, self.id = (np.array([a[c] for a in anchors], np.int64) for c in ("uid", "label", "id"))
        self.x = np.array([a["x"] for a in anchors], np.int64).reshape(len(anchors), width)
        self.n = max(len(a["low"]) for a in anchors)
        # An anchor with fewer scores wanted has empty ranges.
        self.low, self.high = np.ones((len(anchors), self.n), np.int64), np.zeros((len(anchors), self.n), np.int64)
        for i, a in enumerate(anchors):
            self.low[i, : len(a["low"])], self.high[i, : len(a["high"])] = a["low"], a["high"]
        self.found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(self.n)]
        self.held = [0] * self.n

    def add(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        s = dots(self.x, x)
        fits = (self.label[:, None] == labels[None, :]) == self.same
        if self.same:
            fits &= self.id[:, None] != ids[None, :]
        for q in range(self.n):
            r, c = np.nonzero(fits & (s >= self.low[:, q : q + 1]) & (s <= self.high[:, q : q + 1]))
            if len(r):
                self.found[q].append((r, s[r, c], ids[c]))
                self.held[q] += len(r)
                if self.held[q] > HELD // self.n:
                    self._sift(q)

    def _sift(self, q: int) -> None:
        r, s, i = (np.concatenate(v) for v in zip(*self.found[q]))
        keep = _best(r, s, i, self.k)
        r, s, i = r[keep], s[keep], i[keep]
        full = np.flatnonzero(np.bincount(r, minlength=len(self.uid)) >= self.k)
        worst = np.full(len(self.uid), np.iinfo(np.int64).max)
        np.minimum.at(worst, r, s)
        self.low[full, q] = np.maximum(self.low[full, q], worst[full])
        self.found[q], self.held[q] = [(r, s, i)], 0

    def results(self) -> Iterator[pa.RecordBatch]:
        for q in range(self.n):
            if self.found[q]:
                self._sift(q)
                r, s, i = self.found[q][0]
                yield pa.RecordBatch.from_pydict({"uid": pa.array(self.uid[r]), "q": pa.array(np.full(len(r), q, np.int32)), "id": pa.array(i), "score": pa.array(s)})


def _joined(width: int, k: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best rows of each list entry of each anchor, in each slice: batches are in the order of group, slice, anchors first."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, join = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("group", "slice", "kind")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                group, slice_, kind = keys[lo].tolist()
                if (group, slice_) != key:
                    if join:
                        yield from join.results()
                    key, anchors, join = (group, slice_), [], None
                if kind == 0:
                    anchors += part.select(["uid", "id", "label", "x", "low", "high"]).to_pylist()
                elif anchors:
                    join = join or _Join(anchors, width, k, same)
                    for at in range(0, part.num_rows, CHUNK):
                        some = part.slice(at, CHUNK)
                        join.add(some.column("id").to_numpy(), some.column("label").to_numpy(), matrix(some.column("x"), width))
        if join:
            yield from join.results()

    return run


def _grouped(anchors: DataFrame, space: Space) -> DataFrame:
    """anchors with group: cells that follow each other from nearest to nearest share one, and a large cell has several."""
    counts = {r.cell: r["count"] for r in anchors.groupBy("cell").count().collect()}  # a row for each pivot at most
    p = space.x[: space.pivots].astype(np.float64)
    left, at, order = set(counts), min(counts, default=0), []
    while left:
        order.append(at)
        left.discard(at)
        at = min(left, key=lambda c: ((p[c] - p[at]) ** 2).sum(), default=0)
    cells, group, held = [], 0, 0
    for c in order:
        if held and held + counts[c] > GROUP:
            group, held = group + 1, 0
        blocks = -(-counts[c] // GROUP)
        cells.append((c, group, blocks))
        group, held = (group + blocks, 0) if blocks > 1 else (group, held + counts[c])
    told = anchors.sparkSession.createDataFrame(cells, "cell int, base int, blocks int")
    return anchors.join(F.broadcast(told), "cell").withColumn("group", (F.col("base") + F.pmod(F.col("uid"), F.col("blocks"))).cast("int")).drop("base", "blocks")


def replicas(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Each row once for each group that it may serve."""
    bounds = F.broadcast(bounds) if small_enough(bounds, BROADCAST_BOUNDS) else bounds
    return cells.join(bounds, "cell").where((F.col("far") >= F.col("from")) & (F.col("far") <= F.col("to")))


def _serve(cells: DataFrame, anchors: DataFrame, space: Space, width: int, k: int, same: bool) -> DataFrame:
    """(uid, q, id, score, place) of the k best rows for each entry of the anchors' lists low and high."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema)
    anchors = _grouped(anchors.mapInArrow(_wanted(space, width, k, same), kept + ", near double, away double"), space)
    anchors = materialize(anchors, "anchors")
    bounds = anchors.select("group", "x", "near", "away").mapInArrow(_bounds(space, width), "group int, cell int, `from` double, `to` double")
    bounds = bounds.groupBy("group", "cell").agg(F.min("from").alias("from"), F.max("to").alias("to")).where(F.col("from") <= F.col("to"))
    # How many rows a group gets at most, by rings around the pivots.
    ring = 2 * float(np.sqrt(space.square)) / RINGS or 1.0
    rings = cells.groupBy("cell", F.floor(F.col("far") / ring).alias("ring")).agg(F.count("*").alias("n"))  # PIVOTS times RINGS rows at most
    bounds = materialize(bounds, "bounds")
    # Where rows lie at the same distance, at the end of the last ring, the ring is that of the one before.
    sizes = bounds.join(F.broadcast(rings), "cell").where((F.col("ring") >= F.floor(F.col("from") / ring)) & (F.col("ring") <= F.floor(F.col("to") / ring))).groupBy("group").agg(F.ceil(F.sum("n") / SLICE).cast("int").alias("slices"))
    sizes = materialize(sizes, "slices")
    bounds = materialize(bounds.join(sizes, "group"), "bounds")
    sent = replicas(cells, bounds).select("group", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("uid"), "id", "label", "x", *(F.lit(None).cast("array<long>").alias(c) for c in ("low", "high")))
    asked = anchors.join(sizes, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"), "uid", "id", "label", "x", "low", "high")
    both = sent.unionByName(asked).repartition("group", "slice").sortWithinPartitions("group", "slice", "kind", "id")
    found = both.mapInArrow(_joined(width, k, same), "uid long, q int, id long, score long")
    best = Window.partitionBy("uid", "q").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def mine(rows: DataFrame, anchor: Column, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that anchor is true of.

    A score is the inner product of whole-number vectors; higher ones come first, then smaller keys. The positives of an anchor are
    its first rows of the same label, the negatives of a positive the first rows of other labels whose score lies within
    low and high hundredths of the positive's. Rows with a null key or label, a null vector or null or non-finite components take no
    part. Shorter vectors are filled up with zeros; components beyond the limit of int_vectors count as that limit. Rows of an anchor's own key are
    no positives of it; repeated rows are candidates each, and one anchor. Labels are whole numbers, or else compared by 64-bit hashes.
    """
    spark = rows.sparkSession
    small_batches(spark)
    whole = rows.schema[label].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    name = F.col(label).cast("long") if whole else F.xxhash64(label)
    own = whole_numbers(rows.where(F.col(key).isNotNull() & F.col(label).isNotNull()), vector).select(F.col(key).cast("long").alias("id"), name.alias("label"), "x", F.coalesce(anchor, F.lit(False)).alias("asks"))
    own, width = even_width(own)
    space = _space(own, width)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not len(space.ids):
        return spark.createDataFrame([], out)
    place = "id long, label long, x array<int>, cell int, far double"
    cells = materialize(own.select("id", "label", "x").mapInArrow(_to_cells(space, width, True), place), "cells")
    asks = own.where("asks").select("id", "label", "x").dropDuplicates().mapInArrow(_to_cells(space, width, False), place).withColumn("uid", F.xxhash64("id", "label", "x"))
    # Scores lie within the square of the common length, either way.
    limits = lambda *v: F.array(*(F.lit(x).cast("long") for x in v))
    asks = materialize(asks.select("uid", "id", "label", "x", "cell").withColumn("low", limits(-space.square)).withColumn("high", limits(space.square)), "asked")
    found = _serve(cells, asks, space, width, positives, True)
    good = found.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("place", "score", "id"))).alias("good"))
    with_good = materialize(asks.drop("low", "high").join(good, "uid"), "positives")
    # Scores are whole, so are their limits: the least and the most that 100 times stay within.
    floor = lambda by: F.expr(f"({by} * g.score - pmod({by} * g.score, 100)) div 100")
    each = with_good.select("uid", "id", "label", "x", "cell", F.explode("good").alias("g")).withColumn("low_", -floor(-low)).withColumn("high_", floor(high)).where("low_ <= high_")
    lists = each.groupBy("uid", "id", "label", "x", "cell").agg(F.array_sort(F.collect_list(F.struct("g.place", "g.score", "g.id", "low_", "high_"))).alias("good"))
    lists = materialize(lists, "positives")
    asked = lists.select("uid", "id", "label", "x", "cell", F.transform("good", lambda g: g["low_"]).alias("low"), F.transform("good", lambda g: g["high_"]).alias("high"))
    bad = _serve(cells, asked, space, width, negatives, False)
    named = lists.select("uid", F.col("id").alias("anchor_id"), F.posexplode("good").alias("q", "g")).select("uid", "q", "anchor_id", F.col("g.id").alias("positive_id"), F.col("g.score").alias("positive_score"))
    return bad.join(named, ["uid", "q"]).select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
