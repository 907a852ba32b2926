"""A vector index that outlives a query: inverted lists of a coarse quantizer, with product codes.

Rows lie in partitions by list. A search reads the short codes of those lists that its queries probe, and the vectors of the best
rows by code alone, which it ranks exactly. New and changed rows are appended, gone ones marked, until compact() writes their lists anew.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.text import distance_to_score
from ..sources.log import VersionLog
from ..sources.scratch import materialize, small_enough
from .vectors import BLOCK, CELLS, squared_distance

#: Rows that the quantizers are fitted on, at most (all rows are indexed); passes of the fit; entries of a code; rows of the sample that are
#: tried as queries, and the share of their ten nearest in the sample that the lists probed by default hold.
SAMPLE, PASSES, ENTRIES, TRIED, RECALL = 20_000, 12, 256, 200, 0.95
#: Rows of a file of a list, and marks of gone rows that are sent to every executor.
FILE_ROWS, BROADCAST_GONE = 250_000, 500_000
#: Codes that a task of a search reads, about, once there are more than its cores read with less.
TASK_ROWS = 1 << 20


def _centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of a bounded sample by Lloyd's passes."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(PASSES):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)


class Quantizer:
    """Centres of the lists, and of the parts of what is left of a vector when its centre is taken off."""

    def __init__(self, lists: np.ndarray, books: np.ndarray, probes: int):
        self.lists, self.books, self.probes = lists, books, probes
        self.parts, self.size = books.shape[0], books.shape[2]

    @staticmethod
    def fit(x: np.ndarray, lists: int, parts: int, seed: int = 7) -> Quantizer:
        rng = np.random.default_rng(seed)
        centres = _centres(x, lists, rng)
        left = x - centres[_nearest(x, centres)]
        size = -(-x.shape[1] // parts)
        left = np.pad(left, ((0, 0), (0, parts * size - x.shape[1]))).reshape(len(x), parts, size)
        books = [_centres(left[:, p], ENTRIES, rng) for p in range(parts)]
        tried = x[:TRIED]
        d = (x * x).sum(1)[None, :] - 2 * tried @ x.T
        d[np.arange(len(tried)), np.arange(len(tried))] = np.inf
        near = np.argsort(d, axis=1)[:, : min(10, len(x))]
        place = np.argsort(np.argsort((centres * centres).sum(1)[None, :] - 2 * tried @ centres.T, axis=1), axis=1)
        places = np.sort(np.take_along_axis(place, _nearest(x, centres)[near], 1).reshape(-1))
        return Quantizer(centres, np.stack(books), int(places[int(RECALL * (len(places) - 1))]) + 1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _nearest(x, self.lists)
        left = np.pad(x - self.lists[own], ((0, 0), (0, self.parts * self.size - x.shape[1]))).reshape(len(x), self.parts, self.size)
        return own, np.stack([_nearest(left[:, p], self.books[p]) for p in range(self.parts)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray, at: int) -> np.ndarray:
        """Squared distances of queries' parts to all entries, in list `at`: (query, part, entry)."""
        left = np.pad(q - self.lists[at], ((0, 0), (0, self.parts * self.size - q.shape[1]))).reshape(len(q), self.parts, 1, self.size)
        return ((left - self.books[None]) ** 2).sum(3)

    def dumps(self) -> dict:
        return {"lists": self.lists.tolist(), "books": self.books.tolist(), "probes": self.probes}


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _encoded(model: Quantizer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, code = model.encode(_matrix(batch.column("vector")))
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "vector": batch.column("vector"), "code": pa.array([c.tobytes() for c in code], pa.binary()), "list": pa.array(own.astype(np.int32))})

    return run


def _by_code(model: Quantizer, asked: np.ndarray, ids: list, kind: pa.DataType, probed: dict[int, np.ndarray], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's best rows by code for each query, at most `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        worst, held, n = np.full(len(asked), np.inf), [], 0

        def sift() -> list[tuple]:
            """What is left of all that is held: most rows of each query; worst is the last of them."""
            q, rough, lists = (np.concatenate(v) for v in list(zip(*held))[:3])
            order = np.lexsort((rough, q))
            own = q[order]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            place = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
            keep, last = order[place < most], order[place == most - 1]
            worst[q[last]] = rough[last]
            return [(q[keep], rough[keep], lists[keep], pa.concat_arrays([h[3] for h in held]).take(pa.array(keep)))]

        for batch in batches:
            at, codes = batch.column("list").to_numpy(), np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, model.parts)
            for l in np.unique(at).tolist():
                own, queries = np.flatnonzero(at == l), probed[l]
                if l not in tables:
                    tables.clear()  # rows come list by list
                    tables[l] = model.tables(asked[queries], l)
                for lo in range(0, len(own), max(1, CELLS // len(queries))):
                    part = own[lo : lo + max(1, CELLS // len(queries))]
                    rough = np.zeros((len(queries), len(part)))
                    for p in range(model.parts):
                        rough += tables[l][:, p, codes[part, p]]
                    q, r = np.nonzero(rough <= worst[queries][:, None])
                    held.append((queries[q], rough[q, r], np.full(len(q), l, np.int32), batch.column("id").take(pa.array(part[r]))))
                    n += len(q)
                    if n > CELLS:
                        held, n = sift(), 0
        if held:
            (q, rough, lists, found), *_ = sift()
            for lo in range(0, len(q), 100_000):
                some = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array([ids[i] for i in q[some].tolist()], kind), "id": found.slice(lo, 100_000), "list": pa.array(lists[some]), "rough": pa.array(rough[some])})

    return run


class VectorIndex:
    """The index under a path. Ids are of one type; of repeated ids in a batch one wins; null or odd-sized vectors are not indexed.

    seen tells of the last search: rows in the index, and for a query on average, rows compared by code and rows compared by vector.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log, self.path = spark, VersionLog(spark, path), path.rstrip("/")
        self.seen: dict[str, int] = {}
        self._model: tuple[str, Quantizer] | None = None

    def _rows(self, rows: DataFrame, key: str, vector: str, size: int | None) -> DataFrame:
        fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
        rows = rows.where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("vector"))
        return rows if size is None else rows.where(F.size("vector") == size)

    def _quantizer(self, name: str) -> Quantizer:
        if self._model is None or self._model[0] != name:
            told = json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first().value)
            self._model = name, Quantizer(np.array(told["lists"]), np.array(told["books"]), told["probes"])
        return self._model[1]

    def build(self, rows: DataFrame, *, key: str = "id", vector: str = "embedding", lists: int | None = None, parts: int = 16) -> None:
        """Fit the quantizers and index all rows; what was there before goes. lists: by default the root of their number, at most 4,096."""
        rows = self._rows(rows, key, vector, None)
        first = rows.select(F.size("vector")).first()
        size = first[0] if first else 1
        rows = rows.where(F.size("vector") == size)
        n = rows.count()
        sample = rows.select(F.xxhash64("id").alias("h"), "vector").orderBy("h").limit(SAMPLE).toArrow() if n else None
        x = _matrix(sample["vector"].combine_chunks()) if n else np.zeros((1, size))
        model = Quantizer.fit(x, lists or max(1, min(4096, round(n**0.5))), min(parts, size))
        name = f"model-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(model.dumps()),)], "value string").coalesce(1).write.text(f"{self.path}/{name}")
        self._model = name, model
        self.log.change(lambda base, old: {"model": name, "size": size, "next": 1, "adds": [self._added(rows, 0)], "gone": []}, lambda newer, own: None, {})

    def _added(self, rows: DataFrame, number: int) -> dict:
        """Write rows list by list; a large list in several files."""
        name, model = f"add-{uuid.uuid4().hex}", self._model[1]
        kind = rows.schema["id"].dataType.simpleString()
        coded = materialize(rows.dropDuplicates(["id"]).mapInArrow(_encoded(model), f"id {kind}, vector array<float>, code binary, list int"), "coded")
        counts = {r.list: r["count"] for r in coded.groupBy("list").count().collect()}  # a row for each list
        files = self.spark.createDataFrame([(l, -(-c // FILE_ROWS)) for l, c in counts.items()], "list int, files int")
        dealt = coded.join(F.broadcast(files), "list").withColumn("file", F.pmod(F.xxhash64("id"), F.col("files")))
        dealt.repartition(max(1, min(len(counts), 2 * self.spark.sparkContext.defaultParallelism)), "list", "file").drop("file", "files").sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{self.path}/{name}")
        return {"name": name, "number": number, "lists": counts}

    def upsert(self, rows: DataFrame, *, key: str = "id", vector: str = "embedding") -> None:
        """Add rows, or replace those of the same ids."""
        self._append(rows, key, vector)

    def delete(self, ids: DataFrame, *, key: str = "id") -> None:
        """Take out the rows of these ids."""
        self._append(ids, key, None)

    def _append(self, rows: DataFrame, key: str, vector: str | None) -> None:
        def write(base: int, old: dict) -> dict:
            self._quantizer(old["model"])
            own = self._rows(rows, key, vector, old["size"]) if vector else None
            gone = f"gone-{uuid.uuid4().hex}"
            rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct().write.parquet(f"{self.path}/{gone}")
            return old | {"next": old["next"] + 1, "adds": old["adds"] + ([self._added(own, old["next"])] if vector else []), "gone": [*old["gone"], {"name": gone, "number": old["next"]}]}

        # The order of two changes counts, so the later one is written anew.
        self.log.change(write, lambda newer, own: None, {})
        self.log.vacuum(self._folders)

    @staticmethod
    def _folders(told: dict) -> set[str]:
        return {told["model"], *(a["name"] for a in told["adds"]), *(g["name"] for g in told["gone"])}

    def _live(self, told: dict, columns: list[str], lists: set[int] | None = None) -> DataFrame:
        """Rows of some lists (all: None) that no later change replaced; the files of other lists are not opened."""
        out = None
        for add in told["adds"]:
            wanted = [l for l in add["lists"] if lists is None or int(l) in lists]
            if wanted:
                paths = [f"{self.path}/{add['name']}/list={l}" for l in wanted]
                part = self.spark.read.option("basePath", f"{self.path}/{add['name']}").parquet(*paths).select(*columns, F.col("list").cast("int").alias("list")).withColumn("_number", F.lit(add["number"]))
                out = part if out is None else out.unionByName(part)
        if out is None:
            add = next((a for a in told["adds"] if a["lists"]), None)
            if add is None:
                return self.spark.createDataFrame([], "id long, vector array<float>, code binary, list int").select(*columns, "list")
            return self._live(told, columns).limit(0)
        gone = None
        for g in told["gone"]:
            part = self.spark.read.parquet(f"{self.path}/{g['name']}").withColumn("_at", F.lit(g["number"]))
            gone = part if gone is None else gone.unionByName(part)
        if gone is not None:
            gone = gone.groupBy(F.col("id").alias("_id")).agg(F.max("_at").alias("_at"))
            gone = F.broadcast(gone) if small_enough(gone, BROADCAST_GONE) else gone
            out = out.join(gone, (out["id"] == gone["_id"]) & (out["_number"] < gone["_at"]), "left_anti")
        return out.drop("_number")

    def read(self) -> DataFrame:
        """(id, vector) of all rows."""
        return self._live(self.log.read(self.log.latest()), ["id", "vector"]).drop("list")

    def compact(self) -> None:
        """Write anew, in one, the lists that several changes added to or took from; marks of gone rows go."""

        def write(base: int, old: dict) -> dict | None:
            if len(old["adds"]) < 2 and not old["gone"]:
                return None
            self._quantizer(old["model"])
            rows = self._live(old, ["id", "vector"]).drop("list")
            return old | {"next": old["next"] + 1, "adds": [self._added(rows, old["next"])], "gone": []}

        self.log.change(write, lambda newer, own: None, {})
        self.log.vacuum(self._folders)

    def search(self, queries: DataFrame, k: int, *, probes: int | None = None, rerank: int = 10, digits: int = 9) -> DataFrame:
        """(query_id, id, distance, vector_score, vector_rank) of the k nearest of the rows found, for each query(query_id, vector).

        probes lists are read for a query; by default so many as held RECALL of the neighbours within the sample, few for clustered vectors and
        most for those without clusters. Of the rows in them the rerank * k best by code are measured exactly. Ties go to the smaller id. Null or odd-sized query vectors match nothing.
        """
        told = self.log.read(self.log.latest())
        model = self._quantizer(told["model"])
        probes = min(len(model.lists), probes or model.probes)
        asked = queries.where(F.size("vector") == told["size"]).select("query_id", F.col("vector").cast("array<double>").alias("_q"))
        n = asked.count()
        blocks, out = -(-n // BLOCK), None
        counts, codes = Counter(), 0
        for a in told["adds"]:
            counts.update({int(l): c for l, c in a["lists"].items()})
        kinds = self._live(told, ["id"]).schema["id"].dataType
        shape = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {kinds.simpleString()}, list int, rough double"
        for i in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
            if not part.num_rows:
                continue
            x = _matrix(part["_q"].combine_chunks())
            near = np.argsort((model.lists**2).sum(1)[None, :] - 2 * x @ model.lists.T, axis=1, kind="stable")[:, :probes]
            probed = {int(l): np.flatnonzero((near == l).any(1)) for l in np.unique(near)}
            codes += sum(counts[l] * len(q) for l, q in probed.items())
            # Each task passes on its best rows, so many small lists are read by one.
            tasks = max(self.spark.sparkContext.defaultParallelism, sum(counts[l] for l in probed) // TASK_ROWS)
            rows = self._live(told, ["id", "code"], set(probed)).coalesce(tasks)
            found = rows.mapInArrow(_by_code(model, x, part["query_id"].to_pylist(), to_arrow_type(asked.schema["query_id"].dataType), probed, rerank * k), shape)
            out = found if out is None else out.unionByName(found)
        if out is None:
            out = self.spark.createDataFrame([], shape)
        rough = Window.partitionBy("query_id").orderBy("rough", "id")
        best = materialize(out.withColumn("_n", F.row_number().over(rough)).where(F.col("_n") <= rerank * k).select("query_id", "id", "list"), "by-code")
        self.seen = {"rows": counts.total(), "codes": codes / max(1, n), "vectors": best.count() / max(1, n)}
        vectors = self._live(told, ["id", "vector"], {r.list for r in best.select("list").distinct().collect()})
        pairs = best.join(vectors.drop("list"), "id").join(asked, "query_id")
        exact = pairs.select("query_id", "id", F.round(squared_distance(F.col("vector"), F.col("_q")), digits).alias("distance"))
        near = Window.partitionBy("query_id").orderBy("distance", "id")
        exact = exact.withColumn("vector_rank", F.row_number().over(near).cast("long")).where(F.col("vector_rank") <= k)
        return exact.withColumn("vector_score", F.round(distance_to_score(F.col("distance")), digits))
