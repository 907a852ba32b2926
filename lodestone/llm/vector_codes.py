"""Product codes of vectors, by Elkan's Lloyd iteration on whole numbers.

A vector's parts are coded by the nearest entries of small codebooks. Between passes each row's table keeps, for each part, an
upper bound of the distance to its entry and a lower bound of that to every entry. When entries move, the bounds are shifted by as much; a
distance is computed only where the triangle inequality cannot tell that it is strictly the larger one. Ties are settled by whole
numbers, and bounds are rounded to the safe side, so that the codes are those of the full search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, small_batches, small_enough
from .int_vectors import even_width, matrix, whole_numbers

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows of sums by label that are sent to every executor; more go by a shuffled join.
BROADCAST_LABELS = 100_000
_FAR = np.iinfo(np.int64).max


def _up(x: np.ndarray) -> np.ndarray:
    """Roots that are no smaller than the true ones, in 32 bits."""
    root = np.sqrt(x.astype(np.float64)) * (1 + 1e-15)
    out = root.astype(np.float32)
    return np.where(out < root, np.nextafter(out, np.float32(np.inf)), out)


def _down(root: np.ndarray) -> np.ndarray:
    """Bounds in 16 bits that are no larger than the given ones, and no smaller than 0."""
    with np.errstate(over="ignore"):
        out = root.astype(np.float16)
    return np.maximum(np.where(out > root, np.nextafter(out, np.float16(-np.inf)), out), np.float16(0))


def _root_down(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64)) * (1 - 1e-15)


@dataclass
class Books:
    """entries[part, entry, position]; moved: how far each has moved since the last pass, at most; None before the first."""

    entries: np.ndarray
    moved: np.ndarray | None = None

    def text(self) -> str:
        return ",".join(map(str, self.entries.reshape(-1).tolist()))


def _full(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to all entries of one part."""
    out = np.zeros((len(x), len(book)), np.int64)
    for j in range(book.shape[1]):
        out += (x[:, j, None] - book[None, :, j]) ** 2
    return out


def _first(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries, squared distances to them, lower bounds) by the full search."""
    d = _full(x, book)
    code = d.argmin(1)
    return code, d[np.arange(len(x)), code], _down(_root_down(d))


def _again(x: np.ndarray, book: np.ndarray, moved: np.ndarray, half: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entries, squared distances to them, lower bounds, computed distances of each row) from those of the last pass.

    half: lower bounds of half the distances between entries.
    """
    rows = np.arange(len(x))
    upper, lower = upper + moved[code], np.maximum(lower.astype(np.float64) - moved[None, :], 0)
    d = ((x - book[code]) ** 2).sum(1)  # the error asks for it in any case
    computed = np.ones(len(x), np.int64)
    other = half.copy()
    np.fill_diagonal(other, np.inf)
    open_ = np.flatnonzero(upper >= other.min(1)[code]) if len(book) > 1 else rows[:0]
    if len(open_):
        own, near = code[open_], _up(d[open_]).astype(np.float64)
        wanted = (lower[open_] <= near[:, None]) & (half[own] <= near[:, None])
        wanted[np.arange(len(open_)), own] = False
        r, c = np.nonzero(wanted)
        exact = ((x[open_[r]] - book[c]) ** 2).sum(1)
        all_ = np.full(wanted.shape, _FAR, np.int64)
        all_[r, c], all_[np.arange(len(open_)), own] = exact, d[open_]
        best = all_.argmin(1)
        lower[open_[r], c] = _root_down(exact)
        np.add.at(computed, open_[r], 1)
        code = code.copy()
        lower[open_, own] = _root_down(d[open_])
        code[open_], d[open_] = best, all_[np.arange(len(open_)), best]
    return code, d, _down(lower), computed


def _assign(books: Books, width: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with x and, after the first pass, code, upper and lower: the same with new ones, error and the number of computed distances."""
    entries, moved = books.entries, books.moved
    parts, k, size = entries.shape
    halves = [_root_down(_full(b, b)) / 2 for b in entries]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = matrix(batch.column("x"), width).reshape(n, parts, size)
            code, error, computed = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
            upper, lower = np.zeros((n, parts), np.float32), np.zeros((n, parts, k), np.float16)
            if moved is not None and n:
                old = [np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in (("code", np.uint8), ("upper", np.float32), ("lower", np.float16))]
                old_code, old_upper, old_lower = old[0].reshape(n, parts), old[1].reshape(n, parts), old[2].reshape(n, parts, k)
            for p in range(parts):
                if moved is None:
                    own, d, low = _first(x[:, p], entries[p])
                    computed += k
                else:
                    own, d, low, count = _again(x[:, p], entries[p], moved[p], halves[p], old_code[:, p].astype(np.int64), old_upper[:, p].astype(np.float64), old_lower[:, p])
                    computed += count
                code[:, p], upper[:, p], lower[:, p] = own, _up(d), low
                error += d
            out = {c: batch.column(c) for c in batch.schema.names if c not in ("code", "upper", "lower", "error", "computed")}
            out |= {"code": pa.array([r.tobytes() for r in code], pa.binary()), "error": pa.array(error), "computed": pa.array(computed)}
            if not last:
                out |= {"upper": pa.array([r.tobytes() for r in upper], pa.binary()), "lower": pa.array([r.tobytes() for r in lower], pa.binary())}
            yield pa.RecordBatch.from_pydict(out)

    return run


def _sums(shape: tuple[int, int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums of parts and their number, for each entry."""
    parts, k, size = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * k, size), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            n = batch.num_rows
            if n:
                x = matrix(batch.column("x"), parts * size).reshape(n, parts, size)
                slot = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64) + k * np.arange(parts)
                np.add.at(total, slot, x)
                count += np.bincount(slot.reshape(-1), minlength=parts * k)
        used = np.flatnonzero(count)
        slots, places = np.repeat(used, size), np.tile(np.arange(size), len(used))
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slots), "place": pa.array(places), "total": pa.array(total[used].reshape(-1)), "n": pa.array(np.repeat(count[used], size))})

    return run


def encode(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", carry: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """(key, carry, code, error, computed) of each vector, and the codebooks. code has a byte for each part.

    Codebooks start as the parts of the vectors with the smallest keys (a null key comes last, rows of one key by their vectors);
    with fewer vectors than entries there are fewer entries. Each round assigns and then moves entries to the floors of the means;
    unused ones stay. Rows with a null vector, or with null or non-finite components, are left out. Repeated rows count each. Shorter
    vectors are filled up with zeros; components beyond the limit of int_vectors count as that limit. entries is 256 at most.
    computed is the number of distances that the last pass computed for the row; the bounds decided about the others.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = whole_numbers(vectors, vector).select(F.col(key).alias("key"), *(F.col(c).alias(f"c_{c}") for c in carry), "x")
    rows, width = even_width(rows, "x", parts)
    seeds = rows.orderBy(F.asc_nulls_last("key"), "x").select("x").limit(entries).collect()
    k, size = len(seeds), width // parts
    books = Books(np.array([r.x for r in seeds], np.int64).reshape(k, parts, size).transpose(1, 0, 2))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    state = rows
    for turn in range(rounds + 1):
        last = turn == rounds
        schema = f"{kept}, code binary, error long, computed long" + ("" if last else ", upper binary, lower binary")
        state = materialize((state if k else rows.limit(0)).mapInArrow(_assign(books, width, last), schema) if k else spark.createDataFrame([], schema), "codes")
        if last or not k:
            break
        sums = state.select("x", "code").mapInArrow(_sums((parts, k, size)), "slot long, place long, total long, n long").groupBy("slot", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        new = books.entries.reshape(parts * k, size).copy()
        for r in sums.collect():  # a number for each component of the codebooks
            new[r.slot, r.place] = r.total // r.n
        new = new.reshape(parts, k, size)
        books = Books(new, _up(((new - books.entries) ** 2).sum(2)).astype(np.float64))
    return state.select(F.col("key").alias(key), *(F.col(f"c_{c}").alias(c) for c in carry), "code", "error", "computed"), books


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded with label_error, the errors summed over equal labels; nulls count as equal."""
    sums = materialize(coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    sums = F.broadcast(sums) if small_enough(sums, BROADCAST_LABELS) else sums
    return coded.join(sums, coded[label].eqNullSafe(sums["_label"])).drop("_label")


def digest(books: Books) -> str:
    """SHA-256 of all components in decimal digits, by part, entry and position."""
    return hashlib.sha256(books.text().encode()).hexdigest()
