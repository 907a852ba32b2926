"""Terms of texts, counted on Arrow batches: the tokens that functions.text has as columns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .text import TOKEN, _folding

#: Terms of a task's batch that are held before rows leave it; twins that a task remembers.
HELD, TWINS = 1 << 19, 100_000
#: Characters of texts of ASCII letters that are in no token, as spaces.
_GAPS = {i: " " for i in range(128) if not re.match(TOKEN, chr(i))}
#: Letters and what folding makes of them, as the driver tells them: what is cached there does not travel.
Folding = tuple[str, str, dict[str, str]]


def _twin(folding: Folding) -> Callable[[str], str]:
    """fold_accents() of a lower-cased token."""
    source, target, many = folding
    table: dict[int, str | None] = {}
    for i, c in enumerate(source):
        table.setdefault(ord(c), target[i] if i < len(target) else None)
    any_of = re.compile(f"[{''.join(many)}]")

    def fold(token: str) -> str:
        if any_of.search(token):
            for c, bare in many.items():
                token = token.replace(c, bare)
        return token.translate(table)

    return fold


def _counter(folding: Folding) -> Callable[[str], tuple[int, dict[str, int]]]:
    """Lower-cased text -> (number of tokens, count of each term): tokens() of functions.text, twins and all."""
    find, fold, twins, gaps = re.compile(TOKEN[1:-1]).findall, _twin(folding), {}, str.maketrans(_GAPS)

    def count(low: str) -> tuple[int, dict[str, int]]:
        plain = low.isascii()
        found = low.translate(gaps).split() if plain else find(low)
        total, out = len(found), dict(Counter(found))
        for raw in [x for x in out if x[0] == "." or x[-1] == "."]:
            n, term = out.pop(raw), raw.strip(".")
            if term:
                out[term] = out.get(term, 0) + n
            else:
                total -= n
        if not plain:
            for term, n in [x for x in out.items() if not x[0].isascii()]:
                other = twins.get(term)
                if other is None:
                    if len(twins) >= TWINS:
                        twins.clear()
                    other = twins[term] = fold(term)
                if other != term:
                    total += n
                    out[other] = out.get(other, 0) + n
        return total, out

    return count


def _lists(at: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)


def _lowered(texts: DataFrame) -> DataFrame:
    return texts.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def counted(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """(id, dl, t, f) of texts(id, text): the number of tokens, and the places in `wanted` of the terms that a text has, with their counts."""
    kind, folding = to_arrow_type(texts.schema["id"].dataType), _folding()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, count = {w: i for i, w in enumerate(wanted)}, _counter(folding)
        for batch in batches:
            ids, lo, dl, at, t, f = batch.column(0).cast(kind), 0, [], [0], [], []
            for i, low in enumerate(batch.column(1).to_pylist(), 1):
                total, found = count(low)
                for term in found.keys() & place.keys():
                    t.append(place[term])
                    f.append(found[term])
                dl.append(total)
                at.append(len(t))
                if len(t) >= HELD or i == len(ids):
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, i - lo), pa.array(dl, pa.int32()), _lists(at, pa.array(t, pa.int32())), _lists(at, pa.array(f, pa.int32()))], ["id", "dl", "t", "f"])
                    lo, dl, at, t, f = i, [], [0], [], []

    return _lowered(texts).mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, dl int, t array<int>, f array<int>")


def postings(texts: DataFrame) -> DataFrame:
    """(id, dl, t) of texts(id, text): the number of tokens, and an array of (term, tf)."""
    kind, folding = to_arrow_type(texts.schema["id"].dataType), _folding()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(folding)
        for batch in batches:
            ids, lo, dl, at, t, f = batch.column(0).cast(kind), 0, [], [0], [], []
            for i, low in enumerate(batch.column(1).to_pylist(), 1):
                total, found = count(low)
                t.extend(found.keys())
                f.extend(found.values())
                dl.append(total)
                at.append(len(t))
                if len(t) >= HELD or i == len(ids):
                    each = pa.StructArray.from_arrays([pa.array(t, pa.string()), pa.array(f, pa.int32())], ["term", "tf"])
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, i - lo), pa.array(dl, pa.int32()), _lists(at, each)], ["id", "dl", "t"])
                    lo, dl, at, t, f = i, [], [0], [], []

    return _lowered(texts).mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, dl int, t array<struct<term:string,tf:int>>")


def frequencies(held: DataFrame, n: int) -> np.ndarray:
    """For each of n places in how many rows of counted() it is: a task sums its rows up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["term", "df"])

    out = np.zeros(n, np.int64)
    for r in held.select("t").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow().to_pylist():
        out[r["term"]] = r["df"]
    return out
