"""Sources that are listed page by page: a Python data source whose partitions are cursors, and lists of lists followed to their end.

A client tells what a page of a list holds. It is made on the executors from the source's options, so it is named, not sent.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..errors import SourceError, one_line
from .scratch import materialize

ITEM = "struct<id: string, has_children: boolean, body: string>"
ROWS = "list string, cursor string, position bigint, id string, has_children boolean, body string"
LISTED = f"list string, cursor string, at bigint, items array<{ITEM}>, next string"
#: Pages of one list that a task follows in a round, one after another, as only a page tells the cursor of the next.
CHAIN = 64


class Page(NamedTuple):
    """Items, each {"id", "has_children", "body"}, and the cursor after them; None at the list's end."""

    items: list[dict]
    next: str | None


class Client(Protocol):
    def starts(self, name: str) -> list[str]:
        """Cursors of a list that are known without reading it; new ones come last."""

    def page(self, name: str, cursor: str) -> Page:
        """The page at a cursor; "" is the list's begin."""


class FolderClient:
    """A snapshot under options["path"]: each list is a folder of JSON lines, each file of it a page, in the order of their names."""

    def __init__(self, options: dict[str, str]):
        path = options["path"]
        self.store, self.path = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)

    def starts(self, name: str) -> list[str]:
        try:
            found = self.store.get_file_info(fs.FileSelector(f"{self.path}/{name}"))
        except FileNotFoundError as e:
            raise SourceError(f"no list {name}") from e
        return sorted(i.base_name for i in found if i.base_name.endswith(".json") and not i.base_name.startswith(("_", ".")))

    def page(self, name: str, cursor: str) -> Page:
        names = [] if cursor else self.starts(name)
        if not cursor and not names:
            return Page([], None)
        with self.store.open_input_stream(f"{self.path}/{name}/{cursor or names[0]}") as f:
            items = [json.loads(line) for line in f.read().decode().split("\n") if line.strip()]
        if cursor:
            names = self.starts(name)
        at = names.index(cursor or names[0]) + 1
        return Page(items, names[at] if at < len(names) else None)


def client_of(options: dict[str, str]) -> Client:
    """The client that options["client"] names as module:class, made from the options."""
    module, _, name = options.get("client", f"{__name__}:FolderClient").partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


def requested(call: Callable[[], Page], tries: int, wait: float) -> Page:
    """What a call returns, tried again after a wait; then an error of the library, on one line."""
    for n in range(tries):
        try:
            return call()
        except Exception as e:  # noqa: BLE001  told below
            if n + 1 == tries:
                raise SourceError(f"the source failed: {one_line(e, limit=300)}") from e
            time.sleep(wait)
    raise SourceError("no tries")


class Cursor(InputPartition):
    """A page, or its items from `first` up to `last`."""

    def __init__(self, cursor: str, first: int = 0, last: int | None = None):
        self.cursor, self.first, self.last = cursor, first, last


def _page(options: dict[str, str], cursor: str) -> Page:
    client = client_of(options)
    return requested(lambda: client.page(options["list"], cursor), int(options.get("tries", "3")), float(options.get("wait", "1")))


def _rows(options: dict[str, str], part: Cursor) -> Iterator[tuple]:
    items = _page(options, part.cursor).items[: part.last]
    for n, item in enumerate(items[part.first :], part.first):
        yield options["list"], part.cursor, n, item.get("id"), bool(item.get("has_children")), item.get("body")


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Cursor]:
        return [Cursor(c) for c in client_of(self.options).starts(self.options["list"])]

    def read(self, partition: Cursor) -> Iterator[tuple]:
        yield from _rows(self.options, partition)


class _Stream(DataSourceStreamReader):
    """An offset counts cursors, in the order in which the client tells them, and the items of the last one, which may be filled later.

    The list may grow at its end.
    """

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"n": 0, "items": 0}

    def latestOffset(self) -> dict:
        found = client_of(self.options).starts(self.options["list"])
        return {"n": len(found), "items": len(_page(self.options, found[-1]).items) if found else 0}

    def partitions(self, start: dict, end: dict) -> list[Cursor]:
        known = client_of(self.options).starts(self.options["list"])[max(0, start["n"] - 1) : end["n"]]
        parts = [Cursor(c) for c in known]
        if parts and start["n"]:
            parts[0].first = start["items"]
        if parts:
            parts[-1].last = end["items"]
        return parts

    def read(self, partition: Cursor) -> Iterator[tuple]:
        yield from _rows(self.options, partition)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """spark.read (or readStream) .format("paged"): the items of one list; position counts within a cursor.

    Options: list; client (module:class, a FolderClient unless set) and what it needs; tries and wait (seconds) of a request.
    Each cursor that is known ahead is a partition, so a lost task asks for one page again.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: object) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


Fetch = Callable[[DataFrame], DataFrame]


def fetch_with(options: dict[str, str], *, chain: int = CHAIN, tries: int = 3, wait: float = 1.0) -> Fetch:
    """fetch(list, cursor) -> LISTED by a client: a row for each page, at most `chain` pages from a cursor; `at` counts items before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_of(options)
        for batch in batches:
            for name, cursor in zip(batch["list"], batch["cursor"], strict=True):
                at, here = 0, cursor
                for k in range(chain):
                    got = requested(lambda here=here: client.page(name, here), tries, wait)
                    items = [{"id": i.get("id"), "has_children": bool(i.get("has_children")), "body": i.get("body")} for i in got.items]
                    more = got.next if k + 1 == chain else None
                    yield pd.DataFrame([(name, cursor, at, items, more)], columns=["list", "cursor", "at", "items", "next"])
                    at, here = at + len(items), got.next
                    if here is None:
                        break

    return lambda asked: asked.select("list", "cursor").mapInPandas(run, LISTED)


def fetch_from(pages: DataFrame) -> Fetch:
    """fetch() from a table of all pages(list, at, items): a join, all pages of a list at once."""
    held = pages.select("list", F.col("at").cast("bigint").alias("at"), F.col("items").cast(f"array<{ITEM}>").alias("items"), F.lit(None).cast("string").alias("next"))
    return lambda asked: asked.join(held, "list").select("list", "cursor", "at", "items", "next")


def follow(roots: DataFrame, fetch: Fetch) -> DataFrame:
    """All items below roots(list): root, list, path (positions from the root, sorted as one reads), id, has_children, cycle, body.

    Round by round, what is not yet listed (pages after a cursor, children of items) is asked for, each (list, cursor) once a round
    whoever holds it, and written; rounds end when nothing is left. An item that is its own ancestor is marked and not followed,
    nor is one without an id. Repeated roots count once; null ones, and lists that the source does not have, give no rows.
    """
    start = roots.where("list is not null").select(F.col("list").cast("string").alias("root")).distinct()
    number = "array<bigint>"
    frontier = start.select("root", F.col("root").alias("list"), F.lit("").alias("cursor"), F.lit(0).cast("bigint").alias("base"), F.array().cast(number).alias("path"), F.array("root").alias("trail"))
    frontier, out = materialize(frontier, "frontier"), None
    while True:
        met = materialize(frontier.join(fetch(frontier.select("list", "cursor").distinct()), ["list", "cursor"]), "listed")
        item = met.select("root", "list", "trail", "path", (F.col("base") + F.col("at")).alias("base"), F.posexplode("items").alias("_n", "_i"))
        item = item.select("root", "list", "trail", F.concat("path", F.array(F.col("base") + F.col("_n"))).alias("path"), "_i.id", F.coalesce("_i.has_children", F.lit(False)).alias("has_children"), F.coalesce(F.array_contains("trail", F.col("_i.id")), F.lit(False)).alias("cycle"), "_i.body")
        level = item.drop("trail")
        out = level if out is None else out.unionByName(level)
        after = met.where("next is not null").select("root", "list", F.col("next").alias("cursor"), (F.col("base") + F.col("at") + F.size("items")).alias("base"), "path", "trail")
        below = item.where("has_children and not cycle and id is not null").select("root", F.col("id").alias("list"), F.lit("").alias("cursor"), F.lit(0).cast("bigint").alias("base"), "path", F.concat("trail", F.array("id")).alias("trail"))
        frontier = materialize(after.unionByName(below), "frontier")
        if frontier.isEmpty():
            return out
