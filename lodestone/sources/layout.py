"""Documents as layout blocks, by a table function over their pages, and as units, with a budget of images read for each document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import SourceError
from ..schema import UNIT
from .scratch import materialize

#: parser(content) -> pages, each {"blocks": [{"lines", "bbox", "image"}, ...], "tables": [rows, ...], "scan": bytes of the whole page}.
Parser = Callable[[bytes], list[dict]]
#: ocr(image) -> {"text", "error"}
Ocr = Callable[[bytes], dict]
LAYOUT = "page bigint, pages bigint, at bigint, kind string, text string, bbox string, image binary"


def block_text(block: dict) -> str:
    """Spans of a line joined, lines joined by line feeds, blank ones dropped."""
    lines = ("".join(spans).strip() for spans in block.get("lines") or [])
    return "\n".join(x for x in lines if x)


def box(value: object) -> str:
    """Four numbers with two decimals, or empty."""
    return ",".join(f"{float(v):.2f}" for v in value) if isinstance(value, list | tuple) and len(value) == 4 else ""


def table_lines(rows: list[list[str]]) -> str:
    """Rows of cells as a Markdown table: empty rows go, short ones are padded, the first is the header."""
    full = [r for r in rows if any(r)]
    width = max(map(len, full), default=0)
    padded = [[c.replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in full]
    return "\n".join(f"| {' | '.join(r)} |" for r in [*padded[:1], ["---"] * width, *padded[1:]]) if full else ""


def page_blocks(page: dict) -> Iterator[tuple]:
    """(at, kind, text, bbox, image) of a page: its text and image blocks, the whole page as a scan if no block has text, its tables."""
    blocks, some = page.get("blocks") or [], False
    for i, b in enumerate(blocks):
        text = block_text(b)
        if text:
            some = True
            yield i, "text", text, box(b.get("bbox")), None
        elif b.get("image"):
            yield i, "image", None, box(b.get("bbox")), b["image"]
    if not some and page.get("scan"):
        yield len(blocks), "scan", None, "", page["scan"]
    for i, rows in enumerate(page.get("tables") or []):
        text = table_lines([[" ".join(str(c or "").split("\n")).strip() for c in r] for r in rows])
        if text:
            yield i, "table", text, "", None


def layout(files: DataFrame, parser: Parser) -> DataFrame:
    """document_id, path and LAYOUT columns of the blocks of files(document_id, path, content).

    A table function emits a file's blocks one by one. at counts blocks, and tables, within their page. A file without
    pages is an error; a null content is such a file.
    """

    @F.udtf(returnType=LAYOUT)
    class Blocks:
        def eval(self, path: str | None, content: bytes | str | None) -> Iterator[tuple]:
            pages = [] if content is None else parser(content)
            if not pages:
                raise SourceError(f"no pages: {path}")
            for p, page in enumerate(pages, 1):
                for at, kind, text, bbox, image in page_blocks(page):
                    yield p, len(pages), at, kind, text, bbox, image

    known = lambda c: F.coalesce(c, F.lit("")).alias(c)
    own = files.select(known("document_id"), known("path"), "content")
    return own.lateralJoin(Blocks(F.col("path").outer(), F.col("content").outer())).drop("content")


def admitted(blocks: DataFrame, cap: int) -> DataFrame:
    """The first `cap` images and scans of each document, in page order, with image_index from 0.

    The limit on the rank lets each task keep `cap` rows of a document before the shuffle, so a document of very many images costs no more.
    """
    order = Window.partitionBy("document_id").orderBy("page", "at")
    return blocks.where(F.col("kind").isin("image", "scan")).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= cap).withColumn("image_index", F.col("_nth") - 1).drop("_nth")


def units(blocks: DataFrame, ocr: Ocr | None = None, cap: int = 20) -> DataFrame:
    """UNIT rows of layout() rows: text, and what OCR reads of the images admitted, in page order, then all tables of the document.

    An image is a unit if it has a text or its OCR failed, which meta tells (ocr_error); images beyond the cap are not read. ordinal
    is a sum over pages of what they hold and a number within the page, so no window holds a document's units at once.
    """
    if ocr is not None:
        blocks = materialize(blocks, "layout")

    @F.pandas_udf("text string, error string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for images in batches:
            got = [ocr(bytes(x)) for x in images]
            yield pd.DataFrame([[g.get("text") or "", g.get("error") or ""] for g in got], columns=["text", "error"])

    none = F.lit(None).cast("string")
    own = blocks.where(F.col("kind").isin("text", "table")).drop("image").withColumns({"ocr_text": none, "ocr_error": none, "image_index": none})
    if ocr is not None:
        seen = admitted(blocks, cap).withColumn("_seen", read("image")).where("_seen.text <> '' OR _seen.error <> ''")
        seen = seen.withColumns({"text": F.when(F.col("_seen.text") != "", F.col("_seen.text")).otherwise("[Image without text]"), "ocr_text": F.when(F.col("_seen.text") != "", "yes").otherwise(""), "ocr_error": F.col("_seen.error"), "image_index": F.col("image_index").cast("string")})
        own = own.unionByName(seen.drop("image", "_seen"))
    last = F.col("kind") == "table"
    own = own.withColumn("_last", last)
    before = own.groupBy("document_id", "path", "_last", "page").agg(F.count("*").alias("_n"))
    total = Window.partitionBy("document_id", "path").orderBy("_last", "page")
    before = before.withColumn("_before", F.sum("_n").over(total) - F.col("_n")).drop("_n")
    within = Window.partitionBy("document_id", "path", "_last", "page").orderBy("at")
    own = own.withColumn("_k", F.row_number().over(within) - 1).join(before, ["document_id", "path", "_last", "page"])
    page, at = F.col("page").cast("string"), F.col("at").cast("string")
    form = F.when(last, "table").when(F.col("kind") == "text", "block").otherwise(F.col("kind"))
    image = F.col("kind").isin("image", "scan")
    meta = {
        "source_type": F.lit("pdf"), "source_file": F.element_at(F.split("path", "/"), -1), "document_id": F.col("document_id"), "page_count": F.col("pages").cast("string"), "page_number": page,
        "source_granularity": F.when(last, "page_table").when(image, "page_image").otherwise("page_block"), "block_type": F.when(last, "table").when(image, "image").otherwise("paragraph"),
        "block_id": F.when(~last, F.concat(F.lit("block_"), at)), "bbox": F.when(~last, F.col("bbox")), "table_index": F.when(last, at), "image_ocr_text": F.col("ocr_text"), "ocr_error": F.col("ocr_error"), "image_index": F.col("image_index"),
    }
    told = F.map_filter(F.create_map(*(x for k, v in meta.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    name = F.concat(F.lit("pdf_"), "document_id", F.lit("_page_"), page, F.lit("_"), form, F.lit("_"), at)
    return own.select(name.alias("id"), (F.col("_before") + F.col("_k")).cast("bigint").alias("ordinal"), "text", told.alias("meta")).select(*UNIT.names)
