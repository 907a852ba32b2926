"""File sources: test sets, page snapshots, PDFs and images; and report sinks."""

from __future__ import annotations

import mimetypes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from ..schema import SAMPLE
from .layout import Ocr, Parser, layout, units


def read_testset(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as SAMPLE rows; blank lines are skipped; a missing sample_id is q and the physical line number."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "json")).where(F.trim("json") != "")
    row = F.from_json("json", "sample_id string, question string, query string, ground_truth string, reference string, expected_source_notes string, tags array<string>, top_k bigint")
    own = text.select("line", row.alias("r")).select("line", "r.*")
    return own.select(
        F.coalesce("sample_id", F.format_string("q%03d", F.col("line") + 1)).alias("sample_id"),
        F.coalesce("question", "query").alias("question"),
        F.coalesce("ground_truth", "reference", F.lit("")).alias("ground_truth"),
        F.coalesce("expected_source_notes", F.lit("")).alias("expected_source_notes"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        "top_k",
    ).to(SAMPLE)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of pages as JSON lines: page (JSON), page_id, blocks (JSON array)."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("page"), F.get_json_object("value", "$.id").alias("page_id"), F.coalesce(F.get_json_object("value", "$.blocks"), F.lit("[]")).alias("blocks"))


def read_binaries(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content, document_id (SHA-256 of the content) and mime of each file."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for e, kind in sorted(mimetypes.types_map.items()) for x in (e.lstrip("."), kind)))
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content", F.sha2("content", 256).alias("document_id"), F.coalesce(known[ending], F.lit("application/octet-stream")).alias("mime"))


#: Resolution of pages that are read as pictures.
SCAN_DPI = 150


def pdf_blocks(content: bytes) -> list[dict]:
    """Pages of a PDF as [{"blocks": [{"lines": [[span, ...], ...], "bbox": [...]}, ...], "tables": [rows, ...], "scan": picture}], by PyMuPDF if it is there."""
    try:
        import fitz
    except ImportError as e:
        raise SourceError("PDF parsing needs PyMuPDF, or another parser") from e
    out = []
    with fitz.open(stream=content, filetype="pdf") as pdf:
        for page in pdf:
            got = page.get_text("dict")["blocks"]
            blocks = [{"lines": [[s["text"] for s in line["spans"]] for line in b.get("lines", [])], "bbox": list(b["bbox"]), "image": b.get("image")} for b in got]
            out.append({"blocks": blocks, "tables": [t.extract() for t in page.find_tables().tables], "scan": page.get_pixmap(dpi=SCAN_DPI).tobytes("png") if not page.get_text().strip() else None})
    return out


def pdf_units(files: DataFrame, parser: Parser = pdf_blocks, ocr: Ocr | None = None, cap: int = 20) -> DataFrame:
    """UNIT rows of files(path, content, document_id): text blocks in page order, OCR of at most `cap` images of each, then all tables.

    A failed OCR leaves a marked unit (ocr_error). A file that has no pages, or another ending than .pdf, is an error.
    """
    kind = F.lower(F.col("path")).endswith(".pdf")
    wrong = F.raise_error(F.concat(F.lit("not a PDF: "), F.coalesce("path", F.lit("")))).cast("binary")
    return units(layout(files.withColumn("content", F.when(kind, F.col("content")).otherwise(wrong)), parser), ocr, cap)


def pdf_pages(files: DataFrame, parser: Parser = pdf_blocks) -> DataFrame:
    """One row per page with text: its blocks joined by blank lines."""
    units = pdf_units(files, parser).where(F.col("meta").getItem("source_granularity") == "page_block")
    page = units.groupBy(F.col("meta").getItem("document_id").alias("document_id"), F.col("meta").getItem("page_number").cast("long").alias("page_number"))
    held = F.sort_array(F.collect_list(F.struct("ordinal", "text")))
    return page.agg(F.array_join(F.transform(held, lambda u: u["text"]), "\n\n").alias("text"))


def report_formats(formats: list[str]) -> list[str]:
    """Clean format names, in order, each once; all three for none."""
    known, out = {"json": "json", "csv": "csv", "md": "md", "markdown": "md"}, []
    for f in (f.strip().lower().lstrip(".") for f in formats):
        if f and f not in known:
            raise ValueError("reports are json, csv or md")
        if f and known[f] not in out:
            out.append(known[f])
    return out or ["json", "csv", "md"]


def write_report(rows: DataFrame, markdown: str, path: str, formats: list[str]) -> dict[str, str]:
    """Write report rows as JSON lines and CSV folders, and the Markdown text as one file; the paths by format."""
    out = {}
    for f in report_formats(formats):
        out[f] = f"{path.rstrip('/')}/report.{f}"
        if f == "json":
            rows.write.mode("overwrite").json(out[f])
        elif f == "csv":
            rows.write.mode("overwrite").option("header", True).csv(out[f])
        else:
            rows.sparkSession.createDataFrame([(markdown,)], "value string").coalesce(1).write.mode("overwrite").text(out[f])
    return out
