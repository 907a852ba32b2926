"""Rows of cells as Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_text(cell: Column) -> Column:
    return F.trim(F.replace(F.coalesce(cell, F.lit("")), F.lit("\n"), F.lit(" ")))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table: empty rows go, short rows are padded, the first row is the header; "" if none is left."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, cell_text)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(clean, lambda r: F.size(r)))
    line = lambda r: markdown_row(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    rule = markdown_row(F.array_repeat(F.lit("---"), width))
    lines = F.transform(clean, line)
    return F.when(F.size(clean) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")).otherwise(F.lit(""))
