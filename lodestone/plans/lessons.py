"""Pages of a paged source as lessons: metadata, metadata document and content units."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import metadata
from ..operators.blocks import Vision, parse_flat
from ..sources.paged import Fetch, follow
from ..sources.scratch import materialize


class Lessons(NamedTuple):
    """pages: a row for each page; units: its content in reading order (see parse_pages)."""

    pages: DataFrame
    units: DataFrame


def flat_blocks(found: DataFrame, meta: DataFrame) -> DataFrame:
    """FLAT rows of followed items, whose bodies are blocks (JSON), and of meta(page_id, meta).

    A table's rows become its cells and are no rows of their own. An item without a body is an unsupported block.
    """
    kind = F.coalesce(F.get_json_object("body", "$.type"), F.lit("unsupported"))
    own = found.withColumns({"type": kind, "place": F.element_at("path", -1), "up": F.slice("path", 1, F.size("path") - 1)})
    tables = own.where("type = 'table'").select("root", F.col("path").alias("up"), F.lit(True).alias("in_table"))
    own = own.join(tables, ["root", "up"], "left")
    cells = F.from_json(F.coalesce(F.get_json_object("body", "$.table_row.cells"), F.lit("[]")), "array<string>")
    held = F.sort_array(F.collect_list(F.struct("place", F.concat(F.lit("["), F.array_join(cells, ","), F.lit("]")).alias("cells"))))
    rows = own.where("in_table and type = 'table_row'").groupBy("root", F.col("up").alias("path")).agg(F.concat(F.lit("["), F.array_join(F.transform(held, lambda r: r["cells"]), ","), F.lit("]")).alias("rows"))
    # What stands inside a table is told by its rows.
    rest = own.where("in_table is null").join(rows, ["root", "path"], "left")
    rest = rest.withColumn("rows", F.when(F.col("type") == "table", F.coalesce("rows", F.lit("[]"))))
    order = F.row_number().over(Window.partitionBy("root").orderBy("path")) - 1
    payload = F.coalesce(F.expr("get_json_object(body, concat('$.', type))"), F.lit("{}"))
    flat = rest.select(F.col("root").alias("page_id"), order.cast("bigint").alias("ordinal"), "place", "id", "type", payload.alias("payload"), "rows")
    return flat.join(meta, "page_id", "left").select("page_id", "meta", "ordinal", "place", "id", "type", "payload", "rows")


def lessons(pages: DataFrame, fetch: Fetch, *, hash_property: str = "Content Hash", vision: Vision | None = None) -> Lessons:
    """pages(id, body): the rows of a database, as a paged source lists them; fetch: lists what is below a page or block.

    A lesson's row has the page's metadata, its metadata document (null where that would say nothing; skipped_empty tells), and
    of its content the number of units, their block types and the images. A page without content has none of them. Pages
    without an id are left out, repeated ones count once.
    """
    page = F.col("body")
    own = pages.where("id is not null").dropDuplicates(["id"]).select(*(c.alias(n) for n, c in metadata.page_metadata(page, hash_property).items()), F.col("id").alias("_id"))
    own = materialize(own.drop("page_id").withColumnRenamed("_id", "page_id"), "lessons")
    useful = {c: F.col(c) for c in ("title", "week", "date", "module", "lecturer", "label")}
    worth = metadata.worth_indexing(**useful)
    meta = own.select("page_id", F.create_map(F.lit("title"), F.coalesce("title", F.lit("")), F.lit("last_edited_time"), F.coalesce("last_edited_time", F.lit(""))).alias("meta"))
    found = follow(own.select(F.col("page_id").alias("list")), fetch)
    units = materialize(parse_flat(flat_blocks(found, meta), vision), "units")
    image = F.when(F.col("image_url") != "", F.col("image_url"))
    told = units.groupBy("page_id").agg(F.count("*").alias("n_units"), F.sort_array(F.collect_set(F.col("meta")["block_type"])).alias("block_types"), F.sort_array(F.collect_set(image)).alias("image_refs"))
    none = F.array().cast("array<string>")
    own = own.withColumns({"metadata_document": F.when(worth, metadata.metadata_text(**useful, is_summary_done=F.col("is_summary_done"))), "skipped_empty": ~worth})
    out = own.join(told, "page_id", "left").withColumns({"n_units": F.coalesce("n_units", F.lit(0)), "block_types": F.coalesce("block_types", none), "image_refs": F.coalesce("image_refs", none)})
    return Lessons(out, units)
