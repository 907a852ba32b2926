"""Page properties, metadata documents, labels and content hashes as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normal_key

# Names of a page property in order of priority, folded; titles that mean none; labels of the metadata document.
ALIASES = {
    "week": ("week", "tuan", "w"),
    "date": ("date", "ngay", "ngay hoc"),
    "module": ("module", "mod", "mo dun"),
    "lecturer": ("lecturer", "giang vien", "teacher", "instructor"),
    "label": ("label", "labels", "tag", "tags", "chu de"),
    "is_summary_done": ("tong hop", "summary", "done", "completed", "is summary done"),
}
EMPTY_TITLES = ("", "empty", "emty", "untitled notion lesson")
NO_TITLE = "Untitled Notion lesson"
USEFUL = ("title", "week", "date", "module", "lecturer", "label")
DOCUMENT_LINES = (("Bài", "title"), ("Week", "week"), ("Date", "date"), ("Module", "module"), ("Lecturer", "lecturer"), ("Label", "label"))
SUMMARY_LINE = "Tổng hợp"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _field(prop: Column, path: str) -> Column:
    return F.get_json_object(prop, f"$.{path}")


def _names(prop: Column, path: str) -> Column:
    """Names of a list of objects, joined by commas."""
    items = F.from_json(_field(prop, path), "array<struct<name:string>>")
    return F.coalesce(F.array_join(F.transform(items, lambda i: F.coalesce(i["name"], F.lit(""))), ", "), F.lit(""))


def rich_text(items: Column) -> Column:
    """A JSON array of rich-text items as one string."""
    got = F.from_json(items, "array<struct<plain_text:string,text:struct<content:string>>>")
    text = F.transform(got, lambda i: F.when(F.coalesce(i["plain_text"], F.lit("")) != "", i["plain_text"]).otherwise(F.coalesce(i["text"]["content"], F.lit(""))))
    return F.coalesce(F.array_join(F.filter(text, lambda t: t != ""), " "), F.lit(""))


def property_value(prop: Column) -> Column:
    """A typed property (JSON) as a plain string: titles and texts joined, dates by their start, selects by name, lists by commas."""
    return _let(prop, _plain_value)


def _plain_value(prop: Column) -> Column:
    kind, blank = _field(prop, "type"), F.lit("")
    formula = _field(prop, "formula.type")
    return (
        F.when(kind.isin("title", "rich_text"), F.when(kind == "title", rich_text(_field(prop, "title"))).otherwise(rich_text(_field(prop, "rich_text"))))
        .when(kind == "number", _field(prop, "number"))
        .when(kind == "date", F.coalesce(_field(prop, "date.start"), blank))
        .when(kind == "select", F.coalesce(_field(prop, "select.name"), blank))
        .when(kind == "status", F.coalesce(_field(prop, "status.name"), blank))
        .when(kind == "multi_select", _names(prop, "multi_select"))
        .when(kind == "people", _names(prop, "people"))
        .when(kind == "checkbox", F.coalesce(_field(prop, "checkbox"), F.lit("false")))
        .when(kind == "url", F.coalesce(_field(prop, "url"), blank))
        .when(kind == "email", F.coalesce(_field(prop, "email"), blank))
        .when(kind == "phone_number", F.coalesce(_field(prop, "phone_number"), blank))
        .when(kind == "formula", F.coalesce(F.element_at(F.from_json(_field(prop, "formula"), "map<string,string>"), formula), blank))
        .when(kind == "rollup", F.coalesce(_field(prop, "rollup"), blank))
        .otherwise(F.coalesce(F.element_at(F.from_json(prop, "map<string,string>"), kind), blank))
    )


def properties(json: Column) -> Column:
    """A page's properties as map<string,string> of JSON."""
    return F.from_json(json, "map<string,string>")


def plain_properties(props: Column) -> Column:
    return F.transform_values(props, lambda k, v: property_value(v))


def by_alias(props: Column, field: str) -> Column:
    """The value of the first alias of the field, in order of priority, that a property has; null if none."""
    named = F.transform(F.map_entries(props), lambda e: F.struct(normal_key(e["key"]).alias("key"), e["value"].alias("value")))
    first = lambda own, alias: F.get(F.filter(own, lambda e: e["key"] == alias), F.lit(0))["value"]
    return property_value(_let(named, lambda own: F.coalesce(*(first(own, a) for a in ALIASES[field]))))


def title(props: Column) -> Column:
    """The first property of type title."""
    found = F.get(F.filter(F.map_values(props), lambda v: _field(v, "type") == "title"), F.lit(0))
    return F.coalesce(F.nullif(property_value(found), F.lit("")), F.lit(NO_TITLE))


def page_metadata(page: Column, hash_property: str = "Content Hash") -> dict[str, Column]:
    """Columns of a page (JSON): ids, title, fields by alias, edit time, remote hash and the plain properties as JSON."""
    props = properties(_field(page, "properties"))
    done = by_alias(props, "is_summary_done")
    return (
        {"source_type": F.lit("notion"), "page_id": F.coalesce(_field(page, "id"), F.lit("")), "title": title(props)}
        | {f: by_alias(props, f) for f in ("week", "date", "module", "lecturer", "label")}
        | {
            "is_summary_done": F.coalesce(~done.isin("", "false", "0"), F.lit(False)),
            "notion_url": F.coalesce(_field(page, "url"), F.lit("")),
            "last_edited_time": F.coalesce(_field(page, "last_edited_time"), F.lit("")),
            "remote_content_hash": F.trim(F.coalesce(property_value(F.element_at(props, hash_property)), F.lit(""))),
            "raw_properties_json": F.to_json(plain_properties(props)),
        }
    )


def metadata_text(**columns: Column) -> Column:
    """The searchable lines of a page's metadata."""
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(columns[c].cast("string"), F.lit(""))) for name, c in DOCUMENT_LINES]
    done = F.concat(F.lit(f"{SUMMARY_LINE}: "), F.initcap(F.coalesce(columns["is_summary_done"].cast("string"), F.lit("none"))))
    return F.concat_ws("\n", *lines, done)


def worth_indexing(**columns: Column) -> Column:
    """Whether the metadata says something: a real title and at least one useful field."""
    clean = {c: F.lower(F.trim(F.coalesce(columns[c].cast("string"), F.lit("")))) for c in USEFUL}
    some = F.lit(False)
    for c in USEFUL:
        some = some | (clean[c] != "")
    return ~clean["title"].isin(*EMPTY_TITLES) & some


def sanitized(value: Column, kind: str) -> Column:
    """A metadata value as a scalar: null as "", lists joined by commas, maps and structs as JSON, numbers and booleans as they are."""
    if kind.startswith("array"):
        return F.coalesce(F.array_join(value.cast("array<string>"), ", "), F.lit(""))
    if kind.startswith(("map", "struct")):
        return F.coalesce(F.to_json(value), F.lit(""))
    return F.coalesce(value, F.lit("")) if kind == "string" else value


def content_hash(*parts: Column) -> Column:
    """SHA-256 over the parts in order; a null differs from an empty text."""
    marked = [F.when(p.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), p.cast("string"))) for p in parts]
    return F.sha2(F.concat_ws("\x1f", *marked), 256)


# What of a lesson's and of a unit's metadata counts for the lesson's hash.
LESSON_KEYS = ("title", "week", "date", "module", "lecturer", "label", "is_summary_done", "notion_url")
UNIT_KEYS = ("block_id", "block_index", "block_type", "notion_block_type", "markdown_block_type", "heading_path", "code_language", "image_url", "caption", "line_index")


def lesson_hash(meta: Column, text: Column, units: Column) -> Column:
    """SHA-256 of a lesson: the listed keys of its metadata that it has, its metadata text, and its units (id, text, meta) in order.

    Hashed is compact JSON with sorted keys, so neither the order of keys nor edit times, chunk ids and the like count.
    """
    pick = lambda m, keys: F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*keys)))))
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    unit = lambda u: F.struct(s(u["id"]).alias("id"), pick(u["meta"], UNIT_KEYS).alias("metadata"), s(u["text"]).alias("text"))
    payload = F.struct(F.transform(units, unit).alias("content_units"), pick(meta, LESSON_KEYS).alias("metadata"), s(text).alias("metadata_document_text"))
    return F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256)


def source_label(source_type: Column, file: Column, page: Column, title_: Column, chunk: Column) -> Column:
    """How a source is named in a prompt's context."""
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return (
        F.when(source_type == "pdf", F.concat(F.lit("PDF: "), s(file), F.lit(", page "), s(page), F.lit(", chunk "), s(chunk)))
        .when(source_type == "notion", F.concat(F.lit("Notion: "), s(title_), F.lit(", chunk "), s(chunk)))
        .otherwise(F.concat(F.lit("Source: "), F.coalesce(source_type, F.lit("unknown"))))
    )


def source_title(source_type: Column, file: Column, page: Column, title_: Column, heading: Column, key: Column) -> Column:
    """How a source is named in a report."""
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return (
        F.when(source_type == "pdf", F.concat(F.lit("PDF:"), s(file), F.lit(":page="), s(page), F.lit(":id="), s(key)))
        .when(source_type == "notion", F.concat(F.lit("Notion:"), s(title_), F.lit(":heading="), s(heading), F.lit(":id="), s(key)))
        .otherwise(s(key))
    )
