"""Chunking of documents and of ordered units."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ConfigError
from ..sources.scratch import materialize

# Units are chunked within equal values of these metadata keys.
SCOPE = ("source_type", "document_id", "page_id", "page_number", "source_granularity", "heading_path")
_SENTENCE, _PARAGRAPH = re.compile(r"(?<=[.!?。！？])\s+"), re.compile(r"\n\s*\n")
_GLUE = "\n\n"
#: Ordinals of a stretch whose scopes are numbered in one task.
STRETCH = 100_000


def check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ConfigError("a chunk's size must be positive and its overlap smaller than the size, not negative")


def clean(text: str | None) -> str:
    return (text or "").replace("\r\n", "\n").replace("\r", "\n").strip()


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of `size` characters; each starts size - overlap after the one before."""
    step = size - overlap
    last = max(0, -(-(len(text) - size) // step))
    return [w for i in range(last + 1) if (w := text[i * step : i * step + size].strip())]


def pieces(text: str, size: int, overlap: int) -> list[str]:
    """The text if it fits; else its paragraphs packed, else its sentences packed, else windows."""
    if len(text) <= size:
        return [text]
    parts = ["\n".join(filter(None, map(str.strip, b.splitlines()))) for b in _PARAGRAPH.split(text) if b.strip()]
    if len(parts) < 2:
        parts = [s.strip() for s in _SENTENCE.split(text) if s.strip()]
    return pack(parts, size, overlap) if len(parts) > 1 else windows(text, size, overlap)


def pack(segments: list[str], size: int, overlap: int) -> list[str]:
    """Join segments by blank lines up to the size. A full chunk's tail starts the next one if the next segment fits after it.

    A segment over the size is cut on its own, and leaves no tail.
    """
    out: list[str] = []
    held = ""
    for segment in filter(None, map(str.strip, segments)):
        if len(segment) > size:
            out += [held] if held else []
            out += pieces(segment, size, overlap)
            held = ""
        elif len(held) + (len(_GLUE) if held else 0) + len(segment) <= size:
            held = f"{held}{_GLUE}{segment}" if held else segment
        else:
            out.append(held)
            tail = held[-overlap:].strip() if overlap else ""
            fits = tail and len(tail) + len(_GLUE) + len(segment) <= size
            held = f"{tail}{_GLUE}{segment}" if fits else segment
    return [c for c in [*out, held.strip()] if c]


def oversized(text: str, kind: str, size: int, overlap: int) -> list[str]:
    """Parts of a unit that is too long: code and tables by lines, equations and images by windows, the rest as text."""
    if kind in ("code", "table"):
        return pack(text.splitlines(), size, overlap)
    return windows(text, size, overlap) if kind in ("equation", "image") else pieces(text, size, overlap)


def simple(text: str, size: int, overlap: int) -> list[str]:
    """The plain chunker: lines packed up to the size, the raw tail of a chunk before the next one; a long line stays whole."""
    out, held = [], ""
    for line in filter(None, map(str.strip, text.split("\n"))):
        if len(held) + len(line) + 1 <= size:
            held += line + "\n"
        else:
            out += [held.strip()] if held else []
            held = (held[-overlap:] if overlap else "") + line + "\n"
    return [*out, held.strip()] if held.strip() else out


def chunk_documents(docs: DataFrame, size: int, overlap: int, *, mode: str = "recursive", key: str = "id", text: str = "text") -> DataFrame:
    """docs with their texts cut: chunk_id (0, 1, ... in each document), id "<parent>_chunk_<n>", parent_id; other columns stay.

    mode: recursive or simple. Documents without text have no chunks.
    """
    check(size, overlap)
    cut = simple if mode == "simple" else pieces

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [c for c in cut(clean(t), size, overlap) if c] if t and t.strip() else [])

    own = docs.select("*", F.posexplode(run(F.col(text))).alias("_n", "_chunk"))
    return own.withColumns({"parent_id": F.col(key).cast("string"), "chunk_id": F.col("_n").cast("long"), text: F.col("_chunk"), "block_types": F.lit("text")}).withColumn(key, F.format_string("%s_chunk_%d", "parent_id", "chunk_id")).drop("_n", "_chunk")


CHUNKS = "scope_first bigint, n bigint, text string, unit_ids array<string>, block_types string, block_ids string, bbox string, split_part bigint, meta map<string,string>"


def _fold(units: list[tuple[str, str, dict]], size: int, overlap: int) -> list[dict]:
    """Chunks of one scope's units, in order: (id, text, meta). Headings close a chunk and head the next ones."""
    out: list[dict] = []
    held: list[tuple[str, str, dict]] = []
    length, heading = 0, ""

    def close(parts: list[tuple[str, str, dict]], split: int | None = None) -> None:
        text = _GLUE.join(p[1] for p in parts)
        first = parts[0][2]
        top = (first.get("heading_context") or "").strip()
        if top and not text.lstrip("#").strip().startswith(top.lstrip("#").strip()):
            text = f"{top}\n{text}".strip()
        kinds = list(dict.fromkeys(p[2].get("block_type") or "text" for p in parts))
        boxes = [p[2]["bbox"] for p in parts if p[2].get("bbox")]
        ids = [p[2]["block_id"] for p in parts if p[2].get("block_id")]
        out.append({"text": text, "unit_ids": [p[0] for p in parts], "block_types": ",".join(kinds), "block_ids": ",".join(ids) or None, "bbox": (boxes[0] if len(boxes) == 1 else str(boxes)) if boxes else None, "split_part": split, "meta": first})

    for key, raw, meta in units:
        text, kind = clean(raw), meta.get("block_type") or meta.get("block_types") or "paragraph"
        if not text:
            continue
        heads = kind.startswith("heading")
        cost = length + (len(_GLUE) if held else 0) + len(text)
        if held and (heads or cost > size):
            close(held)
            held, length, cost = [], 0, len(text)
        if heads:
            heading = text.lstrip("#").strip()
            continue
        if heading and "heading_context" not in meta:
            meta = {**meta, "heading_context": heading}
        if len(text) > size:
            for i, part in enumerate(oversized(text, meta.get("block_type") or "paragraph", size, overlap)):
                close([(key, part, meta)], i)
        else:
            held.append((key, text, meta))
            length = cost
    if held:
        close(held)
    return out


def chunk_units(units: DataFrame, size: int, overlap: int, *, scope: tuple[str, ...] = SCOPE, call: str | None = None) -> DataFrame:
    """Pack ordered units(id, ordinal, text, meta) into chunks that never cross a scope.

    Returns id "<parent>_<granularity>_chunk_<n>", parent_id, chunk_id, text, unit_ids, block_types, block_ids, bbox,
    split_part and the first unit's meta. n runs over the whole call, scopes in the order of their first units; with `call`
    (a metadata key, such as a page) each of its values is a call of its own.
    A scope's units are folded in one group, so a scope should be a page or a document.
    """
    check(size, overlap)
    keys = [F.coalesce(F.col("meta").getItem(k), F.lit("")).alias(f"_s{i}") for i, k in enumerate(scope)]
    own = units.select("id", "ordinal", "text", "meta", *keys, (F.coalesce(F.col("meta").getItem(call), F.lit("")) if call else F.lit("")).alias("_call"))
    names = ["_call", *(f"_s{i}" for i in range(len(scope)))]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ordinal")
        meta = [dict(m) if m is not None else {} for m in group["meta"]]
        rows = _fold(list(zip(group["id"], group["text"], meta, strict=True)), size, overlap)
        table = pd.DataFrame(rows, columns=["text", "unit_ids", "block_types", "block_ids", "bbox", "split_part", "meta"])
        table["split_part"] = table["split_part"].astype("Int64")
        return table.assign(_call=key[0], scope_first=int(group["ordinal"].min()), n=range(len(rows)))[["_call", *(x.split()[0] for x in CHUNKS.split(", "))]]

    # Written once, as it is both counted and numbered.
    made = materialize(own.groupBy(*names).applyInPandas(run, f"_call string, {CHUNKS}"), "chunks")
    # Scopes are numbered by running sums over one row for each: within stretches of the call, whose own sums are added up first.
    counts = made.groupBy("_call", "scope_first").agg(F.count("*").alias("_m")).withColumn("_stretch", F.floor(F.col("scope_first") / STRETCH))
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    stretches = counts.groupBy("_call", "_stretch").agg(F.sum("_m").alias("_all")).withColumn("_ahead", F.coalesce(F.sum("_all").over(earlier("_call", "_stretch")), F.lit(0))).drop("_all")
    inside = counts.withColumn("_inside", F.coalesce(F.sum("_m").over(earlier("_call", "_stretch", "scope_first")), F.lit(0)))
    before = inside.join(stretches, ["_call", "_stretch"]).select("_call", "scope_first", (F.col("_inside") + F.col("_ahead")).alias("_before"))
    meta = lambda k: F.col("meta").getItem(k)
    document = F.coalesce(F.nullif(meta("document_id"), F.lit("")), F.nullif(meta("page_id"), F.lit("")), F.lit("document"))
    parent = F.coalesce(F.nullif(meta("parent_id"), F.lit("")), F.when(meta("page_number").isNotNull(), F.concat(document, F.lit("_page_"), meta("page_number"))).otherwise(document))
    out = made.join(before, ["_call", "scope_first"]).withColumns({"chunk_id": (F.col("n") + F.col("_before")).cast("long"), "parent_id": parent})
    out = out.withColumn("id", F.concat_ws("_", "parent_id", F.coalesce(meta("source_granularity"), F.lit("content")), F.lit("chunk"), F.col("chunk_id").cast("string")))
    return out.select("id", "parent_id", "chunk_id", "text", "unit_ids", "block_types", "block_ids", "bbox", "split_part", "meta")
