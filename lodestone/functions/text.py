"""Text functions as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a token; dots at its edges are cut off.
TOKEN = r"([0-9A-Za-zÀ-ỹ_+\-#.]+)"
FINGERPRINT_CHARS = 500
_OTHER = r"[^\x00-\x7F]"


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """(characters, their replacements, those that become several): what lower-casing, decomposing and dropping marks does."""
    one, gone, many = {}, [], {}
    for cp in (*range(0x80, 0x1F00), *range(0x1F00, 0x2000)):
        c = chr(cp).lower()
        if len(c) != 1:
            continue
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if bare == c:
            continue
        if not bare:
            gone.append(c)
        elif len(bare) == 1:
            one[c] = bare
        elif cp < 0xAC00:
            many[c] = bare
    return "".join(one) + "".join(dict.fromkeys(gone)), "".join(one.values()), many


def fold_accents(text: Column) -> Column:
    """Lower case without combining marks; letters that have no decomposition stay as they are."""
    source, target, many = _folding()
    low = F.lower(text)
    out = low
    for c, bare in many.items():
        out = F.replace(out, F.lit(c), F.lit(bare))
    # Most texts have none of the letters that become several.
    return F.translate(F.when(low.rlike(f"[{''.join(many)}]"), out).otherwise(low), source, target)


def raw_tokens(text: Column) -> Column:
    """Tokens of the lower-cased text in order, without accent-free twins; none for a null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))
    return F.filter(F.transform(found, lambda t: F.btrim(t, F.lit("."))), lambda t: t != "")


def tokens(text: Column) -> Column:
    """raw_tokens, each followed by its accent-free twin if that differs."""
    raw = raw_tokens(text)
    # Only tokens with other than ASCII letters are folded, and texts of ASCII letters not even looked at for them.
    both = F.flatten(F.transform(raw, lambda t: F.when(t.rlike(_OTHER), F.array_distinct(F.array(t, fold_accents(t)))).otherwise(F.array(t))))
    return F.when(text.rlike(_OTHER), both).otherwise(raw)


def fingerprint(text: Column) -> Column:
    """Lower case, white space collapsed, the first 500 characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), 1, FINGERPRINT_CHARS)


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two token arrays as sets; 0 if either is empty."""
    both = F.size(F.array_union(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.size(F.array_intersect(left, right)) / both).otherwise(F.lit(0.0))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has; 0 if the query has none."""
    n = F.size(F.array_distinct(query))
    return F.when(n > 0, F.size(F.array_intersect(query, text)) / n).otherwise(F.lit(0.0))


def normalize_newlines(text: Column) -> Column:
    """CR and CRLF as LF, trimmed; empty for a null."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), r"^\s+|\s+$", "")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, their lines trimmed and blank ones dropped."""
    block = lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != ""), "\n")
    return F.filter(F.transform(F.split(normalize_newlines(text), r"\n\s*\n"), block), lambda b: b != "")


def sentences(text: Column) -> Column:
    """Split after . ! ? and their wide forms where white space follows; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?。！？])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def hard_split(text: Column, size: int, overlap_: int = 0) -> Column:
    """Windows of `size` characters that overlap; trimmed, empty ones dropped."""
    step = size - overlap_
    n = F.length(text)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(at, lambda i: F.trim(F.substring(text, i * step + 1, F.lit(size)))), lambda x: x != "")


def preview(text: Column, limit: int) -> Column:
    """White space collapsed; a longer text is cut and ends in three dots."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.substring(clean, 1, limit - 3), F.lit("...")))


def cut_preview(text: Column, limit: int) -> Column:
    """Line feeds as spaces, cut without dots."""
    return F.substring(F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))), 1, limit)


def escape_markdown(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def redact(text: Column, secrets: tuple[str, ...], limit: int | None = 500) -> Column:
    """One line, secrets masked, cut at the limit."""
    out = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    for s in secrets:
        if s:
            out = F.replace(out, F.lit(s), F.lit("<redacted>"))
    return out if limit is None else F.substring(out, 1, limit)


def join_list(values: Column) -> Column:
    return F.coalesce(F.array_join(values, " | "), F.lit(""))


def finite(value: Column) -> Column:
    """The number, or null if it is not finite."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(sys.float_info.max)), value)


def metric_summary(metrics: Column) -> Column:
    """name=0.000 for each finite value, comma-separated; "not run" if there is none."""
    live = F.filter(F.map_entries(metrics), lambda e: finite(e["value"]).isNotNull())
    text = F.array_join(F.transform(live, lambda e: F.format_string("%s=%.3f", e["key"], e["value"])), ", ")
    return F.when(metrics.isNull() | (F.size(live) == 0), F.lit("not run")).otherwise(text)


def distance_to_score(distance: Column) -> Column:
    """1 / (1 + distance), negative distances as 0; 0 for a null or not a number."""
    d = distance.cast("double")
    return F.when(d.isNull() | F.isnan(d), F.lit(0.0)).otherwise(1 / (1 + F.greatest(d, F.lit(0.0))))


def parse_iso(text: Column) -> Column:
    """ISO time, Z as UTC; null if it cannot be read."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", "+00:00"))


def now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")


def normal_key(name: Column) -> Column:
    """A property name for comparison: folded, _ and - as spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(fold_accents(name), "_-", "  "), r"\s+", " "))
