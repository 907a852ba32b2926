"""I-Match fingerprints of documents, with lexicons drawn at random from a band of document frequencies.

A document's terms are its distinct words within a chosen band of inverse document frequency. The band is dealt into SLOTS lexicons
by a hash, and each of them is thinned by halves; a document takes the thinning at which a lexicon holds about one of its
terms, and the next one. Of each lexicon it keeps a hash of the sorted terms that it shares with it. Two fingerprints are as
like as the share of equal hashes among the lexicons that either document has terms of.

All of it is Column expressions. Texts are shuffled once, by ranges of ids, and what follows keeps to that dealing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small_enough

#: The band: a term of the lexicon is in a document of COMMON at most and of RARE at least; so there are at most RARE times the mean number of a document's terms.
COMMON, RARE = 20, 2_000
#: Lexicons, and terms of a document (in the band or not) in all of them together, before the next thinning.
SLOTS, LOAD, THINNINGS = 64, 64, 20
#: Ranges of ids that texts are dealt by, and lexicon terms that are sent to every executor; more go by a shuffled join.
PARTS, BROADCAST_TERMS = 2_048, 2_000_000

# What separates words.
BETWEEN = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Distinct words of a text in lower case: runs of letters and digits."""
    return F.filter(F.array_distinct(F.split(F.lower(text), BETWEEN)), lambda t: t != "")


def lexicon(docs: DataFrame) -> DataFrame:
    """(term) of the words within the band, by the frequencies in all rows of docs(text)."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counts.where((F.col("df") * COMMON <= n) & (F.col("df") * RARE >= n)).select("term")


def _thinning(n_terms: Column) -> Column:
    """How often the lexicons are halved for a document of so many terms."""
    out = F.lit(0)
    for i in range(THINNINGS - 1):
        out = F.when(n_terms > LOAD << i, i + 1).otherwise(out) if i else F.when(n_terms > LOAD, 1).otherwise(0)
    return out


def _limit(thinning: Column) -> Column:
    """What the first eight digits of a term's hash stay below, if the term is left at a thinning."""
    # Of no thinning: g is behind every digit.
    return F.when(thinning == 0, "g").otherwise(F.lpad(F.lower(F.hex(F.floor(F.lit(1 << 32) / F.pow(F.lit(2.0), thinning)).cast("long"))), 8, "0"))


def _entries(drawn: Column, thinning: Column) -> Column:
    """Thinning, lexicon and hash of the sorted terms, ten digits, for each lexicon of which drawn, in order, has terms."""
    own = lambda k: F.array_join(F.transform(F.filter(drawn, lambda x: x["slot"] == k), lambda x: x["term"]), " ")
    return F.transform(F.array_distinct(F.transform(drawn, lambda x: x["slot"])), lambda k: F.concat(F.lpad(F.hex(thinning.cast("long")), 2, "0"), k, F.substring(F.md5(own(k)), 1, 6)))


def likeness(rows: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """rows with out: the share of equal hashes among the lexicons that either of two fingerprints has terms of, at the thinnings that both have; 0 if a fingerprint is null."""
    cut = lambda f: F.filter(F.split(f, "(?<=\\G.{10})"), lambda e: e != "")
    levels = lambda e: F.array_distinct(F.transform(e, lambda x: F.substring(x, 1, 2)))
    names = lambda e: F.transform(e, lambda x: F.substring(x, 1, 4))
    # A column for each step: what lambdas share would be computed anew for each element.
    rows = rows.withColumns({"_a": cut(F.col(left)), "_b": cut(F.col(right))}).withColumn("_both", F.array_intersect(levels(F.col("_a")), levels(F.col("_b"))))
    rows = rows.withColumns({c: F.filter(c, lambda x: F.array_contains("_both", F.substring(x, 1, 2))) for c in ("_a", "_b")})
    rows = rows.withColumn("_n", F.size(F.array_union(names(F.col("_a")), names(F.col("_b")))))
    return rows.withColumn(out, F.when(F.col("_n") > 0, F.size(F.array_intersect("_a", "_b")) / F.col("_n")).otherwise(0.0)).drop("_a", "_b", "_both", "_n")


def _dealt(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with part, a range of ids, and guest. The row that comes before a range is sent to it too, as a guest."""
    ends = docs.agg(F.percentile_approx("doc_id", [(i + 1) / PARTS for i in range(PARTS)], 4 * PARTS)).first()[0]
    ends = sorted(set(ends or []))  # ids of rows; each is the largest of its part
    padded = F.lit([*ends, *[(1 << 63) - 1] * (PARTS - len(ends))])
    # Bisection: how many ends are below an id.
    below = F.aggregate(F.lit([PARTS >> i for i in range(1, PARTS.bit_length())]), F.lit(0), lambda at, step: at + F.when(F.element_at(padded, at + step) < F.col("doc_id"), step).otherwise(0))
    rows = docs.withColumn("part", F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int")).otherwise(below))
    last = F.when(F.col("part") >= 0, F.element_at(padded, F.col("part") + 1) == F.col("doc_id")).otherwise(False)
    rows = rows.withColumn("guest", F.explode(F.when(last, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return rows.withColumn("part", F.when(F.col("guest"), F.pmod(F.col("part") + 1, F.lit(max(1, len(ends))))).otherwise(F.col("part")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs(doc_id, text).

    The edited text has its last third replaced by the beginning of the next document's, by falling doc_id; after the last comes
    the first, so a lone document is its own next. A null text counts as empty. A text without a word in the band has the hash
    of its whole as fingerprint. Rows of one id follow each other by text, and repeated rows are rows of their own. A row without an id
    has no next: its text is edited with nothing, and its near_next is 0. Other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    band = materialize(lexicon(docs), "lexicon")
    band = F.broadcast(band) if small_enough(band, BROADCAST_TERMS) else band
    order = Window.partitionBy("part").orderBy("guest", F.desc("doc_id"), "text")
    rows = _dealt(docs).select(
        "part", "doc_id", "guest", "text", F.length("text").alias("n"),
        F.when(F.col("doc_id").isNull(), "").otherwise(F.coalesce(F.lead("text").over(order), F.lit(""))).alias("next"), F.row_number().over(order).alias("row"),
    )
    edited = F.concat(F.expr("substring(text, 1, n - n div 3)"), F.expr("substring(next, 1, n div 3)"))
    rows = rows.select("part", "row", "doc_id", "guest", "n", "text", F.when(~F.col("guest"), edited).alias("edited")).withColumn("sha", F.sha2("edited", 256))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    each = rows.select("part", "row", "doc_id", "guest", "n", "sha", F.explode(F.filter(kinds, lambda x: x["t"].isNotNull())).alias("x")).select("*", "x.kind", F.substring(F.md5("x.t"), 1, 8).alias("whole"), terms(F.col("x.t")).alias("terms")).drop("x")
    each = each.withColumn("thinning", _thinning(F.size("terms"))).withColumn("limit", _limit(F.col("thinning")))
    drawn = F.filter(F.transform("terms", lambda t: F.struct(t.alias("term"), F.md5(t).alias("hash"))), lambda x: F.substring(x["hash"], 1, 8) < F.col("limit"))
    # All rows of a document lie in one task already, so the groups need no shuffle.
    one = each.select("part", "row", "doc_id", "guest", "n", "sha", "kind", "whole", "thinning", F.explode_outer(drawn).alias("d")).select("*", "d.term", "d.hash").drop("d")
    one = one.join(band.withColumn("known", F.lit(True)), "term", "left")
    slot = F.concat(F.substring("hash", 9, 1), F.translate(F.substring("hash", 10, 1), "0123456789abcdef", "0000111122223333"))
    item = F.when(F.col("known"), F.struct(slot.alias("slot"), "term", F.substring("hash", 1, 8).alias("digits")))
    own = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}{k}")
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, item))).alias(f"drawn{k}")
    prints = one.groupBy("part", "row").agg(*(F.max(c).alias(c) for c in ("doc_id", "guest", "n", "sha")), *(x for k in (0, 1) for x in (own(k, "whole"), own(k, "thinning"), of(k))))
    for k in (0, 1):
        drawn, thinning = F.col(f"drawn{k}"), F.col(f"thinning{k}")
        prints = prints.withColumn("_next", _limit(thinning + 1)).withColumn("_fewer", F.filter(drawn, lambda x: x["digits"] < F.col("_next")))
        joined = F.array_join(F.array_sort(F.concat(_entries(drawn, thinning), _entries(F.col("_fewer"), thinning + 1))), "")
        prints = prints.withColumn(f"f{k}", F.when(F.size(drawn) > 0, joined).otherwise(F.concat(F.lit("ff"), f"whole{k}")))
    prints = prints.select("part", "row", "doc_id", "guest", "n", "sha", "f0", "f1")
    prints = prints.withColumn("f2", F.when(F.col("doc_id").isNotNull(), F.lead("f0").over(Window.partitionBy("part").orderBy("row")))).where(~F.col("guest"))
    prints = likeness(likeness(prints, "f0", "f1", "near_edited"), "f0", "f2", "near_next")
    return prints.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), F.col("f0").alias("fingerprint"), F.col("f1").alias("edited_fingerprint"), "near_edited", "near_next")
