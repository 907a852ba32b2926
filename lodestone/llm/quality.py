"""Quality rules: rules on one text, then cross-document line frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lines, normal_line, words
from .line_dedup import frequent_lines, with_frequent_lines

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

#: A line above this share of its host's documents, and in more than MIN_DOCS of them, is removed ...
RATIO, MIN_DOCS = 0.10, 10
#: ... and a document left with less than this percentage of its words is rejected.
MIN_LEFT_PERCENT = 50

SYMBOLS = "[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]+"


def quality_rules(docs: DataFrame, *, ratio: float = RATIO, min_docs: int = MIN_DOCS, min_left_percent: int = MIN_LEFT_PERCENT, text: str = "text", host: str = "source") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_left_words (long), base_failed and kept.

    The rules on one text: too few words, or too many of them inside WINDOW-word windows that the text holds twice.
    Across documents: normalised lines are hashed, the distinct documents that hold each are counted per host,
    lines above the limits are removed, and a document depleted by that is rejected.
    A null text has no words and fails; copies of a text count as one document; a null host is a host of its own;
    other columns pass through.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.withColumns({"_words": words(F.col(text)), "_lines": lines(F.col(text))})
    base = base.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            "_seen": F.transform("_words", lambda w: F.xxhash64(w)),
            "_full": F.filter("_lines", lambda x: x.rlike(WORD)),
            "_norm": F.transform("_lines", lambda x: F.xxhash64(normal_line(x))),
            "_count": F.transform("_lines", lambda x: F.regexp_count(x, F.lit(WORD))),
        }
    ).drop("_words", "_lines")
    base = base.withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long")).drop("_full")
    # Hashes of windows of 2, 4 and 8 words, each from two of the size before.
    for step in (1, 2, 4):
        n = F.greatest(F.size("_seen") - step, F.lit(0))
        base = base.withColumn("_seen", F.zip_with(F.slice("_seen", F.lit(1), n), F.slice("_seen", F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b)))
    # Only texts that repeat a window pay for the sort that finds where.
    base = base.withColumn("_sorted", F.when(F.size(F.array_distinct("_seen")) < F.size("_seen"), F.array_sort(F.transform("_seen", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    base = base.withColumn(
        "_again",
        F.when(
            F.col("_sorted").isNotNull() & (F.size("_sorted") > 0),
            F.array_sort(
                F.transform(
                    F.filter(
                        F.transform("_sorted", lambda x, k: F.struct(x["i"].alias("i"), (((k > 0) & (x["h"] == F.get("_sorted", k - 1)["h"])) | ((k < F.size("_sorted") - 1) & (x["h"] == F.get("_sorted", k + 1)["h"]))).alias("twice"))),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        ),
    ).drop("_seen", "_sorted")
    covered = F.aggregate("_again", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")), lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), x - a["last"])).alias("sum")))["sum"]
    # An expression that is not deterministic keeps filters on the results from being pushed below, where each of the
    # nested arrays would be written out many times.
    base = base.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, F.coalesce(covered, F.lit(0)).cast("long"))).drop("_again")
    base = base.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))

    found = with_frequent_lines(base, frequent_lines(docs, ratio, min_docs, text=text, host=host), host, text)
    gone = F.when(F.size("_bad") == 0, 0).otherwise(F.aggregate(F.zip_with("_norm", "_count", lambda h, n: F.when(F.array_contains("_bad", h), n).otherwise(0)), F.lit(0), lambda a, n: a + n))
    return (
        found.withColumn("n_left_words", F.col("n_words") - gone.cast("long"))
        .withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_left_words") >= min_left_percent * F.col("n_words")))
        .drop("_norm", "_count", "_bad")
    )
