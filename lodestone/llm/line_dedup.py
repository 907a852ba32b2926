"""Line dedup: lines that stand on too large a share of a site's pages are site furniture, and go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lines, materialize, normal_line, small_enough

#: A line goes if more than this share of its host's pages, and more than MIN_PAGES pages, hold it.
RATIO, MIN_PAGES = 0.10, 10

#: Up to so many (host, line) pairs are sent to every executor; beyond it the join shuffles, and the pages of a host go in
#: parts of about so many.
BROADCAST_ROWS, HOST_PAGES = 100_000, 100_000


def frequent_lines(docs: DataFrame, ratio: float, min_pages: int, *, text: str = "text", host: str = "source") -> DataFrame:
    """(_host, _bad array of line hashes, _pages): the normalised lines above the limits on each host, and its pages.

    Pages of a host are its distinct texts, so exact copies of a page count once. A null host is a host of its own.
    """
    pages = (
        docs.select(F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("")).alias("_host"), F.col(text).alias("_text"))
        .where(F.col("_text").isNotNull())
        .withColumns({"_key": F.xxhash64("_text"), "_len": F.length("_text")})
        .withColumn("_lines", F.array_distinct(F.transform(F.array_remove(F.transform(lines(F.col("_text")), normal_line), ""), lambda x: F.xxhash64(x))))
    )
    # One row for each page and line, then copies of a page fall together before anything is counted.
    held = pages.select("_host", "_key", "_len", F.explode("_lines").alias("_line")).groupBy("_host", "_line", "_key", "_len").agg(F.lit(1).alias("_one"))
    counts = held.groupBy("_host", "_line").agg(F.count("_one").alias("_n"))
    totals = pages.select("_host", "_key", "_len").groupBy("_host", "_key", "_len").agg(F.lit(1).alias("_one")).groupBy("_host").agg(F.count("_one").alias("_pages"))
    over = counts.where(F.col("_n") > min_pages).join(totals, "_host").where(F.col("_n") > F.lit(ratio) * F.col("_pages"))
    return over.groupBy("_host").agg(F.sort_array(F.collect_list("_line")).alias("_bad"), F.first("_pages").alias("_pages"))


def with_frequent_lines(docs: DataFrame, bad: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """docs with the column _bad: the hashes of its host's frequent lines, or an empty array."""
    bad = materialize(bad, "lines")
    keyed = docs.drop("_bad").withColumn("_host", F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("")))
    if small_enough(bad.select(F.explode("_bad")), BROADCAST_ROWS):
        found = keyed.join(F.broadcast(bad.drop("_pages")), "_host", "left")
    else:
        parts = bad.select("_host", F.ceil(F.col("_pages") / HOST_PAGES).cast("bigint").alias("_parts"))
        large = parts.where("_parts > 1")
        if small_enough(large, BROADCAST_ROWS):  # there are as many as HOST_PAGES goes into all pages, at most
            large = F.broadcast(large)
        dealt = bad.drop("_pages").join(parts, "_host").select("_host", "_bad", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_part"))
        keyed = keyed.join(large, "_host", "left").withColumn("_part", F.pmod(F.xxhash64(text, F.spark_partition_id()), F.coalesce("_parts", F.lit(1))).cast("bigint"))
        found = keyed.join(dealt, ["_host", "_part"], "left").drop("_part", "_parts")
    return found.withColumn("_bad", F.coalesce("_bad", F.array().cast("array<bigint>"))).drop("_host")


def drop_lines(docs: DataFrame, *, ratio: float = RATIO, min_pages: int = MIN_PAGES, text: str = "text", host: str = "source") -> DataFrame:
    """docs with boilerplate lines removed from the text, and n_lines, n_dropped (long).

    For each host, the share of its pages that hold a line (normalised: lower case, white space collapsed) is
    measured over all its distinct texts; lines above the ratio and above min_pages pages are dropped
    wherever they stand on that host. Other lines stay byte for byte, blank ones too.
    A null text stays null with 0 lines; an empty text has one blank line; a null host is a host of its own;
    repeated rows are copies of a page and count once; other columns pass through.
    """
    bad = frequent_lines(docs, ratio, min_pages, text=text, host=host)
    own = with_frequent_lines(docs.withColumn("_lines", lines(F.col(text))), bad, host, text)
    kept = F.when(F.size("_bad") == 0, F.col("_lines")).otherwise(F.filter("_lines", lambda x: ~F.array_contains("_bad", F.xxhash64(normal_line(x)))))
    return (
        own.withColumn("_kept", kept)
        .withColumns({"n_lines": F.size("_lines").cast("long"), "n_dropped": (F.size("_lines") - F.size("_kept")).cast("long"), text: F.when(F.col(text).isNotNull(), F.array_join("_kept", "\n"))})
        .drop("_lines", "_kept", "_bad")
    )
