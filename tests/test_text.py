import math

from pyspark.sql import functions as F

from lodestone.functions import metadata, tables, text


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if not isinstance(values[n], list) else 'array<string>'}" for n in names)).select(column.alias("x")).first().x


def test_tokens_keep_accents_and_add_plain_twins(spark):
    assert one(spark, text.tokens(F.col("t")), t="Phở bò, c++ v1.2 Über_x đá.") == ["phở", "pho", "bò", "bo", "c++", "v1.2", "über_x", "uber_x", "đá", "đa"]
    assert one(spark, text.tokens(F.col("t")), t=None) == []
    assert one(spark, text.tokens(F.col("t")), t="... ()") == []


def test_folding_leaves_letters_without_decomposition(spark):
    assert one(spark, text.fold_accents(F.col("t")), t="ĐƯỜNG Straße Ñandú") == "đuong straße nandu"


def test_fingerprint_and_similarity(spark):
    assert one(spark, text.fingerprint(F.col("t")), t="  A\n\tb ") == "a b"
    assert len(one(spark, text.fingerprint(F.col("t")), t="x" * 900)) == 500
    assert one(spark, text.jaccard(F.col("a"), F.col("b")), a=["a", "b"], b=["b", "c"]) == 1 / 3
    assert one(spark, text.jaccard(F.col("a"), F.col("b")), a=[], b=["b"]) == 0
    assert one(spark, text.overlap(F.col("a"), F.col("b")), a=["a", "b"], b=["b"]) == 0.5


def test_hard_split(spark):
    split = lambda t, n, o: one(spark, text.hard_split(F.col("t"), n, o), t=t)
    assert split("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert split("abc", 4, 1) == ["abc"] and split("", 4, 1) == []


def test_sentences_and_paragraphs(spark):
    assert one(spark, text.sentences(F.col("t")), t="One. Two!  Three? x") == ["One.", "Two!", "Three?", "x"]
    assert one(spark, text.paragraphs(F.col("t")), t="a\r\n b\n\n \n\nc") == ["a\nb", "c"]


def test_previews_and_markdown(spark):
    assert one(spark, text.preview(F.col("t"), 8), t="one two three") == "one t..."
    assert one(spark, text.cut_preview(F.col("t"), 5), t="a\nbcdefg") == "a bcd"
    assert one(spark, text.escape_markdown(F.col("t")), t="a|b\nc") == "a\\|b c"
    assert one(spark, text.redact(F.col("t"), ("s3cret",), 20), t="key s3cret\nfailed") == "key <redacted> faile"


def test_distance_score(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (-2.0,), (None,), (math.nan,)], "d double").select(text.distance_to_score(F.col("d")).alias("s")).collect()
    assert [r.s for r in rows] == [1.0, 0.5, 1.0, 0.0, 0.0]


def test_metric_summary_skips_what_is_not_finite(spark):
    df = spark.createDataFrame([({"a": 0.5, "b": math.nan},), (None,)], "m map<string,double>").select(text.metric_summary(F.col("m")).alias("s"))
    assert [r.s for r in df.collect()] == ["a=0.500", "not run"]


def test_iso_times(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00+00:00",), ("soon",), (None,)], "t string").select(text.parse_iso(F.col("t")).cast("long").alias("t"))
    assert [r.t for r in df.collect()] == [1704067200, 1704067200, None, None]


def test_markdown_table(spark):
    rows = spark.createDataFrame([([["a", "b|c"], ["", None], ["d"]],), ([["", ""]],)], "r array<array<string>>").select(tables.markdown_table(F.col("r")).alias("m")).collect()
    assert [r.m for r in rows] == ["| a | b\\|c |\n| --- | --- |\n| d |  |", ""]


PAGE = """{"id": "p1", "url": "u", "last_edited_time": "t", "properties": {
 "Name": {"type": "title", "title": [{"plain_text": "Lesson"}, {"text": {"content": "One"}}]}, "Tuần": {"type": "number", "number": 3},
 "Ngày học": {"type": "date", "date": {"start": "2024-01-02"}}, "Tags": {"type": "multi_select", "multi_select": [{"name": "a"}, {"name": "b"}]},
 "Tổng hợp": {"type": "checkbox", "checkbox": true}, "Content Hash": {"type": "rich_text", "rich_text": [{"plain_text": " h1 "}]},
 "F": {"type": "formula", "formula": {"type": "number", "number": 7}}}}"""


def test_page_metadata_by_alias(spark):
    row = spark.createDataFrame([(PAGE,)], "page string").select(*(c.alias(n) for n, c in metadata.page_metadata(F.col("page")).items())).first()
    assert (row.page_id, row.title, row.week, row.date, row.label, row.is_summary_done, row.remote_content_hash) == ("p1", "Lesson One", "3", "2024-01-02", "a, b", True, "h1")
    assert '"F":"7"' in row.raw_properties_json


def test_empty_titles_are_not_worth_indexing(spark):
    df = spark.createDataFrame([(" EMPTY ",), ("  ",), ("Week one",)], "title string")
    none = F.lit(None).cast("string")
    got = df.select(metadata.worth_indexing(title=F.col("title"), week=none, date=none, module=none, lecturer=none, label=F.lit("x")).alias("w")).collect()
    assert [r.w for r in got] == [False, False, True]


def test_content_hash_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "a string, b string").select(metadata.content_hash(F.col("a"), F.col("b")).alias("h")).collect()
    assert df[0].h == df[2].h != df[1].h
