import pytest
from pyspark.sql import functions as F

from lodestone.llm import line_dedup, quality

DOCS = "doc_id long, text string, source string"


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), DOCS)


def prose(n, seed=0):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def test_line_dedup_drops_what_most_pages_of_a_host_hold(spark):
    rows = [(i, f"Menu  HERE\nown {i}\n\ntail {i}", "a") for i in range(20)] + [(100 + i, f"menu here\nother {i}", "b") for i in range(3)]
    got = {r.doc_id: r for r in line_dedup.drop_lines(docs(spark, *rows), min_pages=5).collect()}
    assert got[3].text == "own 3\n\ntail 3" and (got[3].n_lines, got[3].n_dropped) == (4, 1)
    assert got[101].text == "menu here\nother 1"  # too few pages on this host


def test_line_dedup_beyond_what_is_broadcast(spark, monkeypatch):
    rows = [(i, f"menu here\nown {i}", "a" if i % 3 else None) for i in range(60)] + [(100, None, "a"), (101, "menu here", "b")]
    df = docs(spark, *rows).repartition(5)
    want = sorted(map(repr, line_dedup.drop_lines(df, min_pages=5).collect()))
    for name in ("BROADCAST_ROWS", "HOST_PAGES"):
        monkeypatch.setattr(line_dedup, name, 7 if name == "HOST_PAGES" else 0)
    assert sorted(map(repr, line_dedup.drop_lines(df, min_pages=5).collect())) == want and sum("menu" in r for r in want) == 1


def test_copies_of_a_page_count_once(spark):
    rows = [(i, "the same page\nsecond line", "a") for i in range(30)] + [(50 + i, f"page {i}", None) for i in range(30)]
    got = line_dedup.drop_lines(docs(spark, *rows), min_pages=5)
    assert got.agg(F.sum("n_dropped")).first()[0] == 0 and got.count() == 60


def test_line_dedup_edges(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "\n\n", "a"), (3, "\n\n", "a"), (4, "x" * 200_000, "a")]
    df = docs(spark, *rows).withColumns({c: F.lit(7) for c in ("_bad", "_host", "_lines", "n_lines")})
    got = sorted(((r.doc_id, r.text and len(r.text), r.n_lines) for r in line_dedup.drop_lines(df).collect()), key=str)
    assert got == [(1, None, 0), (2, "", 1), (3, 2, 3), (3, 2, 3), (4, 200_000, 1)]
    assert line_dedup.drop_lines(docs(spark)).count() == 0


def brute(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ls = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    cover = {j for i, x in enumerate(seen) if seen.count(x) > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(cover)


TEXTS = [None, "", " \n\t", "one two", prose(30), prose(7) + " " + prose(7), (prose(9) + "\n") * 4, prose(40) + " " + prose(12) + " x " + prose(12), "é#* |<x>\nü&\né#* |<x>", "a " * 300, "a\x0bb\x0cc\x1cd e f"]


@pytest.mark.parametrize("chunk", [TEXTS])
def test_quality_counts_equal_brute_force(spark, chunk):
    got = {r.doc_id: r for r in quality.quality_rules(docs(spark, *((i, t, "s") for i, t in enumerate(chunk)))).collect()}
    for i, t in enumerate(chunk):
        r = got[i]
        n, *rest = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest), t
        assert r.base_failed == (n < 20 or 100 * rest[-1] > 30 * n)
        assert r.kept == (not r.base_failed)


def test_depleted_documents_are_rejected_and_near_copies_kept(spark):
    furniture = prose(30)
    rows = [(i, furniture + f"\nrest {i}", "a") for i in range(40)] + [(100 + i, prose(60, i + 1), "a") for i in range(60)]
    rows += [(300, furniture + "\n" + prose(80, 900), "a")]
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs(spark, *rows)).collect()}
    assert not any(got[i] for i in range(40)) and all(got[100 + i] for i in range(60)) and got[300]


def test_quality_edges(spark):
    df = docs(spark, (1, prose(25), "a"), (1, prose(25), "a"), (2, prose(60_000), None)).withColumns({c: F.lit("x") for c in ("_words", "_bad", "n_words", "kept", "_seen")})
    got = quality.quality_rules(df)
    assert got.count() == 3 and got.where("kept").count() == 3
    assert quality.quality_rules(docs(spark)).count() == 0
