import base64
import gzip
import hashlib
import os
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import html_extract, queries, warc
from lodestone.llm.common import fresh_path

LONG = "Long enough a sentence, with commas, to count as a paragraph of the article."


def test_article_without_clutter():
    page = f"""<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><a href=/>Home</a></header><nav><ul><li>menu</ul></nav>
    <div class="sidebar"><p>{LONG} side</p></div><article><h1>Head &amp; more</h1><p>{LONG}<p>Second&nbsp;  block,\n{LONG}</p>
    <div class="comments"><p>{LONG} comment</p></div><form><p>{LONG} form</p></form></article><div id="cookie-notice">{LONG}</div><footer>foot</footer></body></html>"""
    assert html_extract.main_text(page) == f"Head & more\n{LONG}\nSecond block, {LONG}"


def test_best_container_by_score_keeps_siblings():
    page = f"<body><div><a href=x>{LONG}</a></div><div class=story><p>{LONG}</p><p>{LONG} two</p><ul><li><a href=1>l</a><li><a href=2>m</a></ul></div><div class=menu>x</div></body>"
    assert html_extract.main_text(page) == f"{LONG}\n{LONG} two\nl\nm"  # a list of links in what is marked as content stays
    assert html_extract.main_text(page.replace(" class=story", "")) == f"{LONG}\n{LONG} two"


def test_the_score_decides_without_and_across_articles():
    body = f"<h1>Head</h1><p>{LONG}</p><p>{LONG} two</p><ol><li><a href=1>ref one</a></li><li><a href=2>ref two</a></li></ol>"
    page = f"<body><nav><a href=x>menu</a></nav><div class=ad>buy</div><article>{body}</article><footer>foot</footer></body>"
    want = f"Head\n{LONG}\n{LONG} two\nref one\nref two"
    assert html_extract.main_text(page) == want
    assert html_extract.main_text(page.replace("article>", "div>")) == want.rpartition("\nref one")[0]
    # Of two articles the fuller one, wherever it stands.
    short = "<article><p>A teaser of some other story, of a few words</p></article>"
    assert html_extract.main_text(f"<main>{short}<article>{body}</article></main>") == want
    # Not the first article, but where the points are.
    assert html_extract.main_text(f"<body><article><p>Teaser only, a few words of it.</p></article><div>{body.replace('<ol>', '<ul>')}</div></body>").startswith(f"Head\n{LONG}")


def test_what_nothing_ends_holds_nothing():
    for tag in ("svg", "iframe", "object", "noscript", "select", "video"):
        assert html_extract.main_text(f"<article><p>{LONG}</p><{tag} x=y><p>{LONG} two</p></article>") == f"{LONG}\n{LONG} two", tag
        assert html_extract.main_text(f"<article><p>{LONG}</p><{tag}>no</{tag}><p>{LONG} two</p></article>") == f"{LONG}\n{LONG} two", tag
    assert html_extract.main_text(f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> so</p></article>") == f"{LONG} x=2 so"
    assert html_extract.main_text(f"<article><p title='{'a>b' * 60_000}'>{LONG}</p></article>") == LONG


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_pages_read_the_same_without_their_article_tags():
    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        assert html_extract.main_text(page) == html_extract.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>"))


def test_other_stories_beside_the_article_go():
    for n in (1, 3):
        teasers = f"<article><h2><a href=x>Other story</a></h2><p>{LONG[:40]}, and more</p></article>" * n
        page = f"<main><article><h1>Head</h1><p>{LONG}</p><p>{LONG} two</p></article>{teasers}</main>"
        assert html_extract.main_text(page) == f"Head\n{LONG}\n{LONG} two"
    assert html_extract.main_text("<main><article>main</article><article>teaser</article><article>teaser</article></main>") == "main"


def test_a_name_condemns_only_with_the_score():
    for name in ("side-effects", "related-work", "share-price", "search-algorithms", "social-history", "market-share"):
        page = f'<article><h1>H</h1><p>{LONG}</p><div class="{name}"><p>{LONG} in</p></div><section id="{name}"><h2>T</h2><p>{LONG} too</p></section></article>'
        assert html_extract.main_text(page) == f"H\n{LONG}\n{LONG} in\nT\n{LONG} too", name
        links = page.replace(f"<p>{LONG} in</p>", "<a href=x>one</a> <a href=y>two</a>")
        assert html_extract.main_text(links) == f"H\n{LONG}\nT\n{LONG} too", name
    for name in ("sidebar", "comments", "reader-comments", "related-posts", "share-bar", "ad", "ad-slot", "cookie-notice", "newsletter-signup", "social-links", "right-sidebar"):
        assert html_extract.main_text(f'<article><h1>H</h1><p>{LONG}</p><p>{LONG} two</p><div class="{name}"><p>{LONG} in</p></div></article>') == f"H\n{LONG}\n{LONG} two", name
    whole = "".join(f"<p>{LONG} {i}</p>" for i in range(6))
    assert html_extract.main_text(f'<body><div class="sidebar">{whole}</div><div class="ad">buy</div></body>').count("\n") == 5


def test_the_cost_of_odd_marks_is_linear():
    for page in ("<a " * 350_000, '<a "x>y" ' * 100_000, "<svg>" * 50_000 + "</svg>", "<" * 300_000, "<!--" * 100_000, "<b>" * 50_000 + "x"):
        began = time.process_time()
        html_extract.main_text(page)
        assert time.process_time() - began < 10, page[:10]
    assert html_extract.main_text(f"<article><p>{LONG}</p><svg>x<p>{LONG} two</p></article>") == f"{LONG}\n{LONG} two"


#: Pages without an article element, and their texts, by hand.
PLAIN_PAGES = [
    (f"<body><div id=top><a href=/>Home</a> <a href=/a>News</a></div><div><h1>Head</h1><p>{LONG}</p><p>{LONG} two</p></div><div id=foot>Contact us</div></body>", f"Head\n{LONG}\n{LONG} two"),
    (f"<body><table><tr><td><a href=a>x</a><br><a href=b>y</a></td><td><p>{LONG}</p><p>{LONG} two</p></td></tr></table></body>", f"{LONG}\n{LONG} two"),
    (f"<body><ul><li><a href=a>Menu one</a><li><a href=b>Menu two</a></ul><div class=text><p>{LONG}</p><blockquote>{LONG} said</blockquote><ul><li>point one<li>point two</ul></div></body>", f"{LONG}\n{LONG} said\npoint one\npoint two"),
    (f"<body><div class=post-body><p>{LONG}</p><pre>a = 1\nb = 2</pre></div><div class=comments><div><p>{LONG} I think</p></div></div></body>", f"{LONG}\na = 1 b = 2"),
    (f"<body><section><h2>Part</h2><p>{LONG}</p></section></body>", f"Part\n{LONG}"),
]


def test_pages_without_an_article_by_hand():
    for page, want in PLAIN_PAGES:
        assert html_extract.main_text(page) == want, page


def test_odd_pages():
    for page, want in ((None, ""), ("", ""), ("   ", ""), ("plain text", "plain text"), ("<p>a<b>b</b>c</p>", "abc"), ("<!-- x --><p>&#233;&lt;", "é<"), ("<a href='x>broken <p>text", "broken\ntext"), ("<script>never closed", ""), ("<p>a<br>b", "a\nb"), ("</p></div>x", "x")):
        assert html_extract.main_text(page) == want, page
    deep = "<div>" * 5000 + LONG + "</div>" * 5000
    assert html_extract.main_text(deep) == LONG
    assert len(html_extract.main_text("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>")) > 200_000


def test_extract_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "old"), (1, "u", "<p>x</p>", "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect())
    assert got == [(1, "x", 1), (1, "x", 1), (2, "", 0)]
    assert html_extract.extract(df.limit(0)).count() == 0


PAGES = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>é other</p>"), (3, None, "<p>same</p>"), (4, "http://a b\r\nX: y", None), (5, "u", ""), (6, "u", "z" * 300_000)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    path = fresh_path(spark, "test")
    warc.archive(df, path)
    got = {r.record_id: r for r in warc.read(spark, path).collect()}
    assert len(got) == 6
    for k, url, html in PAGES:
        raw = (html or "").encode()
        r = got[f"<urn:page:{k}>"]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r.target_uri == (url and " ".join(url.split()))
        last = max(j for j, _, h in PAGES if (h or "") == (html or ""))
        assert (r.record_type, r.refers_to) == (("response", None) if last == k else ("revisit", f"<urn:page:{last}>"))
        assert (r.payload is None) == (last != k) and (r.payload is None or bytes(r.payload) == raw)


def test_warc_pushes_predicates_and_splits_files(spark):
    path = fresh_path(spark, "test")
    warc.archive(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), path, step=1)
    whole = warc.read(spark, path, payloads=False)
    assert whole.where("record_type = 'revisit'").count() == 2
    assert [r.record_id for r in whole.where("record_id in ('<urn:page:2>', '<urn:page:9>') and payload_bytes > 0").collect()] == ["<urn:page:2>"]
    reader = warc.Reader(path, whole.schema, 100)
    filters = [warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 3)]
    assert list(reader.pushFilters(filters)) == filters[1:] and len(reader.partitions()) > 3
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 2
    small = spark.read.format("lodestone_warc").option("path", path).option("range_bytes", 90).load()
    assert sorted(r.record_id for r in small.select("record_id").collect()) == sorted(f"<urn:page:{k}>" for k, _, _ in PAGES)


def test_warc_least_and_empty(spark):
    path = fresh_path(spark, "test")
    warc.archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path, least=5)
    assert warc.read(spark, path).where("record_type = 'revisit'").count() == 1
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def warc_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


def test_warc_repeated_and_null_keys_keep_every_payload(spark):
    path = fresh_path(spark, "test")
    warc.archive(warc_rows(spark, (5, "u", "AAA"), (5, "u", "BBB"), (9, "u", "AAA"), (10, "u", "BBB"), (None, "u", "AAA"), (None, "u", "C")), path)
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in warc.read(spark, path).collect()), key=str)
    page = "<urn:page:{}>".format
    assert got == sorted(
        [(page(5), "revisit", page(9), None), (page(5), "revisit", page(10), None), (page(9), "response", None, b"AAA"), (page(10), "response", None, b"BBB"), (page(""), "revisit", page(9), None), (page(""), "response", None, b"C")], key=str
    )


def test_warc_headers_of_any_length_and_appended_archives(spark):
    path, url = fresh_path(spark, "test"), "http://a/" + "x" * 1_000_000
    warc.archive(warc_rows(spark, (1, url, "one")), path)
    warc.archive(warc_rows(spark, (2, "u", "two")), path)
    assert {r.record_id: len(r.target_uri) for r in warc.read(spark, path, payloads=False).collect()} == {"<urn:page:1>": len(url), "<urn:page:2>": 1}
    warc.read(spark, path).where("record_id = '<urn:page:2>'").select(*(c.split()[0] for c in warc.WRITE_SCHEMA.split(", "))).write.format("lodestone_warc").mode("overwrite").option("path", path + "x").save()
    more = warc.read(spark, path + "x").select(*(c.split()[0] for c in warc.WRITE_SCHEMA.split(", ")))
    warc.archive(warc_rows(spark, (3, "u", "three")), path + "y")
    more.write.format("lodestone_warc").mode("overwrite").option("path", path + "y").save()
    assert [(r.record_id, bytes(r.payload)) for r in warc.read(spark, path + "y").collect()] == [("<urn:page:2>", b"two")]


def test_archives_of_others(spark, tmp_path):
    def made(kind, number, block, **more):
        lines = [f"WARC/1.0\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{number}>", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items()), f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    records = [made("warcinfo", 1, b"software: x\r\n"), made("response", 2, http + b"body\r\n\r\nWARC/1.0\r\n", Content_Type="application/http; msgtype=response"), made("metadata", 3, b"z" * 700_000, Content_Type="text/plain"), made("response", 4, http, Content_Type="application/http")]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    got = warc.read(spark, str(tmp_path))
    assert got.groupBy("record_id", "record_type", "payload_bytes", "payload").count().where("count = 3").count() == 4 == got.count() / 3
    assert bytes(warc.read(spark, str(tmp_path / "b.warc.gz")).where("record_id = '<urn:uuid:2>'").first().payload) == b"body\r\n\r\nWARC/1.0\r\n"
    assert warc.read(spark, str(tmp_path), payloads=False).where("record_type = 'response'").count() == 6


def test_warc_query_reads_what_it_wrote(spark, tmp_path):
    warc_rows(spark, *PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.op7_warc(spark, str(tmp_path)).collect()}
    for k, _, html in PAGES:
        raw = (html or "").encode()
        last = max(j for j, _, h in PAGES if (h or "") == (html or ""))
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if last == k else "revisit", None if last == k else last)
        assert (got[k].payload_bytes, got[k].payload_digest, got[k].record_type, got[k].refers_to) == want
