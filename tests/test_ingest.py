"""Raw payloads, pages and the throttle on small inputs."""

import itertools

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import pages as P
from tidemark.sources import vendors as V
from tidemark.streaming import changes as ST

HTML = '<html><head><title>T</title><script>x<b</script></head><body><nav><a href="/n">nav</a></nav><p> One\n<b>two</b></p><a href="/j/1"> Job  <i>A</i></a><a href="mailto:x@y">m</a><a href="/e"> </a>&amp; end<svg/></body></html>'


def test_pages(spark):
    pages = spark.createDataFrame([(1, "https://a.example/x", HTML), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.linked_text) for r in P.page_texts(pages).collect()}
    assert got[1] == ("T\nOne\ntwo\nJob\nA\nm\n& end", "T\nOne\ntwo\n[Job A](https://a.example/j/1)\nm\n& end") and got[2] == ("", "")
    assert [tuple(r) for r in P.extract_links(pages).collect()] == [(1, 0, "Job A", "https://a.example/j/1")]


def test_large_batches_of_pages_are_cut(spark):
    """A batch is parsed a few megabytes at a time, and one long page alone; nulls weigh nothing."""
    html = ["<p>" + "x" * (P.HELD // 4) + "</p>"] * 9 + [None] * 5 + ["<p>" + "y" * (2 * P.HELD) + "</p>", HTML]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(len(html))), "html": html})
    cut = [b["page_id"].to_pylist() for b in P._few([batch, batch.slice(0, 0)])]
    assert sum(cut, []) == list(range(len(html))) and max(map(len, cut)) < 9 and [14] in cut
    pages = spark.createDataFrame([(i, "https://a.example/x", h) for i, h in enumerate(html)], "page_id int, url string, html string").coalesce(1)
    got = {r.page_id: r.text for r in P.page_texts(pages).collect()}
    assert [len(got[i]) for i in range(15)] == [P.HELD // 4] * 9 + [0] * 5 + [2 * P.HELD] and got[15] == "T\nOne\ntwo\nJob\nA\nm\n& end"
    assert P.extract_links(pages).count() == 1 and P.article_texts(pages).count() == len(html)


def test_every_link_of_a_page_counts(spark):
    """A list of links is read to its end, with links that are not usable among them."""
    html = "".join(f'<li><a href="/j/{i}">Job <b>{i}</b></a> in City {i}<a href="#top">top</a></li>' for i in range(2_000))
    pages = spark.createDataFrame([(1, "https://a.example/x", html)], "page_id long, url string, html string")
    want = [(i, f"Job {i}", f"https://a.example/j/{i}") for i in range(2_000)]
    linked = P.page_texts(pages).first().linked_text.split("\n")
    # an address that is only a fragment is absolute by then
    assert [x for x in linked if "/j/" in x] == [f"[{label}]({href})" for _, label, href in want]
    assert [(r.label, r.href) for r in P.extract_links(pages).collect() if "/j/" in r.href] == [x[1:] for x in want]


def test_malformed_addresses_are_no_links(spark):
    html = '<a href="/a">A</a>' * 401 + '<a href="http://[x">B</a><a href="/c">C</a>'
    pages = spark.createDataFrame([(1, "https://a.example/x", html), (2, "http://[y", '<a href="/d">D</a>')], "page_id long, url string, html string")
    got = {r.page_id: r.linked_text.split("\n") for r in P.page_texts(pages).collect()}
    assert got[1][-2:] == ["B", "[C](https://a.example/c)"] and len(got[1]) == 403 and got[2] == ["D"]
    assert P.extract_links(pages).count() == 402


def test_url_policy(spark):
    want = {"http://8.8.8.8/a#b": "ok", "http://127.0.0.1": "address", "http://999.1.1.1": "address", "http://[::1]/": "address", "http://[2001:4860::1]/": "ok", "http://[::ffff:10.0.0.1]/": "address", "http://metadata.goog/": "blocked", "https://x.internal./": "private", "http://localhost:80": "private", "ftp://a": "scheme", "http:///a": "host", "": "empty", "//a": "scheme"}
    df = spark.createDataFrame([(u,) for u in [*want, None]], "u string")
    assert {r.u: r.reason for r in P.url_policy(df, "u").collect()} == want | {None: "empty"}


def test_feed_entries(spark):
    df = spark.createDataFrame([(1, "u", '[{"title":"a","link":"l"},3,{"body":"b"}]'), (2, "u", "<p>"), (3, "u", "{}"), (4, "u", "[]"), (5, "u", None)], "id long, url string, p string")
    got = sorted(tuple(r) for r in V.explode_feed_entries(df, "url", "p").select("id", "pos", "title", "link", F.coalesce("body", F.lit("-"))).fillna("-").collect())
    assert got == [(1, 0, "a", "l", "-"), (1, 1, "-", "-", "b"), (2, 0, "", "u", "<p>"), (3, 0, "", "u", "{}"), (5, 0, "", "u", "-")]


def test_text(spark):
    raw = "  a \t\u00a0b \r\n\r\n\r\n\r\n c\rd \n"
    assert spark.range(1).select(T.normalize_document_text(F.lit(raw))).first()[0] == "a b\n\nc\nd"
    answers = ['```json\n{"a": 1}\n```', 'so {"a": {"b": 2}} end', "[1]", "none", "} {", '{"a": ', None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    assert [r[0] for r in df.orderBy("i").select(F.to_json(T.parse_model_json(F.col("a")))).collect()] == ['{"a":1}', '{"a":{"b":2}}', None, None, None, None, None]


def test_throttle(spark):
    rows = [(i, i % 3, (i * i * 7) % 101) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want = {}
    for _, of_key in itertools.groupby(sorted(rows, key=lambda r: (r[1], r[2], r[0])), key=lambda r: r[1]):
        last = None
        for i, _, s in of_key:
            want[i] = last is None or s - last >= 5
            last = s if want[i] else last
    assert {r.id: r.allowed for r in ST.throttle(df, "k", "ts", "id").collect()} == want
