"""Slugs, declared entities, XML feeds and articles on small inputs."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.operators import naming as G
from tidemark.operators import pages as P
from tidemark.sources import entities as N
from tidemark.sources import feeds as V


def one_by_one(names, stored):
    used, out = set(stored), {}
    for i, name in sorted(names):
        base = re.sub("[^a-z0-9]+", "-", unicodedata.normalize("NFKD", name or "").encode("ascii", "ignore").decode().lower()).strip("-") or "company"
        slug, n = base, 1
        while slug in used:
            n += 1
            slug = f"{base}-{n}"
        used.add(slug)
        out[i] = slug
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_unique_slugs(spark, monkeypatch, seed):
    monkeypatch.setattr(G, "STRETCH", 16)
    rng = random.Random(seed)
    names = [(i, rng.choice(["a", "A", "a 2", "a-2", "a-2-2", "a 3", "Café Zoë", "cafe zoe", "cafe zoe 2", "", None, "!!", "company", "company 2", "日本"])) for i in range(90)]
    stored = ["a-1", "a-4", "cafe-zoe", "company-3", "a-2-3"]
    got = {r.id: r.slug for r in G.unique_slugs(spark.createDataFrame(names, "id long, name string").repartition(3), spark.createDataFrame([(s,) for s in stored], "slug string")).collect()}
    assert got == one_by_one(names, stored) and len(set(got.values())) == 90


def test_unique_slugs_simple(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2")], "id long, name string")
    assert {r.id: r.slug for r in G.unique_slugs(rows).collect()} == {1: "a", 2: "a-2", 3: "a-2-2"}
    assert G.unique_slugs(rows.limit(0)).collect() == []


def test_conform(spark):
    schema = N.StructType.fromDDL("id bigint NOT NULL, name string, score double, tags array<string>, at timestamp")
    raw = spark.createDataFrame([("1", "a", "0.5", ["x"], 7), ("x", None, "y", None, 7), (None, "b", None, None, None)], "id string, name string, score string, tags array<string>, more int")
    kept, refused = N.conform(raw, schema)
    assert [tuple(r) for r in kept.collect()] == [(1, "a", 0.5, ["x"], None)] and [f.name for f in kept.schema] == ["id", "name", "score", "tags", "at"]
    assert sorted(tuple(r.reasons) for r in refused.collect()) == [("id: bigint", "score: double"), ("id: null",)]
    assert {r.reason: r.n for r in N.refusals(refused).collect()} == {"id: bigint": 1, "score: double": 1, "id: null": 1}
    assert all(N.declared(name).fields for name in N.ENTITIES)


def test_read_entity(spark, tmp_path):
    spark.createDataFrame([(1, 2, "news_site", "2024-01-01 00:00:00", "u", "t"), (None, 2, "x", "soon", None, None)], "source_id long, company_id long, source_type string, fetched_at string, url string, text string").write.parquet(str(tmp_path / "f"))
    kept, refused = N.read_entity(spark, str(tmp_path / "f"), "fetches")
    assert kept.count() == 1 and refused.first().reasons == ["source_id: null", "fetched_at: timestamp"]
    (tmp_path / "c.csv").write_text("company_id,scored_at,momentum_score,momentum_label\n1,2024-01-01,5.5,low\n1,2024-01-01,,low\n")
    kept, refused = N.read_entity(spark, str(tmp_path / "c.csv"), "scores", "csv")
    assert kept.first().momentum_score == 5.5 and refused.count() == 1


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="c" xmlns:dc="d"><channel><title>f</title><item><title> A &amp; b </title><link> http://a </link><pubDate>Tue, 02 Jan 2024 10:00:00 EST</pubDate><description>s</description>
<content:encoded><![CDATA[<p>long <b>x</b></p><script>no</script>]]></content:encoded></item><item><dc:date>2024-01-03T00:00:00Z</dc:date><description>&lt;i&gt;d2&lt;/i&gt;</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title type="html">E1</title><link href="http://x" rel="self"/><link href="http://e1" rel="alternate"/><published>soon</published><updated>2024-01-05T01:00:00+02:00</updated><summary>sum</summary></entry>
<entry><link href="http://e2" rel="enclosure"/><content type="html">c</content><summary>no</summary></entry></feed>"""
RDF = '<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel><title>f</title></channel><item><title>R</title><link>http://r</link></item></rdf:RDF>'


def test_feeds(spark, tmp_path):
    for name, xml in (("a", RSS), ("b", ATOM), ("c", RDF), ("d", "<broken"), ("e", "plain"), ("f", "")):
        (tmp_path / f"{name}.xml").write_text(xml)
    rows = V.read_feeds(spark, str(tmp_path)).withColumn("at", F.date_format("published_at", "yyyy-MM-dd HH:mm"))
    got = sorted((r.feed[-5], r.pos, r.title, r.link or "-", r.at or "-", r.body) for r in rows.collect())
    assert got == [
        ("a", 0, "A & b", "http://a", "2024-01-02 15:00", "long \nx"[:5].strip() + "\nx"), ("a", 1, "", "-", "2024-01-03 00:00", "d2"),
        ("b", 0, "E1", "http://e1", "2024-01-04 23:00", "sum"), ("b", 1, "", "http://e2", "-", "c"), ("c", 0, "R", "http://r", "-", ""),
    ]


def test_feed_cap_and_nulls(spark):
    many = "<rss><channel>" + "".join(f"<item><title>{i}</title></item>" for i in range(40)) + "</channel></rss>"
    df = spark.createDataFrame([(1, many), (2, None)], "id long, x string")
    assert [r.title for r in V.parse_feeds(df, "x").orderBy("pos").collect()] == [str(i) for i in range(25)]


WORDS = "word " * 20


def test_article(spark):
    nav = "".join(f'<li><a href="/{i}">careers page {i}</a></li>' for i in range(30))
    html = f'<html><title>t</title><body><nav>menu</nav><div>{nav}</div><div class="ad">buy now</div><h1>Heading</h1><p>{WORDS}one<p>{WORDS}<a href="/x">link</a> two</p><div><a href="/y">{WORDS}</a></div><p>{WORDS}three</p><p>bye</p></body></html>'
    got = P.article(html)
    assert got.split("\n") == ["Heading", WORDS + "one", WORDS + "link two", WORDS + "three"]
    short = "<body><p>hello</p><ul><li><a href='/a'>all</a></li></ul></body>"
    assert P.article(short) == "hello\nall" and P.article(None) == "" and P.article("<p>" + WORDS + "<script>x</script>") == WORDS.strip()
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert {r.page_id: r.text for r in P.article_texts(pages).collect()} == {1: got, 2: ""}
