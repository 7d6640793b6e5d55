"""Vendor payloads (JSON texts) as unified rows, in one scan and without Python but for HTML descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pages import clean_fragment

_JOB = (
    "array<struct<id string, title string, text string, content string, descriptionPlain string, description string, descriptionHtml string, departments array<struct<name string>>, "
    "offices array<struct<name string>>, categories struct<department string, team string, location string>, department string, team string, location string, absolute_url string, "
    "hostedUrl string, jobUrl string, applyUrl string, updated_at string, first_published string, createdAt string, publishedAt string>>"
)
_ENTRY = "array<struct<title string, link string, published_at string, body string>>"
MAX_ENTRIES = 25


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def normalize_postings(raw: DataFrame, provider: str, payload: str) -> DataFrame:
    """The caller's columns but the payload, and external_id, title, description_text, department, location_raw, application_url, published_at.

    One row a job. An unreadable payload or unknown provider gives none; a job without an id keeps a null one.
    """
    p, j = F.col(provider), (lambda name: F.col("__tm_job").getField(name))
    listed = F.when(p == "lever", F.from_json(payload, _JOB)).when(p.isin("greenhouse", "ashby"), F.from_json(payload, f"jobs {_JOB}")["jobs"])
    names = lambda name: F.filter(F.transform(j(name), lambda x: x["name"]), lambda x: x != "")

    def by(greenhouse: Column, lever: Column, ashby: Column) -> Column:
        return F.when(p == "greenhouse", greenhouse).when(p == "lever", lever).otherwise(ashby)

    rows = raw.select(*[c for c in raw.columns if c != payload], F.explode(listed).alias("__tm_job"))
    offices = F.nullif(F.array_join(names("offices"), ", "), F.lit(""))
    return rows.select(
        *[c for c in raw.columns if c != payload],
        j("id").alias("external_id"),
        F.trim(F.coalesce(by(j("title"), j("text"), j("title")), F.lit(""))).alias("title"),
        clean_fragment(by(j("content"), first_filled(j("descriptionPlain"), j("description")), first_filled(j("descriptionPlain"), j("descriptionHtml")))).alias("description_text"),
        by(F.get(names("departments"), F.lit(0)), first_filled(j("categories")["department"], j("categories")["team"]), first_filled(j("department"), j("team"))).alias("department"),
        by(first_filled(F.get_json_object(j("location"), "$.name"), offices), j("categories")["location"], j("location")).alias("location_raw"),
        by(j("absolute_url"), first_filled(j("hostedUrl"), j("applyUrl")), first_filled(j("jobUrl"), j("applyUrl"))).alias("application_url"),
        by(first_filled(j("updated_at"), j("first_published")), j("createdAt"), j("publishedAt")).alias("published_at"),
    )


def explode_feed_entries(fetched: DataFrame, url: str, payload: str) -> DataFrame:
    """The caller's columns but the payload, and pos, title, link, published_at, body. Of a JSON list its objects, the first 25; else the whole text with the source's own address."""
    kind = F.schema_of_variant(F.try_parse_json(payload))
    items = F.filter(F.from_json(payload, "array<string>"), lambda x: F.trim(x).startswith("{"))
    whole = F.array(F.struct(F.lit("").alias("title"), F.col(url).alias("link"), F.lit(None).cast("string").alias("published_at"), F.col(payload).alias("body")))
    parsed = F.transform(F.slice(items, 1, MAX_ENTRIES), lambda x: F.from_json(x, _ENTRY[len("array<") : -1]))
    entries = F.when(F.coalesce(kind.startswith("ARRAY"), F.lit(False)), parsed).otherwise(whole)
    kept = [c for c in fetched.columns if c != payload]
    return fetched.select(*kept, F.posexplode(entries).alias("pos", "__tm_e")).select(*kept, F.col("pos").cast("long").alias("pos"), "__tm_e.*")


_NEWS = "articles array<struct<title string, description string, content string, url string, publishedAt string, source struct<name string>>>"
_LISTING = "jobs_results array<struct<title string, company_name string, location string, description string, via string, share_link string, apply_options array<struct<link string>>>>"
_FOUND = "array<struct<title string, snippet string, link string, date string, source string>>"
MAX_LISTINGS, MAX_LISTING_CHARS = 10, 2000


def normalize_articles(raw: DataFrame, vendor: str, payload: str, company: str) -> DataFrame:
    """The caller's columns but the payload, and title, description, content, url, published_at, source_name; one row an article.

    Vendors: newsapi, gnews, google_jobs (the first ten listings, those with a title and a link) and serpapi. Absent texts are empty; a date that is not ISO is null;
    an unreadable payload or unknown vendor gives no rows. ``company`` names the column used where a listing has no company of its own.
    """
    empty, no = F.lit(""), F.lit(None).cast("string")
    text = lambda c: F.coalesce(c, empty)

    def article(title: Column, description: Column, content: Column, url: Column, date: Column, source: Column) -> Column:
        return F.struct(text(title).alias("title"), text(description).alias("description"), text(content).alias("content"), text(url).alias("url"), date.alias("date"), source.alias("source_name"))

    news = F.transform(F.from_json(payload, _NEWS)["articles"], lambda a: article(a["title"], a["description"], a["content"], a["url"], a["publishedAt"], first_filled(a["source"]["name"], F.col(vendor))))
    listed = F.slice(F.from_json(payload, _LISTING)["jobs_results"], 1, MAX_LISTINGS)
    hiring = lambda a: F.when(text(a["title"]) != "", F.concat(first_filled(a["company_name"], F.col(company)), F.lit(" is hiring: "), a["title"]))
    listings = F.transform(listed, lambda a: article(hiring(a), a["location"], F.substring(a["description"], 1, MAX_LISTING_CHARS), first_filled(F.get(a["apply_options"], F.lit(0))["link"], a["share_link"]), no, first_filled(a["via"], F.lit("google_jobs"))))
    results = F.from_json(payload, f"organic_results {_FOUND}, news_results {_FOUND}")
    found = F.when(F.size(results["organic_results"]) > 0, results["organic_results"]).otherwise(results["news_results"])
    web = F.transform(found, lambda a: article(a["title"], a["snippet"], empty, a["link"], a["date"], first_filled(a["source"], F.lit("serpapi"))))
    v = F.col(vendor)
    articles = F.when(v.isin("newsapi", "gnews"), news).when(v == "google_jobs", F.filter(listings, lambda a: (a["title"] != "") & (a["url"] != ""))).when(v == "serpapi", web)
    kept = [c for c in raw.columns if c != payload]
    date = F.when(F.col("__tm_a.date").rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp("__tm_a.date")).alias("published_at")
    return raw.select(*kept, F.explode(articles).alias("__tm_a")).select(*kept, *[F.col(f"__tm_a.{c}") for c in ("title", "description", "content", "url")], date, "__tm_a.source_name")
