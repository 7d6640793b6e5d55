"""RSS and Atom feeds from XML, declared as one schema and read by Spark's own parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.pages import clean_fragment
from tidemark.sources.vendors import MAX_ENTRIES, first_filled

_ITEM = "array<struct<title string, link string, pubDate string, `dc:date` string, updated string, description string, `content:encoded` string>>"
_ENTRY = "array<struct<title string, link array<struct<_href string, _rel string>>, published string, updated string, summary string, content string>>"
#: RSS 2.0 keeps items in its channel, RSS 1.0 beside it, Atom has entries.
SCHEMA = f"channel struct<item {_ITEM}>, item {_ITEM}, entry {_ENTRY}"
# Zone names of mail dates and their offsets.
ZONES = {"UT": "+0000", "GMT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def feed_time(text: Column) -> Column:
    """A timestamp of an ISO or a mail date; null if it is neither."""
    t = F.trim(text)
    mail = F.regexp_replace(t, r"^[A-Za-z]{3,9},?\s+", "")
    zone = F.regexp_extract(mail, r"([A-Za-z]+)$", 1)
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), F.nullif(F.upper(zone), F.lit("")))
    mail = F.when(offset.isNotNull(), F.concat(F.regexp_replace(mail, r"[A-Za-z]+$", ""), offset)).otherwise(mail)
    long = F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))
    short = F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm Z")))
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t)), long, short)


def parse_feeds(feeds: DataFrame, xml: str) -> DataFrame:
    """The caller's columns but the XML, and pos, title, link, published_at (timestamp), body: a row for each of a feed's first 25 items.

    A date that is missing or unreadable falls back to that of the update. The body is the full content where there is one, else summary or description,
    as readable text. An Atom link is the alternate one, else the first. A text that is no feed gives no rows; a feed that breaks off gives none either.
    """
    kept = [c for c in feeds.columns if c != xml]
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))

    def row(title: Column, link: Column, published: Column, updated: Column, body: Column) -> Column:
        return F.struct(text(title).alias("title"), link.alias("link"), published.alias("published"), updated.alias("updated"), text(body).alias("body"))

    item = lambda x: row(x["title"], F.trim(x["link"]), F.coalesce(x["pubDate"], x["dc:date"]), x["updated"], first_filled(x["content:encoded"], x["description"]))

    def entry(x: Column) -> Column:
        own = F.filter(x["link"], lambda y: F.coalesce(y["_rel"], F.lit("alternate")) == "alternate")
        href = F.coalesce(F.get(own, F.lit(0))["_href"], F.get(x["link"], F.lit(0))["_href"])
        return row(x["title"], href, x["published"], x["updated"], first_filled(x["content"], x["summary"]))

    doc = feeds.withColumn("__tm_f", F.from_xml(xml, SCHEMA))
    f = F.col("__tm_f")
    rows = F.coalesce(F.transform(f["channel"]["item"], item), F.transform(f["item"], item), F.transform(f["entry"], entry))
    out = doc.select(*kept, F.posexplode(F.slice(rows, 1, MAX_ENTRIES)).alias("pos", "__tm_e"))
    e = F.col("__tm_e")
    when = F.coalesce(feed_time(e["published"]), feed_time(e["updated"])).alias("published_at")
    body = F.when(e["body"].contains("<"), clean_fragment(e["body"])).otherwise(e["body"]).alias("body")
    return out.select(*kept, F.col("pos").cast("long").alias("pos"), e["title"].alias("title"), e["link"].alias("link"), when, body)


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """feed (the file), pos, title, link, published_at, body of the feed files under a path, a file a feed."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("feed"), F.col("value").alias("xml"))
    return parse_feeds(files, "xml")
