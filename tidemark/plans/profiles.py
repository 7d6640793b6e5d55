"""Queries of the company page, late events, the incremental crawl, feeds, entities and slugs, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import crawl as W
from tidemark.operators import naming as G
from tidemark.operators import pages as P
from tidemark.operators import reports as R
from tidemark.operators import scores as C
from tidemark.plans.queries import _LED, _MOVES, _SCORE, _SERIES, _TIER, _TOP_PUBLIC, _ACTIVE, AS_OF, SINCE, _scores, _weight, at, query, sql
from tidemark.sources import adapters as A
from tidemark.sources import entities as N
from tidemark.sources import feeds as V
from tidemark.sources.steps import discard, new_path, settle

_30 = f"TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY"
_PROFILE = """pt AS (SELECT company_id, string_agg(round(momentum_score, 4) || ':' || momentum_label, ';' ORDER BY scored_at) AS score_history FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY scored_at DESC) AS p FROM sc) WHERE p <= 10 GROUP BY 1),
  dl AS (SELECT company_id, max(momentum_score) FILTER (WHERE p = 1) AS momentum_score, max(momentum_score) FILTER (WHERE p = 1) - max(momentum_score) FILTER (WHERE p = 2) AS score_delta FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY scored_at DESC) AS p FROM sc) GROUP BY 1),
  rc AS (SELECT company_id, string_agg(id || ':' || event_type, ';' ORDER BY observed_at DESC, id DESC) AS recent_events FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY observed_at DESC, id DESC) AS p FROM pb) WHERE p <= {n} GROUP BY 1),
  fm AS (SELECT company_id, string_agg(f || '=' || n, ';' ORDER BY f) AS families, sum(n)::BIGINT AS active_jobs FROM (SELECT company_id, coalesce(role_family, 'other') AS f, count(*) AS n FROM jb WHERE is_active GROUP BY 1, 2) GROUP BY 1),
  ap AS (SELECT company_id, string_agg(source_type || ' ' || url, ';' ORDER BY source_type, url) AS sources FROM so WHERE status = 'approved' AND company_id IS NOT NULL GROUP BY 1),
  ec AS (SELECT company_id, count(*) AS events, count(*) FILTER (WHERE observed_at >= """ + _30 + """) AS events_30d FROM pb GROUP BY 1)"""
_PAGE = """SELECT co.id, round(dl.momentum_score, 6) AS momentum_score, round(score_delta, 6) AS score_delta, score_history, coalesce(active_jobs, 0) AS active_jobs, families, coalesce(events, 0) AS events, coalesce(events_30d, 0) AS events_30d, recent_events{sources}
FROM {co} co LEFT JOIN pt ON pt.company_id = co.id LEFT JOIN dl ON dl.company_id = co.id LEFT JOIN rc ON rc.company_id = co.id LEFT JOIN fm ON fm.company_id = co.id LEFT JOIN ap ON ap.company_id = co.id LEFT JOIN ec ON ec.company_id = co.id"""


def _flat(rows: DataFrame, *more: str) -> DataFrame:
    """Nested columns of a profile as texts."""
    joined = lambda c, f: F.array_join(F.transform(c, f), ";").alias(c)
    point = lambda p: F.concat(F.round(p["momentum_score"], 4).cast("string"), F.lit(":"), p["momentum_label"])
    families = F.array_join(F.transform(F.map_entries("jobs_by_family"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("families")
    cols = [F.round("momentum_score", 6).alias("momentum_score"), F.round("score_delta", 6).alias("score_delta"), joined("score_history", point), "active_jobs", families, "events", "events_30d"]
    event = joined("recent_events", lambda e: F.concat(e["id"].cast("string"), F.lit(":"), e["event_type"]))
    source = joined("sources", lambda s: F.concat(s["source_type"], F.lit(" "), s["url"]))
    return rows.select("id", *cols, event, *([source] if "sources" in more else []), *[m for m in more if m != "sources"])


@query(sql("co", "jb", "so", "ev", "sg", "pb", _SERIES, _PROFILE.replace("{n}", "5"), body=_PAGE.format(sources=", sources", co="co")))
def company_profiles(spark: SparkSession, d: str) -> DataFrame:
    return _flat(R.company_profile(A.companies(spark, d), _scores(spark, d), A.jobs(spark, d), A.signals(spark, d), A.sources(spark, d), at(AS_OF)), "sources")


_ASKED = "(SELECT co.*, place FROM co JOIN (SELECT unnest(['customer-000000003', 'customer-000000001']) AS slug, unnest([0, 1]) AS place) USING (slug))"


@query(sql("co", "jb", "so", "ev", "sg", "pb", _SERIES, _PROFILE.replace("{n}", "3"), body=_PAGE.format(sources=", place, name", co=_ASKED)))
def compare_profiles(spark: SparkSession, d: str) -> DataFrame:
    names = ["customer-000000003", "customer-000000001", "customer-000000003"]
    return _flat(R.compare_profiles(A.companies(spark, d), _scores(spark, d), A.jobs(spark, d), A.signals(spark, d), names, at(AS_OF)), "place", "name")


@query(sql("co", "jb", "ev", "sg", "pb", _SERIES, _MOVES, _ACTIVE, _TOP_PUBLIC, body="SELECT co.id, round(latest - coalesce(baseline, 0), 6) AS delta, coalesce(active_jobs, 0) AS active_jobs, headline FROM co JOIN mv ON mv.company_id = co.id LEFT JOIN aj ON aj.company_id = co.id LEFT JOIN tp ON tp.company_id = co.id WHERE is_active AND industry = 'BUILDING' ORDER BY latest - coalesce(baseline, 0) DESC, co.id LIMIT 7"))
def trending_in_industry(spark: SparkSession, d: str) -> DataFrame:
    rows = R.trending(A.companies(spark, d), _scores(spark, d), A.jobs(spark, d), A.signals(spark, d), at(SINCE), 7, industry="BUILDING")
    return rows.select("id", F.round("delta", 6).alias("delta"), "active_jobs", "headline")


@query(sql("co", "jb", "so", "ev", "sg", "pb", body=f"""SELECT (SELECT count(*) FROM co WHERE is_active) AS active_companies, (SELECT count(*) FROM jb WHERE is_active) AS active_jobs, (SELECT count(*) FROM pb WHERE observed_at >= {_30}) AS events_30d,
(SELECT count(DISTINCT company_id) FROM pb) AS covered_companies, (SELECT strftime(max(created_at), '%Y-%m-%d') FROM so WHERE consecutive_failures = 0) AS last_crawl"""))
def platform_totals(spark: SparkSession, d: str) -> DataFrame:
    sources = A.sources(spark, d).withColumn("last_successful_crawl", F.when(F.col("consecutive_failures") == 0, F.col("created_at")))
    return R.platform_stats(A.companies(spark, d), A.jobs(spark, d), A.signals(spark, d), at(AS_OF), sources).withColumn("last_crawl", F.date_format("last_crawl", "yyyy-MM-dd"))


_LATE = f"""ef AS (SELECT * REPLACE (coalesce(occurred_at, observed_at) AS observed_at) FROM dt),
  lw AS (SELECT company_id, {_weight(f"TIMESTAMP '{AS_OF}'")} AS w FROM ef WHERE observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY),
  lr AS (SELECT company_id, sum(w) AS raw, count(*) AS n_events FROM lw GROUP BY 1)"""


@query(sql("co", "ev", "sg", "dt", _LATE, body=f"SELECT co.id AS company_id, round(CASE WHEN raw IS NULL THEN 0 ELSE {_SCORE} END, 6) AS momentum_score, coalesce(n_events, 0) AS n_events FROM co LEFT JOIN lr ON lr.company_id = co.id"))
def late_scores(spark: SparkSession, d: str) -> DataFrame:
    """Events discovered late decay by when they happened; those beyond the lookback don't count, future ones are new."""
    rows = C.momentum_scores(A.dated(spark, d).drop("evidence"), A.companies(spark, d), at(AS_OF))
    return rows.select("company_id", F.round("momentum_score", 6).alias("momentum_score"), "n_events")


_BATCH = "CASE WHEN observed_at < TIMESTAMP '2024-01-10' THEN 0 WHEN observed_at < TIMESTAMP '2024-01-20' THEN 1 ELSE 2 END"
_CRAWLED = f"""{_LED.replace("ORDER BY id", f"ORDER BY {_BATCH}, id")},
  ur AS (SELECT canonical_id, source_url FROM rp JOIN ld ON ld.id = rp.id GROUP BY ALL),
  us AS (SELECT canonical_id, count(*) AS source_count, max({_TIER}) AS factor FROM ur GROUP BY 1),
  ce AS (SELECT rp.company_id, rp.event_type, rp.observed_at, us.source_count, us.factor FROM rp JOIN us ON us.canonical_id = rp.id),
  cw AS (SELECT company_id, {_weight(f"TIMESTAMP '{AS_OF}'").replace(_TIER, "factor")} AS w FROM ce WHERE observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY),
  cr AS (SELECT company_id, sum(w) AS raw, count(*) AS n_events FROM cw GROUP BY 1)"""


@query(sql("co", "ev", "rp", _CRAWLED, body=f"SELECT company_id, round({_SCORE}, 6) AS momentum_score, n_events FROM cr JOIN co ON co.id = company_id").replace("WITH", "WITH RECURSIVE", 1))
def crawl_scores(spark: SparkSession, d: str) -> DataFrame:
    """Three batches of fetches, one for each report, through the incremental crawl: the scores that its tables end with."""
    text = F.lit("Our company is hiring engineers for a new office in a city far away and raised a series a round of funding led by investors.")
    batch = F.when(F.col("observed_at") < at("2024-01-10"), 0).when(F.col("observed_at") < at("2024-01-20"), 1).otherwise(2)
    # each batch reads its reports more than once, so they are made once
    reports, reports_at = settle(A.reports(spark, d).withColumn("b", batch), "reports")
    store, companies = new_path(spark, "crawl"), A.profiles(spark, d)

    def events_of(extracted: DataFrame, docs: DataFrame) -> DataFrame:
        return docs.select(F.col("source_id").alias("event_id"), "company_id").join(extracted, "event_id")

    for number in range(3):
        own = reports.filter(F.col("b") == number)
        fetches = own.select(
            F.col("id").alias("source_id"), "company_id", F.lit("news_site").alias("source_type"), F.col("observed_at").cast("timestamp").alias("fetched_at"), F.col("source_url").alias("url"), text.alias("text"),
        )
        extracted = own.drop("company_id", "k", "b").withColumnRenamed("id", "event_id").withColumn("context", F.lit(""))
        W.crawl_batch(fetches, number, store, partial(events_of, extracted), companies, at(AS_OF))
    discard(spark, reports_at)
    return W.crawled_scores(spark, store).select("company_id", F.round("momentum_score", 6).alias("momentum_score"), "n_events")


@query("""SELECT page_id, CAST(pos AS BIGINT) AS pos, 'T' || page_id || ' & <' || pos || '>' AS title, CASE WHEN page_id % 2 = 0 THEN 'https://f.example/' || page_id || '/' || pos ELSE 'https://a.example/' || page_id || '/' || pos END AS link,
strftime(TIMESTAMP '2024-01-01 10:00:00' + to_days(CAST(page_id % 28 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS published_at, CASE WHEN pos % 2 = 0 THEN 'full' || chr(10) || 'text' ELSE 'short' END AS body FROM pages, range(25) t(pos)""")
def xml_feeds(spark: SparkSession, d: str) -> DataFrame:
    """A feed of 30 items for each page, RSS or Atom, with full or short bodies and either date."""
    item = """'<item><title>T', page_id, ' &amp;amp; &amp;lt;', i, '&amp;gt;</title><link>https://f.example/', page_id, '/', i, '</link>', IF(i % 3 = 0, concat('<dc:date>', day, 'T10:00:00Z</dc:date>'), concat('<pubDate>Mon, ', mail, ' 10:00:00 GMT</pubDate>')),
      '<description>short</description>', IF(i % 2 = 0, '<content:encoded><![CDATA[<p>full</p><p>text</p>]]></content:encoded>', ''), '</item>'"""
    entry = """'<entry><title type="html">T', page_id, ' &amp;amp; &amp;lt;', i, '&amp;gt;</title><link href="x" rel="self"/><link href="https://a.example/', page_id, '/', i, '"/>', IF(i % 3 = 0, '<published>soon</published>', ''), '<updated>', day, 'T12:00:00+02:00</updated>',
      '<summary>short</summary>', IF(i % 2 = 0, '<content type="html">&lt;p&gt;full&lt;/p&gt;&lt;p&gt;text&lt;/p&gt;</content>', ''), '</entry>'"""
    fix = lambda x: x.replace("&amp;amp;", "&amp;").replace("&amp;lt;", "&lt;").replace("&amp;gt;", "&gt;")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28).cast("int"))
    p = A.table(spark, d, "pages").select("page_id", F.date_format(day, "yyyy-MM-dd").alias("day"), F.date_format(day, "dd MMM yyyy").alias("mail"))
    rss = F.expr(f"concat('<rss xmlns:dc=\"d\" xmlns:content=\"c\"><channel><title>f</title>', array_join(transform(sequence(0, 29), i -> concat({fix(item)})), ''), '</channel></rss>')")
    atom = F.expr(f"concat('<feed xmlns=\"http://www.w3.org/2005/Atom\"><title>f</title>', array_join(transform(sequence(0, 29), i -> concat({fix(entry)})), ''), '</feed>')")
    rows = V.parse_feeds(p.select("page_id", F.when(F.col("page_id") % 2 == 0, rss).otherwise(atom).alias("xml")), "xml")
    return rows.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'id: bigint' END, CASE WHEN o_orderkey % 10 = 0 THEN 'company_id: null' END, CASE WHEN o_orderkey % 7 = 0 THEN 'observed_at: timestamp' END,
CASE WHEN o_orderkey % 9 = 0 THEN 'confidence: double' END], lambda x: x IS NOT NULL)) AS reason FROM orders) GROUP BY reason UNION ALL
SELECT 'kept', count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 10 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 9 <> 0""")
def entity_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Orders in the shape of events, some with values that don't fit: what the declared schema refuses, by reason, and what it keeps."""
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    raw = A.table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("x"), text)).otherwise(text).alias("id"), F.when(key % 10 != 0, F.col("o_custkey").cast("int")).alias("company_id"), F.lit("funding").alias("event_type"),
        F.col("o_orderpriority").alias("title"), F.when(key % 7 == 0, F.lit("soon")).otherwise(F.col("o_orderdate").cast("string")).alias("observed_at"), F.when(key % 9 == 0, F.lit("high")).when(key % 4 == 0, F.lit("0.5")).alias("confidence"), F.lit(1).alias("unknown"),
    )
    kept, refused = N.conform(raw, N.declared("events"))
    return N.refusals(refused).unionByName(kept.agg(F.lit("kept").alias("reason"), F.count("*").alias("n")))


@query("""WITH b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'zoe ' || lower(c_mktsegment) ELSE lower(c_mktsegment) END AS n FROM customer),
r AS (SELECT id, replace(n, ' ', '-') AS base, row_number() OVER (PARTITION BY n ORDER BY id) AS k FROM b)
SELECT id, CASE WHEN base = 'building' THEN 'building-' || (k + 2) WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM r""")
def unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Customers named by their segment, a third with an accent, against two slugs that are stored."""
    c = A.table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Zoë "), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    stored = c.agg(F.explode(F.array(F.lit("building"), F.lit("building-2"))).alias("slug"))
    return G.unique_slugs(c.select(F.col("c_custkey").alias("id"), name.alias("name")), stored)


@query()
def article_texts(spark: SparkSession, d: str) -> DataFrame:
    return P.article_texts(A.table(spark, d, "pages"))


