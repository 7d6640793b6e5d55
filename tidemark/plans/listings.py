"""Queries of listings, searches, the digest and the operators' pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import digest as D
from tidemark.operators import ingest as G
from tidemark.operators import listing as L
from tidemark.operators import reports as R
from tidemark.operators import scores as C
from tidemark.operators import snapshots as N
from tidemark.plans.queries import _ACTIVE, _LATEST, _SERIES, AS_OF, SINCE, _scores, at, query, sql
from tidemark.sources import adapters as A

_WEEK = f"TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"
_JOBS_AS_OF = "2001-07-30 00:00:00"


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query(sql("ev", "sg", "pb", body="SELECT event_type, count(*) AS events FROM pb GROUP BY event_type"))
def public_events(spark: SparkSession, d: str) -> DataFrame:
    return L.public_events(A.signals(spark, d)).groupBy("event_type").agg(F.count("*").alias("events"))


@query(sql("co", "ev", "sg", "pb", body=f"SELECT pb.id, company_id, slug AS company_slug FROM pb JOIN co ON co.id = company_id WHERE event_type = 'layoff' AND observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 25 DAY AND slug = 'customer-000000007'"))
def list_company_events(spark: SparkSession, d: str) -> DataFrame:
    slug = "customer-000000007"
    rows = L.list_events(A.signals(spark, d), A.companies(spark, d), event_type="layoff", company_slug=slug, days=25, as_of=at(AS_OF), sort_by="occurred_at", sort_order="asc")
    return rows.select("id", "company_id", "company_slug")


@query(sql("co", "ro", body="SELECT ro.id, title, co.name AS company_name FROM ro JOIN co ON co.id = company_id WHERE ro.is_active AND seniority = 'senior' AND work_mode = 'remote' AND title ILIKE '%data_eng%-h%'"))
def list_jobs(spark: SparkSession, d: str) -> DataFrame:
    return L.list_jobs(A.roles(spark, d), A.companies(spark, d), seniority="senior", work_mode="remote", search="data_eng%-h", sort_by="title", sort_order="asc").select("id", "title", "company_name")


@query(sql("co", "pf", "jb", "ev", _SERIES, _LATEST, _ACTIVE, body="SELECT pf.id, name, stage, coalesce(active_jobs, 0) AS active_jobs, round(momentum_score, 6) AS momentum_score FROM pf LEFT JOIN la ON la.company_id = pf.id LEFT JOIN aj ON aj.company_id = pf.id WHERE is_active AND stage = 'growth' AND (lower(name) LIKE '%0_%' OR canonical_domain LIKE '%0_%') AND momentum_score >= 0"))
def list_companies_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = L.list_companies(A.profiles(spark, d), _scores(spark, d), A.jobs(spark, d), stage="growth", is_active=True, search="0_", min_score=0, sort_by="active_jobs", sort_order="desc")
    return rows.select("id", "name", "stage", "active_jobs", F.round("momentum_score", 6).alias("momentum_score"))


@query(sql("so", body="SELECT id, url FROM so WHERE status = 'pending' AND source_type = 'rss_feed' AND submitted_by = 2"))
def list_sources(spark: SparkSession, d: str) -> DataFrame:
    return L.list_sources(A.sources(spark, d), status="pending", source_type="rss_feed", submitted_by=2).select("id", "url")


@query(sql("so", body="SELECT company_id, source_type, url FROM so WHERE status = 'approved'"))
def company_sources(spark: SparkSession, d: str) -> DataFrame:
    return L.company_sources(A.sources(spark, d)).select("company_id", "source_type", "url")


@query(sql("co", "so", body="SELECT co.slug, co.name, string_agg(source_type || ' ' || url, ';' ORDER BY source_type, url, so.id) AS sources FROM so LEFT JOIN co ON co.id = so.company_id WHERE status = 'approved' GROUP BY co.slug, co.name, CASE WHEN co.slug IS NULL THEN so.id END"))
def browse_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = L.browse_sources(A.sources(spark, d), A.companies(spark, d))
    return rows.select("slug", "name", F.array_join(F.transform("sources", lambda s: F.concat(s["source_type"], F.lit(" "), s["url"])), ";").alias("sources"))


@query(sql("so", body="SELECT id FROM so WHERE source_type <> 'career_page' OR company_id IS NULL OR company_id NOT IN (SELECT company_id FROM so WHERE fetch_tier = 'ats_api' AND status = 'approved' AND company_id IS NOT NULL)"))
def drop_superseded(spark: SparkSession, d: str) -> DataFrame:
    return L.drop_superseded(A.sources(spark, d)).select("id")


@query(sql("so", body="SELECT id, '2024-01-20 01:00:00' AS next_crawl_at FROM so WHERE status = 'approved' AND next_crawl_at <= TIMESTAMP '2024-01-20' ORDER BY so.next_crawl_at, id LIMIT 10"))
def due_sources(spark: SparkSession, d: str) -> DataFrame:
    return L.due_sources(A.sources(spark, d), at("2024-01-20 00:00:00")).select("id", _text("next_crawl_at"))


@query(sql("co", "so", body="SELECT so.id, name AS company_name, consecutive_failures FROM so LEFT JOIN co ON co.id = company_id WHERE status = 'approved' AND consecutive_failures > 0 ORDER BY consecutive_failures DESC, next_crawl_at NULLS LAST, so.id LIMIT 200"))
def crawler_health(spark: SparkSession, d: str) -> DataFrame:
    return L.crawler_health(A.sources(spark, d), A.companies(spark, d), only_failing=True).select("id", "company_name", "consecutive_failures")


@query(sql("co", "so", body="SELECT so.id FROM so JOIN co ON co.id = company_id WHERE source_type = 'ats_api' AND status = 'approved' AND is_active"))
def sync_targets(spark: SparkSession, d: str) -> DataFrame:
    return L.sync_targets(A.sources(spark, d), A.companies(spark, d)).select("id")


@query(sql("sb", body="SELECT id, email FROM sb WHERE is_active AND confirmed_at IS NOT NULL"))
def active_subscribers(spark: SparkSession, d: str) -> DataFrame:
    return L.active_subscribers(A.subscribers(spark, d)).select("id", "email")


@query(sql("sb", body="SELECT id FROM sb WHERE NOT is_active"))
def lapsed_subscribers(spark: SparkSession, d: str) -> DataFrame:
    return L.list_subscribers(A.subscribers(spark, d), is_active=False).select("id")


@query(sql("co", "pf", "ev", _SERIES, _LATEST, body="SELECT pf.id, name, round(momentum_score, 6) AS momentum_score FROM pf LEFT JOIN la ON la.company_id = pf.id WHERE is_active AND (contains(lower(name), 'alias 77') OR contains(slug, 'alias 77') OR contains(canonical_domain, 'alias 77') OR contains(description, 'alias 77') OR list_contains(aliases, 'Alias 77'))"))
def search_companies_alias(spark: SparkSession, d: str) -> DataFrame:
    return L.search_companies(A.profiles(spark, d), _scores(spark, d), "Alias 77").select("id", "name", F.round("momentum_score", 6).alias("momentum_score"))


@query(sql("co", "pf", body="SELECT id, name FROM pf WHERE is_active AND (contains(lower(name), 'of build') OR contains(description, 'of build'))"))
def search_companies(spark: SparkSession, d: str) -> DataFrame:
    return L.search_companies(A.profiles(spark, d), _scores(spark, d), "OF Build").select("id", "name")


@query(sql("co", "ev", "sg", "pb", body="SELECT pb.id, name AS company_name FROM pb JOIN co ON co.id = company_id WHERE contains(title, 'event 12') OR contains(lower(name), 'event 12')"))
def search_events(spark: SparkSession, d: str) -> DataFrame:
    return L.search_events(A.signals(spark, d), A.companies(spark, d), "Event 12").select("id", "company_name")


@query(sql("co", "pf", "ev", "sg", "pb", body="SELECT 'company' AS section, count(*) AS total FROM pf WHERE is_active AND (contains(lower(name), '12') OR contains(canonical_domain, '12') OR contains(slug, '12') OR contains(description, '12')) UNION ALL SELECT 'event', count(*) FROM pb JOIN co ON co.id = company_id WHERE contains(title, '12') OR contains(name, '12')"))
def search_totals(spark: SparkSession, d: str) -> DataFrame:
    c = L.search_companies(A.profiles(spark, d), _scores(spark, d), "12")
    e = L.search_events(A.signals(spark, d), A.companies(spark, d), "12")
    return L.search_all({"company": c, "event": e}, {"company": [F.col("name"), F.col("id")], "event": [F.desc("observed_at"), F.desc("id")]})[1]


@query(sql("co", "ev", "sg", "pb", body="SELECT pb.id, name AS company_name FROM pb JOIN co ON co.id = company_id WHERE contains(title, '12') OR contains(name, '12') ORDER BY observed_at DESC, pb.id DESC OFFSET 10 LIMIT 10"))
def search_page(spark: SparkSession, d: str) -> DataFrame:
    e = L.search_events(A.signals(spark, d), A.companies(spark, d), "12")
    return L.search_all({"event": e}, {"event": [F.desc("observed_at"), F.desc("id")]}, "event", 2, 10)[0]["event"].select("id", "company_name")


@query(sql("co", "ev", "sg", "pb", body="SELECT pb.id, name AS company_name FROM pb JOIN co ON co.id = company_id WHERE event_type = 'partnership' ORDER BY observed_at DESC, pb.id DESC LIMIT 20"))
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    return L.recent_activity(A.signals(spark, d), A.companies(spark, d), event_type="partnership").select("id", "company_name")


_NOTABLE = f"nt AS (SELECT pb.id, observed_at, event_type, title, co.name, CASE WHEN n_evidence > 0 THEN 'https://boards.greenhouse.io/acme' END AS evidence_url FROM (SELECT * FROM pb WHERE observed_at >= {_WEEK} ORDER BY observed_at DESC, id DESC LIMIT 15) pb JOIN co ON co.id = company_id)"


@query(sql("co", "ev", "sg", "pb", _NOTABLE, body="SELECT id, name AS company_name, title, evidence_url, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS occurred_at FROM nt"))
def notable_events(spark: SparkSession, d: str) -> DataFrame:
    return D.notable_events(A.signals(spark, d), A.companies(spark, d), at(AS_OF) - F.expr("INTERVAL 7 DAYS")).select("id", "company_name", "title", "evidence_url", _text("occurred_at"))


@query(sql("co", "pf", body=f"SELECT id, name FROM pf WHERE is_active AND created_at >= {_WEEK} ORDER BY created_at DESC, id LIMIT 10"))
def new_entrants(spark: SparkSession, d: str) -> DataFrame:
    return D.new_entrants(A.profiles(spark, d), at(AS_OF) - F.expr("INTERVAL 7 DAYS")).select("id", "name")


@query(sql("co", "ev", "sg", "pb", _NOTABLE, body="SELECT event_type, row_number() OVER (ORDER BY t DESC, i DESC) AS place, titles FROM (SELECT event_type, max(observed_at) AS t, arg_max(id, (observed_at, id)) AS i, string_agg(title, ';' ORDER BY observed_at DESC, id DESC) AS titles FROM nt GROUP BY event_type)"))
def digest_events_by_type(spark: SparkSession, d: str) -> DataFrame:
    rows = D.digest_events_by_type(D.notable_events(A.signals(spark, d), A.companies(spark, d), at(AS_OF) - F.expr("INTERVAL 7 DAYS")))
    return rows.select("event_type", "place", F.array_join("titles", ";").alias("titles"))


@query(sql("co", "pf", "jb", "ev", "sg", "pb", _SERIES, _NOTABLE,
    f"mo AS (SELECT company_id, arg_max(momentum_score, scored_at) - coalesce(arg_max(momentum_score, scored_at) FILTER (WHERE scored_at < {_WEEK}), 0) AS delta FROM sc GROUP BY company_id)",
    "mv AS (SELECT pf.id, delta FROM pf JOIN mo ON mo.company_id = pf.id WHERE is_active AND delta > 0 ORDER BY delta DESC, pf.id LIMIT 10)",
    f"ne AS (SELECT id, name, created_at FROM pf WHERE is_active AND created_at >= {_WEEK} ORDER BY created_at DESC, id LIMIT 10)",
    body="SELECT (SELECT string_agg(id, ',' ORDER BY delta DESC, id) FROM mv) AS movers, (SELECT string_agg(id, ',' ORDER BY observed_at DESC, id) FROM nt) AS events, (SELECT string_agg(id, ',' ORDER BY created_at DESC, id) FROM ne) AS entrants, false AS is_empty"))
def weekly_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = D.weekly_digest(A.profiles(spark, d), _scores(spark, d), A.jobs(spark, d), A.signals(spark, d), at(AS_OF))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["id"].cast("string")), ",")
    return rows.select(ids("top_movers").alias("movers"), ids("notable_events").alias("events"), ids("new_entrants").alias("entrants"), "is_empty")


@query(sql("sb", body="SELECT id, row_number() OVER (ORDER BY created_at, id) <= 70 AS sent FROM sb WHERE is_active AND confirmed_at IS NOT NULL"))
def send_cap(spark: SparkSession, d: str) -> DataFrame:
    return D.apply_send_cap(L.active_subscribers(A.subscribers(spark, d)), ["created_at", "id"], 100, 30).select("id", "sent")


_MAP = "(SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT {0} AS k, count(*) AS n FROM so GROUP BY {0}))"


@query(sql("co", "so", body=f"SELECT count(*) AS total_sources, count(DISTINCT company_id) FILTER (WHERE status = 'approved') AS companies_with_sources, greatest((SELECT count(*) FROM co WHERE is_active) - count(DISTINCT company_id) FILTER (WHERE status = 'approved'), 0) AS companies_without_sources, {_MAP.format('source_type')} AS by_type, {_MAP.format('status')} AS by_status FROM so"))
def source_stats(spark: SparkSession, d: str) -> DataFrame:
    flat = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias(c)
    return D.source_stats(A.sources(spark, d), A.companies(spark, d)).select("total_sources", "companies_with_sources", "companies_without_sources", flat("by_type"), flat("by_status"))


def _union(parts: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS metric, count(*) AS value FROM {what}" for name, what in parts)


@query(sql("co", "jb", "so", "sb", "ev", "sg", body=_union([
    ("total_companies", "co"), ("active_companies", "co WHERE is_active"), ("total_sources", "so"), ("total_events", "sg WHERE is_canonical"), ("active_jobs", "jb WHERE is_active"),
    ("closed_jobs", "jb WHERE NOT is_active"), ("total_users", "supplier"), ("total_subscribers", "sb WHERE is_active")]) + " UNION ALL SELECT 'sources_' || status, count(*) FROM so GROUP BY status"))
def instance_metrics(spark: SparkSession, d: str) -> DataFrame:
    return D.instance_metrics(A.companies(spark, d), A.sources(spark, d), A.signals(spark, d), A.jobs(spark, d), A.table(spark, d, "supplier"), A.subscribers(spark, d))


@query(sql("co", "pf", "ro", "so", "sb", "ev", "sg", "pb", _SERIES, body=_union([
    ("new_companies", f"pf WHERE created_at >= {_WEEK}"), ("new_sources", f"so WHERE created_at >= {_WEEK}"), ("new_events", f"pb WHERE observed_at >= {_WEEK}"), ("new_jobs", f"ro WHERE first_seen_at >= {_WEEK}"),
    ("closed_jobs", f"ro WHERE closed_at >= {_WEEK}"), ("new_subscribers", f"sb WHERE created_at >= {_WEEK}"), ("confirmed_subscribers", f"sb WHERE confirmed_at >= {_WEEK}"), ("scores_computed", f"sc WHERE scored_at >= {_WEEK}"),
    ("jobs_missing_embedding", "ro WHERE is_active AND vec IS NULL")])))
def weekly_stats(spark: SparkSession, d: str) -> DataFrame:
    return D.weekly_stats(A.profiles(spark, d), A.sources(spark, d), A.signals(spark, d), A.roles(spark, d), A.subscribers(spark, d), _scores(spark, d), at(AS_OF))


@query("""WITH u AS (SELECT event_type AS vendor, CASE event_type WHEN 'view' THEN 100 WHEN 'click' THEN 90 ELSE 8 END AS lim, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-13') AS used FROM events GROUP BY 1)
SELECT vendor, CAST(lim AS BIGINT) AS "limit", used, greatest(lim - used, 0) AS remaining, used >= lim AS exhausted, (SELECT bool_and(used >= lim) FROM u) AS paused FROM u""")
def quota_status(spark: SparkSession, d: str) -> DataFrame:
    calls = A.table(spark, d, "events").select(F.col("event_type").alias("vendor"), "ts")
    limits = calls.select("vendor").distinct().withColumn("limit", F.when(F.col("vendor") == "view", 100).when(F.col("vendor") == "click", 90).otherwise(8).cast("long"))
    return D.quota_status(calls, limits, "vendor", "ts", at("2024-01-12 15:00:00")).select("vendor", "limit", "used", "remaining", "exhausted", "paused")


@query(sql("co", "pf", body="SELECT id, name FROM pf WHERE slug = 'customer-000000011'"))
def lookup_company(spark: SparkSession, d: str) -> DataFrame:
    return L.lookup(A.profiles(spark, d), "slug", "customer-000000011").select("id", "name")


@query(sql("co", body="SELECT place, t.slug, co.id FROM (VALUES (0, 'customer-000000003'), (1, 'customer-000000001'), (2, 'nobody')) AS t(place, slug) LEFT JOIN co ON co.slug = t.slug"))
def compare_companies(spark: SparkSession, d: str) -> DataFrame:
    names = ["customer-000000003", "customer-000000001", "nobody", "customer-000000003"]
    return R.compare_companies(A.companies(spark, d), names).select("place", "slug", "id")


@query(sql("so", body="SELECT id FROM so ORDER BY next_crawl_at NULLS FIRST, id LIMIT 15"))
def stalest_sources(spark: SparkSession, d: str) -> DataFrame:
    return N.stalest(A.sources(spark, d), "next_crawl_at", 15, "id").select("id")


@query(sql("ro", body="SELECT id, coalesce(vec, (SELECT arg_min(d.vec, d.id) FROM ro d WHERE d.vec IS NOT NULL AND d.content_hash = ro.content_hash AND d.title = ro.title)) AS vec FROM ro"))
def copy_sibling_vectors(spark: SparkSession, d: str) -> DataFrame:
    return G.copy_sibling_vectors(A.roles(spark, d)).select("id", F.get("embedding", F.lit(0)).cast("long").alias("vec"))


@query(sql("ro", body="SELECT sha256(lower(t)) AS digest, any_value(t) AS text, count(*) AS members FROM (SELECT title || ' ' || role_family || ' ' || description_text AS t FROM ro WHERE is_active AND vec IS NULL) GROUP BY 1"))
def embedding_worklist(spark: SparkSession, d: str) -> DataFrame:
    return G.embedding_worklist(A.roles(spark, d)).select("digest", "text", F.size("members").cast("long").alias("members"))


@query("SELECT o_orderkey AS user_id, NOT (o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AND o_orderkey % 5 < 3) AS needs_indexing, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AND o_orderkey % 5 < 3 THEN 'ready' ELSE 'pending' END AS status FROM orders")
def plan_indexing(spark: SparkSession, d: str) -> DataFrame:
    o, key = A.table(spark, d, "orders"), F.col("o_orderkey")
    uploads = o.select(key.alias("user_id"), F.lit("a").alias("file_hash"))
    stored = o.filter(key % 3 != 0).select(key.alias("user_id"), F.when(key % 2 == 0, "a").otherwise("b").alias("file_hash"), F.when(key % 5 < 3, "ready").otherwise("failed").alias("indexing_status"))
    return G.plan_indexing(uploads, stored).drop("file_hash")


@query("SELECT doc_id, nullif(substr(text, 1, 5000), '') AS cleaned_text, nullif(substr(repeat(source, 300), 1, 1000), '') AS error_message FROM documents")
def crawl_logs(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "documents").select("doc_id", F.col("text").alias("cleaned_text"), F.repeat("source", F.lit(300)).alias("error_message"))
    return G.shape_crawl_log(rows)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def erased(spark: SparkSession, d: str) -> DataFrame:
    keys = A.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return G.erase(A.table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", keys)


_FACTOR = "CASE n_evidence WHEN 0 THEN 0.3 ELSE 1.0 END"


def _report_sql() -> str:
    from tidemark.plans.queries import _LABEL, _SCORE, _TIER, _weight

    w = _weight(f"TIMESTAMP '{AS_OF}'").replace(_TIER, _FACTOR)
    return sql("co", "ev", "sg", "pb", _SERIES, f"w AS (SELECT id, company_id, observed_at, {w} AS w FROM pb WHERE observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY)",
        f"r AS (SELECT company_id, sum(w) AS raw, max(observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS recent, string_agg(id, ',' ORDER BY round(abs(w), 9) DESC, id) AS ids FROM w GROUP BY company_id)", f"s AS (SELECT *, {_SCORE} AS momentum_score FROM r)",
        f"b AS (SELECT company_id, arg_max(momentum_score, scored_at) AS before FROM sc WHERE scored_at < TIMESTAMP '{SINCE}' GROUP BY company_id)",
        body=f"SELECT co.id AS company_id, round(coalesce(momentum_score, 0), 6) AS momentum_score, CASE WHEN s.company_id IS NULL THEN 'none' ELSE {_LABEL} END AS momentum_label, round(coalesce(momentum_score, 0) - before, 6) AS score_delta, coalesce(len(string_split(ids, ',')), 0) AS n_ids, coalesce(string_split(ids, ',')[1], '') AS heaviest FROM co LEFT JOIN s ON s.company_id = co.id LEFT JOIN b ON b.company_id = co.id")


@query(_report_sql())
def momentum_report(spark: SparkSession, d: str) -> DataFrame:
    before = _scores(spark, d).filter(F.col("scored_at") < at(SINCE))
    rows = C.momentum_report(A.signals(spark, d), A.profiles(spark, d), before, at(AS_OF))
    ids = F.col("contributing_event_ids")
    return rows.select(
        "company_id", F.round("momentum_score", 6).alias("momentum_score"), "momentum_label", F.round("score_delta", 6).alias("score_delta"), F.size(ids).cast("long").alias("n_ids"),
        F.coalesce(F.get(ids, F.lit(0)).cast("string"), F.lit("")).alias("heaviest"),
    )


_STORED = """st AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS h, o_orderstatus <> 'P' AS a FROM orders WHERE o_orderpriority <> '1-URGENT'), ic AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS h FROM orders WHERE o_orderpriority <> '5-LOW'),
bd AS (SELECT DISTINCT c FROM ic)"""


@query(sql(_STORED, body="""SELECT coalesce(st.k, ic.k) AS k, CASE WHEN st.k IS NULL OR st.h <> ic.h THEN ic.h ELSE st.h END AS h, CASE WHEN ic.k IS NULL THEN '2001-01-01' ELSE '2001-07-30' END AS last_seen, CASE WHEN ic.k IS NULL AND a AND bd.c IS NOT NULL THEN '2001-07-30' END AS closed,
ic.k IS NOT NULL OR (a AND bd.c IS NULL) AS is_active FROM st FULL JOIN ic ON st.k = ic.k AND st.c = ic.c LEFT JOIN bd ON bd.c = coalesce(st.c, ic.c)"""))
def apply_reconciled(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.plans.queries import _snapshots

    stored, incoming = _snapshots(spark, d)
    old = at("2001-01-01 00:00:00")
    stored = stored.withColumns({"first_seen_at": old, "last_seen_at": old, "closed_at": F.lit(None).cast("timestamp_ntz")})
    rows = N.apply_reconciled(stored, incoming, ["k", "c"], "h", at(_JOBS_AS_OF), board=["c"])
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.select("k", "h", day("last_seen_at").alias("last_seen"), day("closed_at").alias("closed"), "is_active")
