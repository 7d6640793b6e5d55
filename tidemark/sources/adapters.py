"""The driver's tables in the shape of the canonical entities (companies, events, jobs, pages)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = {"purchase": "funding", "signup": "engineering_expansion", "click": "partnership", "view": "career_page_update", "error": "layoff"}
#: Evidence by the event's k modulo 5: one of each tier.
EVIDENCE = ("https://boards.greenhouse.io/acme", "https://techcrunch.com/story", "https://newsapi.org/item", "https://blog.example.com/post", None)
INDUSTRY_OF = "c_mktsegment"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.regexp_replace(F.lower("c_name"), "[^a-z0-9]+", "-").alias("slug"), F.col(INDUSTRY_OF).alias("industry"), (F.col("c_acctbal") > 0).alias("is_active"), F.col("c_nationkey").cast("long").alias("nation"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("long"))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv]), F.col("event_type"))
    url = F.get(F.array(*[F.lit(u) for u in EVIDENCE]), (F.col("k") % 5).cast("int"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("company_id"), kind.alias("event_type"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"), F.col("ts").alias("observed_at"), F.lit(None).cast("timestamp_ntz").alias("occurred_at"), (F.col("k") % 6 + 1).alias("source_count"), url.alias("source_url"), "k")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_orderdate").alias("first_seen_at"), (F.col("o_orderstatus") != "F").alias("is_active"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("role_family"), F.col("o_totalprice").alias("price"))


#: The same tables as DuckDB common table expressions.
SQL = {
    "co": "co AS (SELECT c_custkey AS id, c_name AS name, regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS slug, c_mktsegment AS industry, c_acctbal > 0 AS is_active FROM customer)",
    "ev": """ev AS (SELECT event_id AS id, user_id AS company_id, CASE event_type WHEN 'purchase' THEN 'funding' WHEN 'signup' THEN 'engineering_expansion' WHEN 'click' THEN 'partnership' WHEN 'view' THEN 'career_page_update' ELSE 'layoff' END AS event_type,
      'event ' || event_id AS title, ts AS observed_at, k % 6 + 1 AS source_count, k, CASE k % 5 WHEN 0 THEN 'https://boards.greenhouse.io/acme' WHEN 1 THEN 'https://techcrunch.com/story' WHEN 2 THEN 'https://newsapi.org/item' WHEN 3 THEN 'https://blog.example.com/post' END AS source_url
      FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events))""",
    "jb": "jb AS (SELECT o_orderkey AS id, o_custkey AS company_id, o_orderdate AS first_seen_at, o_orderstatus <> 'F' AS is_active, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS role_family, o_totalprice AS price FROM orders)",
}


#: Source types and statuses by a part's keys.
SOURCE_TYPES = ("ats_api", "career_page", "rss_feed", "company_blog", "engineering_blog", "news_site", "news_api", "search_api", "github_org")
SOURCE_STATUS = ("approved", "approved", "pending", "disabled")
#: What happened, by the event type, and what tells two happenings apart.
REPORT_TYPES = {"purchase": "funding", "signup": "leadership_change", "click": "new_office", "view": "acquisition", "error": "partnership"}
ROLES = ("VP of Engineering", "VP Engineering", "Chief Designer")


def _of(values: tuple[str, ...], i: Column) -> Column:
    """The value at i modulo the number of values."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(i, F.lit(len(values))).cast("int"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies in full: domain, aliases, stage, description, when they were added."""
    c, key = companies(spark, sf_dir), F.col("id").cast("string")
    return c.withColumns({
        "canonical_domain": F.concat("slug", F.lit(".example")), "aliases": F.array(F.concat(F.lit("Alias "), key)), "stage": _of(("seed", "growth", "public"), F.col("id")),
        "description": F.concat(F.lit("maker of "), F.lower("industry")), "created_at": F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.pmod("id", F.lit(31)).cast("int")),
    })


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with what readers may see of them: is_canonical, status, and all evidence (one entry of each tier but the last k has)."""
    e, urls = events(spark, sf_dir), F.array(*[F.lit(u) for u in EVIDENCE[:4]])
    evidence = F.transform(F.slice(urls, 1, (F.col("k") % 5).cast("int")), lambda u: F.struct(u.alias("source_url")))
    return e.withColumns({"is_canonical": F.col("k") % 7 != 0, "status": F.when(F.col("k") % 11 == 0, "retracted").otherwise("active"), "evidence": evidence})


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event reports with structured data, for dedup."""
    e, k = events(spark, sf_dir), F.col("k")
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.element_at(F.create_map(*[F.lit(x) for kv in REPORT_TYPES.items() for x in kv]), F.col("event_type")).alias("kind"))
    e = e.join(raw, "id").drop("event_type", "title").withColumnRenamed("kind", "event_type")
    return e.withColumns({
        "title": F.concat(F.lit("Partnership "), (k % 4).cast("string")), "round": F.when(k % 5 != 0, _of(("Series A", "series b"), k)), "amount_usd": F.when(k % 3 != 0, ((k % 8) * 1_000_000).cast("string")),
        "person": F.concat(F.lit("Person "), (k % 3).cast("string")), "role": F.when(k % 4 != 0, _of(ROLES, k)), "city": F.when(k % 6 != 0, _of(("Pune", "pune ", "Delhi"), k)),
        "target": F.when(k % 7 != 0, F.concat(F.lit("Target "), (k % 4).cast("string"))), "confidence": (k % 10) / 10.0,
    })


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job postings in full."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    title = F.concat(_of(("Senior Data Engineer", "Product Designer", "Sales Lead", "Engineering Intern"), key), F.lit(" "), "o_orderpriority")
    return o.select(
        key.alias("id"), F.col("o_custkey").alias("company_id"), title.alias("title"), F.lower("o_orderpriority").alias("description_text"), F.lit(None).cast("string").alias("department"),
        _of(("data", "design", "sales", "engineering"), key).alias("role_family"), _of(("senior", "mid", "intern"), key).alias("seniority"), _of(("remote", "hybrid", "onsite"), F.floor(key / 4)).alias("work_mode"),
        F.col("o_orderdate").alias("first_seen_at"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("last_seen_at"), (F.col("o_orderstatus") != "F").alias("is_active"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("closed_at"), F.concat("o_orderstatus", F.pmod(key, F.lit(50)).cast("string")).alias("content_hash"),
        F.when(F.pmod(key, F.lit(3)) == 0, F.array(key.cast("float"), F.lit(1.0).cast("float"))).alias("embedding"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled sources: one for each part; every seventh covers many companies."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    kind = _of(SOURCE_TYPES, F.col("p_size"))
    day = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.pmod(key, F.lit(40)).cast("int"))
    return p.select(
        key.alias("id"), F.when(key % 7 != 0, F.pmod(key, F.lit(300))).alias("company_id"), F.concat(F.lit("https://s.example/"), key.cast("string")).alias("url"), kind.alias("source_type"),
        F.when(kind == "ats_api", "ats_api").otherwise("static_http").alias("fetch_tier"), _of(SOURCE_STATUS, key).alias("status"), F.when(key % 9 != 0, day).alias("next_crawl_at"),
        (F.col("p_size") % 4).cast("long").alias("consecutive_failures"), day.alias("created_at"), F.pmod(key, F.lit(5)).alias("submitted_by"),
    )


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    day = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.pmod(key, F.lit(31)).cast("int"))
    return c.select(key.alias("id"), F.concat(F.lower("c_name"), F.lit("@mail.example")).alias("email"), (key % 4 != 0).alias("is_active"), F.when(key % 3 != 0, day + F.expr("INTERVAL 1 DAY")).alias("confirmed_at"), day.alias("created_at"))


SQL |= {
    "pf": "pf AS (SELECT *, slug || '.example' AS canonical_domain, ['Alias ' || id] AS aliases, ['seed', 'growth', 'public'][id % 3 + 1] AS stage, 'maker of ' || lower(industry) AS description, TIMESTAMP '2024-01-01' + to_days(CAST(id % 31 AS INTEGER)) AS created_at FROM co)",
    "sg": "sg AS (SELECT *, k % 7 <> 0 AS is_canonical, CASE WHEN k % 11 = 0 THEN 'retracted' ELSE 'active' END AS status, k % 5 AS n_evidence FROM ev)",
    "pb": "pb AS (SELECT * FROM sg WHERE is_canonical AND status = 'active')",
    "rp": """rp AS (SELECT ev.id, ev.company_id, ev.observed_at, ev.source_url, CASE e.event_type WHEN 'purchase' THEN 'funding' WHEN 'signup' THEN 'leadership_change' WHEN 'click' THEN 'new_office' WHEN 'view' THEN 'acquisition' ELSE 'partnership' END AS event_type,
      k % 4 AS f_title, CASE WHEN k % 5 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'series a' ELSE 'series b' END ELSE '' END AS f_round, CASE WHEN k % 3 <> 0 THEN k % 8 * 1000000.0 END AS f_amount, k % 3 AS f_person,
      CASE WHEN k % 4 <> 0 THEN CASE WHEN k % 3 = 2 THEN 'b' ELSE 'a' END ELSE '' END AS f_role, CASE WHEN k % 6 <> 0 THEN CASE WHEN k % 3 = 2 THEN 'delhi' ELSE 'pune' END ELSE '' END AS f_city, CASE WHEN k % 7 <> 0 THEN 'target ' || (k % 4) ELSE '' END AS f_target,
      k % 10 / 10.0 AS confidence FROM ev JOIN events e ON e.event_id = ev.id)""",
    "ro": """ro AS (SELECT o_orderkey AS id, o_custkey AS company_id, ['Senior Data Engineer', 'Product Designer', 'Sales Lead', 'Engineering Intern'][o_orderkey % 4 + 1] || ' ' || o_orderpriority AS title, lower(o_orderpriority) AS description_text,
      ['data', 'design', 'sales', 'engineering'][o_orderkey % 4 + 1] AS role_family, ['senior', 'mid', 'intern'][o_orderkey % 3 + 1] AS seniority, ['remote', 'hybrid', 'onsite'][o_orderkey // 4 % 3 + 1] AS work_mode, o_orderdate AS first_seen_at,
      o_orderdate + INTERVAL 30 DAY AS last_seen_at, o_orderstatus <> 'F' AS is_active, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 60 DAY END AS closed_at, o_orderstatus || (o_orderkey % 50) AS content_hash, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS vec FROM orders)""",
    "so": """so AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 300 END AS company_id, 'https://s.example/' || p_partkey AS url, ['ats_api', 'career_page', 'rss_feed', 'company_blog', 'engineering_blog', 'news_site', 'news_api', 'search_api', 'github_org'][p_size % 9 + 1] AS source_type,
      CASE WHEN p_size % 9 = 0 THEN 'ats_api' ELSE 'static_http' END AS fetch_tier, ['approved', 'approved', 'pending', 'disabled'][p_partkey % 4 + 1] AS status, CASE WHEN p_partkey % 9 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 40 AS INTEGER)) END AS next_crawl_at,
      CAST(p_size % 4 AS BIGINT) AS consecutive_failures, TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 40 AS INTEGER)) AS created_at, p_partkey % 5 AS submitted_by FROM part)""",
    "sb": "sb AS (SELECT c_custkey AS id, lower(c_name) || '@mail.example' AS email, c_custkey % 4 <> 0 AS is_active, CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '2024-01-02' + to_days(CAST(c_custkey % 31 AS INTEGER)) END AS confirmed_at, TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 31 AS INTEGER)) AS created_at FROM customer)",
}


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with a time of occurrence: none, long before they were observed (some beyond the lookback), the day before, or in the future."""
    s, k = signals(spark, sf_dir), F.col("k")
    back = F.make_dt_interval((k * 3).cast("int"))
    day = F.expr("INTERVAL 1 DAY")
    return s.withColumn("occurred_at", F.when(k % 4 == 1, F.col("observed_at") - back).when(k % 4 == 2, F.col("observed_at") + F.expr("INTERVAL 20 DAYS")).when(k % 4 == 3, F.col("observed_at") - day))


SQL["dt"] = "dt AS (SELECT *, CASE k % 4 WHEN 1 THEN observed_at - to_days(CAST(k * 3 AS INTEGER)) WHEN 2 THEN observed_at + INTERVAL 20 DAY WHEN 3 THEN observed_at - INTERVAL 1 DAY END AS occurred_at FROM sg)"
