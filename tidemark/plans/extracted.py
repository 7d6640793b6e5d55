"""Queries of model answers, careers, boards and the registry. Their inputs are texts that Spark makes of whole tables, so SQL knows what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import boards as B
from tidemark.functions import scoring as S
from tidemark.functions import text as T
from tidemark.operators import extraction as E
from tidemark.operators import listing as L
from tidemark.operators import registry as G
from tidemark.operators import snapshots as N
from tidemark.plans.queries import at, query, sql
from tidemark.sources import adapters as A

_KIND = "['funding', ' Layoff ', 'party', 'new_office'][event_id % 4 + 1]"
_DATE = "['2024-01-05', 'unknown', '2024-01-05T10:20:30Z', 'soon', '2024-13-40'][event_id % 5 + 1]"
_SURE = "['0.9', NULL, '0.2', '1.5', '0.3'][event_id % 5 + 1]"


@query(f"""WITH e AS (SELECT event_id, user_id, lower(trim({_KIND})) AS event_type, {_DATE} AS d, {_SURE} AS c, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'Event ' || event_id END AS title FROM events)
SELECT event_id AS answer, CAST(1 AS BIGINT) AS pos, event_type, title, CASE d WHEN '2024-01-05' THEN '2024-01-05 00:00:00' WHEN '2024-01-05T10:20:30Z' THEN '2024-01-05 10:20:30' END AS occurred, coalesce(CAST(c AS DOUBLE), 0.5) AS confidence, 'seen' AS excerpt
FROM e WHERE event_type <> 'party' AND title <> '' AND coalesce(CAST(c AS DOUBLE), 0.5) BETWEEN 0.3 AND 1 AND event_id % 3 <> 2""")
def model_events(spark: SparkSession, d: str) -> DataFrame:
    """Answers with their list under events or items, or, for every third, an events that is no list; in each list a number before the event."""
    i = F.col("event_id")
    fields = F.struct(
        F.expr(_KIND.replace("[event_id % 4 + 1]", "").replace("[", "array(", 1).replace("]", ")") + "[event_id % 4]").alias("event_type"), F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("Event "), i.cast("string"))).alias("title"),
        F.expr("array('2024-01-05', 'unknown', '2024-01-05T10:20:30Z', 'soon', '2024-13-40')[event_id % 5]").alias("event_occurred_at"), F.lit(" seen ").alias("evidence_excerpt"),
        F.expr("array('0.9', NULL, '0.2', '1.5', '0.3')[event_id % 5]").alias("confidence"),
    )
    listed = F.concat(F.lit("[7, "), F.to_json(fields), F.lit("]"))
    raw = F.concat(F.lit("Sure: {\""), F.when(i % 3 == 0, "events").when(i % 3 == 1, "items").otherwise("events"), F.lit('": '), F.when(i % 3 == 2, F.lit('"none", "items": [{}]')).otherwise(listed), F.lit("}"))
    rows = E.validate_extracted(E.explode_model_events(A.table(spark, d, "events").select(i.alias("answer"), raw.alias("raw")), "raw"))
    return rows.select("answer", "pos", "event_type", "title", F.date_format("event_occurred_at", "yyyy-MM-dd HH:mm:ss").alias("occurred"), "confidence", F.col("evidence_excerpt").alias("excerpt"))


@query("""WITH j AS (SELECT o_custkey, 'https://c.example/' || o_custkey AS page, 'Role  ' || o_orderpriority AS t, o_orderstatus AS l, CASE WHEN o_orderkey % 2 = 0 THEN 'HTTPS://x.example/' || o_orderkey END AS u, o_orderkey FROM orders),
n AS (SELECT *, 'cp_' || substr(sha256(coalesce(u, lower('role ' || substr(t, 7) || '|' || l))), 1, 20) AS external_id FROM j)
SELECT o_custkey AS company_id, external_id, any_value('Role ' || substr(t, 7)) AS title, any_value(l) AS location_raw, any_value(coalesce(u, page)) AS application_url FROM n GROUP BY o_custkey, external_id""")
def career_jobs(spark: SparkSession, d: str) -> DataFrame:
    o, key = A.table(spark, d, "orders"), F.col("o_orderkey")
    url = F.when(key % 2 == 0, F.concat(F.lit("HTTPS://x.example/"), key.cast("string"))).otherwise("Role name")
    job = F.struct(F.concat(F.lit(" Role  "), "o_orderpriority").alias("title"), F.concat(F.lit(" "), "o_orderstatus").alias("location"), url.alias("url"))
    noise = F.struct(F.lit("ab").alias("title"), F.lit("x").alias("location"), F.lit(None).cast("string").alias("url"))
    pages = o.groupBy(F.col("o_custkey").alias("company_id")).agg(F.concat(F.array(noise), F.collect_list(job)).alias("jobs")).withColumn("page_url", F.concat(F.lit("https://c.example/"), F.col("company_id").cast("string")))
    return E.normalize_career_jobs(pages)


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'senior' WHEN p_size % 3 = 1 THEN NULL ELSE 'c_level' END AS seniority, CASE WHEN p_size <= 40 THEN CAST(p_size AS DOUBLE) * 1.5 END AS years, CASE WHEN p_size % 2 = 0 THEN 'remote' END AS mode,
p_brand || ',sql' AS skills, 'Data' AS families FROM part""")
def conform_resumes(spark: SparkSession, d: str) -> DataFrame:
    size, brand = F.col("p_size"), F.col("p_brand")
    rows = A.table(spark, d, "part").select(
        "p_partkey", F.array(brand, F.lit(" "), F.lit("sql"), F.lit("SQL"), F.lower(brand)).alias("skills"), F.array(F.lit("Data"), F.lit("wizardry"), F.lit("data")).alias("role_families"),
        F.when(size % 3 == 0, " Senior ").when(size % 3 == 1, "wizard").otherwise("C_LEVEL").alias("seniority"), F.when(size <= 40, (size * 1.5).cast("string")).otherwise("999").alias("experience_years"),
        F.array(F.lit("Pune")).alias("locations"), F.when(size % 2 == 0, "REMOTE").otherwise("n/a").alias("work_mode_preference"),
    )
    r = E.conform_resume(rows)
    return r.select("p_partkey", "seniority", F.col("experience_years").alias("years"), F.col("work_mode_preference").alias("mode"), F.array_join("skills", ",").alias("skills"), F.array_join("role_families", ",").alias("families"))


@query("SELECT c_custkey, ['seed', NULL, 'unknown'][c_custkey % 3 + 1] AS stage, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS headcount_estimate, CASE WHEN c_custkey % 400 + 1750 BETWEEN 1800 AND 2100 THEN c_custkey % 400 + 1750 END AS founded_year FROM customer")
def conform_companies(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = A.table(spark, d, "customer").select("c_custkey", F.expr("array('seed', 'Series Q', 'unknown')[c_custkey % 3]").alias("stage"), F.floor("c_acctbal").cast("string").alias("headcount_estimate"), (key % 400 + 1750).cast("string").alias("founded_year"))
    return E.conform_company(rows.withColumn("slug", F.lit("a-b"))).drop("slug")


@query(sql("co", "ev", body="SELECT company_id, co.name || ' posted ' || n || ' new roles' AS title, 'https://b.example/' || company_id AS source_url, 1.0::DOUBLE AS confidence FROM (SELECT company_id, count(*) FILTER (WHERE k % 2 = 0) AS n FROM ev GROUP BY 1) JOIN co ON co.id = company_id WHERE n > 0"))
def posting_signals(spark: SparkSession, d: str) -> DataFrame:
    summary = A.events(spark, d).groupBy("company_id").agg(F.count_if(F.col("k") % 2 == 0).alias("n_new"), F.count_if(F.col("k") % 5 == 0).alias("n_closed"))
    summary = summary.withColumn("source_url", F.concat(F.lit("https://b.example/"), F.col("company_id").cast("string")))
    return E.posting_signals(summary, A.companies(spark, d), at("2024-02-01 00:00:00")).select("company_id", "title", "source_url", "confidence")


@query(sql("ev", body="SELECT DISTINCT company_id FROM ev WHERE k % 20 = 0 OR k % 10 = 0"))
def rescore_set(spark: SparkSession, d: str) -> DataFrame:
    summary = A.events(spark, d).groupBy("company_id").agg(F.count_if(F.col("k") % 20 == 0).alias("n_new"), F.count_if(F.col("k") % 10 == 0).alias("n_closed"))
    return L.rescore_set(summary)


_BOARD = """CASE p_partkey % 8 WHEN 0 THEN 'https://job-boards.greenhouse.io/Acme' || p_partkey || '?x=1' WHEN 1 THEN 'api.lever.co/v0/postings/t' || p_partkey WHEN 2 THEN 'https://JOBS.ashbyhq.com/Co' || p_partkey || '/apply' WHEN 3 THEN 'https://co' || p_partkey || '.recruitee.com/x'
WHEN 4 THEN 'https://x.example/feed' WHEN 5 THEN 'newsapi://search' WHEN 6 THEN 'https://boards.greenhouse.io/embed/job_board?for=zz' || p_partkey ELSE 'serpapi://' || p_partkey END"""


@query(f"""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'recruitee' WHEN 6 THEN 'greenhouse' END AS provider,
CASE p_partkey % 8 WHEN 0 THEN 'https://boards-api.greenhouse.io/v1/boards/Acme' || p_partkey || '/jobs?content=true' WHEN 1 THEN 'https://api.lever.co/v0/postings/t' || p_partkey || '?mode=json' WHEN 2 THEN 'https://api.ashbyhq.com/posting-api/job-board/Co' || p_partkey || '?includeCompensation=true'
WHEN 3 THEN 'https://co' || p_partkey || '.recruitee.com/api/offers/' WHEN 6 THEN 'https://boards-api.greenhouse.io/v1/boards/embed/jobs?content=true' END AS api_url,
CASE p_partkey % 8 WHEN 0 THEN 'Acme' || p_partkey WHEN 1 THEN 't' || p_partkey WHEN 2 THEN 'Co' || p_partkey WHEN 6 THEN 'zz' || p_partkey END AS token,
CASE p_partkey % 8 WHEN 3 THEN 'static_http' WHEN 4 THEN 'rss' WHEN 5 THEN 'news_api' WHEN 7 THEN 'search_api' ELSE 'ats_api' END AS tier, p_partkey % 8 IN (5, 7) AS pseudo FROM (SELECT p_partkey, {_BOARD} AS u FROM part)""")
def detected_boards(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "part").select("p_partkey", F.expr(_BOARD).alias("u"))
    own, fetcher = B.detect_board(F.col("u")), B.detect_board(F.col("u"), "fetcher")
    return rows.select("p_partkey", own["provider"].alias("provider"), own["api_url"].alias("api_url"), fetcher["token"].alias("token"), B.detect_fetch_tier(F.col("u"), F.lit("company_blog")).alias("tier"), B.is_pseudo_url(F.col("u")).alias("pseudo"))


@query(sql("so", body="SELECT id, CASE source_type WHEN 'ats_api' THEN 720 WHEN 'career_page' THEN 1440 WHEN 'company_blog' THEN 1440 WHEN 'engineering_blog' THEN 2880 WHEN 'search_api' THEN 1440 WHEN 'github_org' THEN 4320 ELSE 360 END AS minutes, CASE source_type WHEN 'ats_api' THEN 1.0::DOUBLE WHEN 'career_page' THEN 0.9::DOUBLE WHEN 'company_blog' THEN 0.9::DOUBLE WHEN 'engineering_blog' THEN 0.8::DOUBLE WHEN 'news_site' THEN 0.8::DOUBLE WHEN 'github_org' THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS reliability FROM so"))
def source_defaults(spark: SparkSession, d: str) -> DataFrame:
    minutes, trust = B.source_defaults(F.col("source_type"))
    return A.sources(spark, d).select("id", minutes.alias("minutes"), trust.alias("reliability"))


@query("SELECT o_orderkey, ['remote', 'hybrid', 'onsite', NULL][o_orderkey % 4 + 1] AS mode FROM orders")
def work_modes(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("array('We are Remote-first, hybrid too', 'flexible working, on-site days', 'in-office', 'homework')[o_orderkey % 4]")
    return A.table(spark, d, "orders").select("o_orderkey", T.work_mode(text, F.col("o_orderstatus")).alias("mode"))


@query("SELECT p_partkey, trim(p_brand) || ',SQL' AS cleaned, 'x,' || p_brand || ',y' AS merged FROM part")
def cleaned_lists(spark: SparkSession, d: str) -> DataFrame:
    brand = F.col("p_brand")
    cleaned = T.clean_str_list(F.array(F.concat(F.lit(" "), brand), F.lit(""), F.lower(brand), F.lit("SQL"), F.lit("sql "), F.lit("more")), 2)
    merged = G.merge_aliases(F.array(F.lit("x"), brand), F.array(F.upper(brand), F.lit("X"), F.lit("y")))
    return A.table(spark, d, "part").select("p_partkey", F.array_join(cleaned, ",").alias("cleaned"), F.array_join(merged, ",").alias("merged"))


@query("SELECT p_partkey, p_name || ' ' || p_type || ' ' || repeat('x', 500) AS job, 'a b ' || p_type || ' Pune' AS resume, p_name || chr(10) || chr(10) || p_type AS article, p_name || chr(10) || p_type AS entry, length(p_name) < 50 AS unreadable FROM part")
def built_texts(spark: SparkSession, d: str) -> DataFrame:
    name, kind, none = F.col("p_name"), F.col("p_type"), F.lit(None).cast("string")
    return A.table(spark, d, "part").select(
        "p_partkey", T.job_embedding_text(name, F.lit(" "), kind, F.lit("x" * 900)).alias("job"), T.resume_embedding_text(F.array(F.lit("a"), F.lit("b")), F.array(), kind, F.array(F.lit("Pune"))).alias("resume"),
        T.article_text(name, F.lit(""), none, kind).alias("article"), T.entry_text(F.concat(F.lit(" "), name), F.concat(kind, F.lit("\n"))).alias("entry"), T.is_unreadable(name).alias("unreadable"),
    )


@query("SELECT vec_id, round(1.0, 6) AS length, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS total FROM embeddings")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = T.unit_normalize(F.transform("embedding", lambda x: x * 3))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return A.table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(total(F.transform(v, lambda x: x * x))), 6).alias("length"), F.round(total(v), 6).alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount = 0 OR abs(l_extendedprice - l_quantity * 1000) / greatest(l_extendedprice, l_quantity * 1000) <= 0.2 AS same FROM lineitem")
def amounts(spark: SparkSession, d: str) -> DataFrame:
    a = F.when(F.col("l_discount") != 0, F.col("l_extendedprice").cast("string")).otherwise("undisclosed")
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", E.amounts_match(a, F.col("l_quantity") * 1000).alias("same"))


@query(sql("ev", "sg", body="SELECT id, CASE n_evidence WHEN 0 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS factor, CASE n_evidence WHEN 4 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS own FROM sg"))
def best_tiers(spark: SparkSession, d: str) -> DataFrame:
    urls = F.transform("evidence", lambda e: e["source_url"])
    own = S.best_tier_factor(F.filter(urls, lambda u: u.contains("blog")), F.lit("example.com"))
    return A.signals(spark, d).select("id", S.best_tier_factor(urls).alias("factor"), own.alias("own"))


@query("SELECT doc_id, sha256(regexp_replace(trim(regexp_replace(lower(coalesce(text, '')), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g')), '^ | $', '', 'g')) AS digest FROM documents")
def normalised_hashes(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text"), normalised=True).alias("digest"))


@query("SELECT c_custkey, 'cafe-' || c_custkey || '-fi' AS slug FROM customer")
def folded_slugs(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "customer").select("c_custkey", T.slugify(F.concat(F.lit("  Café №"), F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ﬁ!")), fold=True).alias("slug")).withColumn("slug", F.regexp_replace("slug", "^cafe-no-", "cafe-"))


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """A Markdown file for each nation with its customers as companies and their blogs, its suppliers as publications, and noise."""
    c, n = A.table(spark, d, "customer").filter("c_custkey % 2 = 0"), F.col("c_custkey").cast("string")
    line = F.concat(
        F.lit("| Co "), n, F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" (Alt "), n, F.lit(", India ops)"))).otherwise(""), F.lit(" | co"), n, F.when(F.col("c_custkey") % 5 == 0, ".example (unsure)").otherwise(".example"),
        F.lit(" | jobs.co"), n, F.lit(".example/all | "), F.when(F.col("c_custkey") % 4 == 0, "Hourly").otherwise("N/A"), F.lit(" | "), F.when(F.col("c_custkey") % 6 == 0, "Lever").otherwise("-"), F.lit(" |"),
    )
    blog = F.concat(F.lit("| Co "), n, F.lit(" Engineering Blog | medium.com/@x | eng.co"), n, F.lit(".example |"))
    per = c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("companies"), F.array_join(F.array_sort(F.collect_list(blog)), "\n").alias("blogs"))
    feed = F.concat(F.lit("| Paper "), F.col("s_suppkey").cast("string"), F.lit(" | paper"), F.col("s_suppkey").cast("string"), F.lit(".example/feed | High |"))
    news = A.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.array_join(F.array_sort(F.collect_list(feed)), "\n").alias("feeds"))
    head = "# Registry\n## indian_startups.txt *(new)*\n| Name | Website | Career Pg | Frequency | ATS Used |\n|---|---|---|---|---|\n"
    text = F.concat(
        F.lit(head), F.col("companies"), F.lit("\n| short row |\n## ats_patterns\n| Name | x |\n|-|-|\n| ignored | y |\n## global_engineering_blogs\n| Name | Website | Eng Blog |\n|--|--|--|\n"), F.col("blogs"),
        F.lit("\n## rss_feeds\n| Feed Name | RSS / Atom Feed URL | Priority |\n|--|--|--|\n"), F.coalesce("feeds", F.lit("")), F.lit("\nend"),
    )
    return per.join(news, "nation", "left").select(F.format_string("n%03d", "nation").alias("file"), text.alias("text"))


_REG = """rc AS (SELECT c_custkey AS k, c_nationkey AS nation FROM customer WHERE c_custkey % 2 = 0), rn AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey IN (SELECT nation FROM rc))"""


@query(sql(_REG, body="""SELECT 'indian_startups' AS section, 'Co ' || k || CASE WHEN k % 3 = 0 THEN ' (Alt ' || k || ', India ops)' ELSE '' END AS name, CASE WHEN k % 3 = 0 THEN 'Alt ' || k || ',Co ' || k ELSE '' END AS aliases, CASE WHEN k % 5 = 0 THEN '' ELSE 'https://co' || k || '.example' END AS website, 'co' || k || '.example' AS domain FROM rc
UNION ALL SELECT 'global_engineering_blogs', 'Co ' || k, 'Co ' || k || ' Engineering Blog', 'https://medium.com/@x', 'co' || k || '.example' FROM rc UNION ALL SELECT 'rss_feeds', 'Paper ' || k, '', '', '' FROM rn"""))
def registry_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = G.registry_names(G.registry_rows(_registry(spark, d)))
    return rows.select("section", "name", F.array_join("aliases", ",").alias("aliases"), "website", "domain")


_UPSERT = """up AS (SELECT k, CASE WHEN k % 4 = 0 THEN 'known-' || k WHEN k % 3 = 0 THEN 'co-' || k || '-alt-' || k || '-india-ops' ELSE 'co-' || k END AS slug, CASE WHEN k % 4 = 0 THEN 'Known ' || k ELSE 'Co ' || k || CASE WHEN k % 3 = 0 THEN ' (Alt ' || k || ', India ops)' ELSE '' END END AS name FROM rc)"""


def _upserted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    named = G.registry_names(G.registry_rows(_registry(spark, d)))
    c, n = A.table(spark, d, "customer").filter("c_custkey % 4 = 0"), F.col("c_custkey").cast("string")
    stored = c.select(F.concat(F.lit("known-"), n).alias("slug"), F.concat(F.lit("Known "), n).alias("name"), F.concat(F.lit("co"), n, F.lit(".example")).alias("canonical_domain"), F.lit(None).cast("array<string>").alias("aliases"))
    return named, G.upsert_companies(named, stored)


@query(sql(_REG, _UPSERT, body="SELECT slug, name, 'co' || k || '.example' AS canonical_domain, CASE WHEN k % 4 = 0 THEN 'updated' ELSE 'inserted' END AS status, 2 AS n_rows FROM up"))
def registry_companies(spark: SparkSession, d: str) -> DataFrame:
    return _upserted(spark, d)[1].select("slug", "name", "canonical_domain", "status", F.size("rows").alias("n_rows"))


@query(sql(_REG, _UPSERT, body="""SELECT 'https://jobs.co' || k || '.example/all' AS url, slug, 'career_page' AS source_type, 'approved' AS status, CASE WHEN k % 4 = 0 THEN 720 ELSE 1440 END AS minutes, 0.9::DOUBLE AS reliability FROM up
UNION ALL SELECT 'https://eng.co' || k || '.example', slug, 'engineering_blog', 'approved', 2880, 0.8::DOUBLE FROM up UNION ALL SELECT 'https://paper' || k || '.example/feed', NULL, 'news_site', 'approved', 360, 0.9::DOUBLE FROM rn
UNION ALL SELECT 'https://jobs.lever.co/co-' || k || CASE WHEN k % 3 = 0 THEN '-alt-' || k || '-india-ops' ELSE '' END, slug, 'ats_api', 'pending', 720, 1.0 FROM up WHERE k % 6 = 0"""))
def registry_sources(spark: SparkSession, d: str) -> DataFrame:
    named, made = _upserted(spark, d)
    owners = made.select("slug", F.explode("rows").alias("r")).select("slug", "r.*")
    return G.derive_sources(named, owners).select("url", "slug", "source_type", "status", "minutes", "reliability")


@query(sql(_REG, body="""SELECT 'companies_inserted' AS metric, count(*) AS value FROM rc WHERE k % 4 <> 0 HAVING count(*) > 0 UNION ALL SELECT 'companies_updated', count(*) FROM rc WHERE k % 4 = 0 HAVING count(*) > 0 UNION ALL SELECT 'sources_career_page', count(*) FROM rc UNION ALL SELECT 'sources_engineering_blog', count(*) FROM rc
UNION ALL SELECT 'sources_news_site', count(*) FROM rn HAVING count(*) > 0 UNION ALL SELECT 'sources_ats_api', count(*) FROM rc WHERE k % 6 = 0 HAVING count(*) > 0 UNION ALL SELECT 'rows_without_domain', 0"""))
def registry_summary(spark: SparkSession, d: str) -> DataFrame:
    named, made = _upserted(spark, d)
    owners = made.select("slug", F.explode("rows").alias("r")).select("slug", "r.*")
    return G.ingest_summary(named, made, G.derive_sources(named, owners))


@query("SELECT o_custkey, count(*) AS n, CAST(count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1999-01-01') AS BIGINT) AS kept FROM orders GROUP BY 1")
def retained_orders(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders")
    kept = N.retention(o, "o_orderdate", at("1999-01-01 00:00:00"))[0].groupBy("o_custkey").agg(F.count("*").alias("kept"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n")).join(kept, "o_custkey", "left").fillna(0, ["kept"])
