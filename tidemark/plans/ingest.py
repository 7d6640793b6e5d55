"""Queries of the operators that read raw payloads and pages. Payloads are made by Spark from whole tables, so SQL knows what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import mentions as M
from tidemark.operators import pages as P
from tidemark.plans.queries import _limited, query
from tidemark.sources import adapters as A
from tidemark.sources import vendors as V
from tidemark.streaming import changes as ST

_PROVIDER = "CASE o_custkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END"


@query(f"""SELECT o_custkey AS company_id, {_PROVIDER} AS provider, CAST(o_orderkey AS VARCHAR) AS external_id, 'Order ' || o_orderkey AS title, 'a' || chr(10) || 'b & c' AS description_text,
o_orderpriority AS department, o_orderstatus AS location_raw, 'https://x.example/' || o_orderkey AS application_url FROM orders""")
def board_postings(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders")
    i, title, link = F.col("o_orderkey"), F.concat(F.lit(" Order "), F.col("o_orderkey").cast("string")), F.concat(F.lit("https://x.example/"), F.col("o_orderkey").cast("string"))
    named = lambda c: F.struct(F.col(c).alias("name"))
    html, empty = F.lit("&lt;p&gt;a&lt;/p&gt;&lt;div&gt;b &amp;amp; c&lt;/div&gt;"), F.lit("")
    g = F.struct(i.alias("id"), title.alias("title"), html.alias("content"), F.array(F.struct(empty.alias("name")), named("o_orderpriority")).alias("departments"), F.array(named("o_orderstatus")).alias("offices"), link.alias("absolute_url"))
    cat = F.struct(empty.alias("department"), F.col("o_orderpriority").alias("team"), F.col("o_orderstatus").alias("location"))
    lv = F.struct(i.alias("id"), title.alias("text"), empty.alias("descriptionPlain"), html.alias("description"), cat.alias("categories"), link.alias("applyUrl"))
    a = F.struct(i.alias("id"), title.alias("title"), html.alias("descriptionHtml"), F.col("o_orderpriority").alias("team"), F.col("o_orderstatus").alias("location"), link.alias("jobUrl"))
    payload = F.when(F.col("provider") == "greenhouse", F.to_json(F.struct(F.array(g).alias("jobs")))).when(F.col("provider") == "lever", F.to_json(F.array(lv))).otherwise(F.to_json(F.struct(F.array(a).alias("jobs"))))
    raw = o.withColumn("provider", F.expr(_PROVIDER)).select(F.col("o_custkey").alias("company_id"), "provider", payload.alias("payload"))
    return V.normalize_postings(raw, "provider", "payload").drop("published_at")


@query("SELECT page_id, CAST(0 AS BIGINT) AS pos, CASE WHEN page_id % 2 = 0 THEN 't' || page_id ELSE '' END AS title, url AS link, CASE WHEN page_id % 2 = 0 THEN 'b' ELSE html END AS body FROM pages")
def feed_entries(spark: SparkSession, d: str) -> DataFrame:
    entry = F.struct(F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("title"), F.col("url").alias("link"), F.lit("b").alias("body"))
    listed = F.concat(F.lit("["), F.to_json(entry), F.lit(", 7]"))
    p = A.table(spark, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 2 == 0, listed).otherwise(F.col("html")).alias("payload"))
    return V.explode_feed_entries(p, "url", "payload").select("page_id", "pos", "title", "link", "body")


@query()
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    return P.page_texts(A.table(spark, d, "pages"))


@query()
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of the pages, each with two of its own after it, as many pages keep all theirs in their navigation."""
    own = F.concat(F.lit('<p><a href="/p/'), F.col("page_id").cast("string"), F.lit('"> Page <b>one</b></a> <a href="#top">top</a><a href="next">next</a></p>'))
    return P.extract_links(A.table(spark, d, "pages").select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), own).alias("html")))


_URL = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'http://172.' || (page_id % 64) || '.0.1:80/x#f' WHEN 2 THEN 'ftp://a.example/' WHEN 3 THEN 'HTTP://API.LocalHost/a' WHEN 4 THEN ' HTTPS://User@Ex.Example/P?q#z' ELSE 'http://[::ffff:10.0.0.1]/' END"


@query(f"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN CASE WHEN page_id % 64 BETWEEN 16 AND 31 THEN 'address' ELSE 'ok' END WHEN 2 THEN 'scheme' WHEN 3 THEN 'private' WHEN 4 THEN 'ok' ELSE 'address' END AS reason,
CASE WHEN page_id % 6 = 0 THEN regexp_replace(url, '#.*$', '') WHEN page_id % 6 = 1 AND page_id % 64 NOT BETWEEN 16 AND 31 THEN 'http://172.' || (page_id % 64) || '.0.1:80/x' WHEN page_id % 6 = 4 THEN 'https://user@ex.example/P?q' END AS url_norm FROM pages""")
def url_policy(spark: SparkSession, d: str) -> DataFrame:
    return P.url_policy(A.table(spark, d, "pages").select("page_id", F.expr(_URL).alias("u")), "u").select("page_id", "reason", "url_norm")


@query("""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[ \\t' || chr(160) || ']+', ' ', 'g') AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(t, ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS sha256 FROM t""")
def normalised_texts(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", F.sha2(T.normalize_document_text(F.col("text")), 256).alias("sha256"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN role END AS role FROM conversations")
def model_json(spark: SparkSession, d: str) -> DataFrame:
    made, kind = F.to_json(F.struct("role", "text")), F.col("turn") % 4
    raw = F.when(kind == 0, F.concat(F.lit("```json\n"), made, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Here it is: "), made, F.lit(" Done."))).when(kind == 2, F.concat(F.lit("["), made, F.lit("]"))).otherwise("no object } here {")
    return A.table(spark, d, "conversations").select("conv_id", "turn", F.try_variant_get(T.parse_model_json(raw), "$.role", "string").alias("role"))


@query("""WITH p AS (SELECT *, CASE p_size % 4 WHEN 0 THEN 'senior' WHEN 1 THEN 'mid' WHEN 2 THEN 'c_level' END AS lv FROM part),
r AS (SELECT p_partkey, p_size, list_filter([CASE WHEN p_size % 7 < 3 THEN 'You have 2 matching skills: ' || upper(p_brand) || ', SQL' END, CASE WHEN p_size % 5 = 0 THEN 'This data role matches your experience' END,
CASE lv WHEN 'senior' THEN 'Senior level matches your profile' WHEN 'mid' THEN CASE WHEN p_size * 0.5 BETWEEN 2 AND 5 THEN 'Mid level matches your ' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size * 0.5 AS DOUBLE)::VARCHAR END || ' years of experience' END
WHEN 'c_level' THEN CASE WHEN p_size * 0.5 BETWEEN 15 AND 40 THEN 'C Level level matches your ' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size * 0.5 AS DOUBLE)::VARCHAR END || ' years of experience' END END,
CASE WHEN p_size % 11 = 0 THEN 'This role is in New Pune, where you''re based' END, CASE WHEN p_size % 9 = 0 THEN 'Remote work matches your preference' END], lambda x: x IS NOT NULL) AS r FROM p)
SELECT p_partkey, CASE WHEN len(r) = 0 THEN 'Your profile is a ' || p_size || '% semantic match for this role' ELSE array_to_string(r, '|') END AS reasons FROM r""")
def explain_match(spark: SparkSession, d: str) -> DataFrame:
    size, no = F.col("p_size"), F.lit(None).cast("string")
    resume = {"skills": F.array(F.upper("p_brand"), F.lit("SQL"), F.lit(" ")), "role_families": F.array(F.lit("Data")), "seniority": F.lit("senior"), "years": size * 0.5, "locations": F.array(F.lit(" "), F.lit("pune")), "work_mode": F.lit("remote")}
    job = {
        "skills": F.when(size % 7 < 3, F.array(F.lower("p_brand"), F.lit(" sql"))).otherwise(F.array(F.lit("go"))),
        "role_family": F.when(size % 5 == 0, "data").otherwise("other"),
        "seniority": F.when(size % 4 == 0, "senior").when(size % 4 == 1, "mid").when(size % 4 == 2, "c_level"),
        "location": F.when(size % 11 == 0, "New Pune"),
        "work_mode": F.when(size % 9 == 0, "remote").otherwise(no),
    }
    return A.table(spark, d, "part").select("p_partkey", F.array_join(T.explain_match(resume, job, size / 100), "|").alias("reasons"))


@query(_limited(1))
def throttle(spark: SparkSession, d: str) -> DataFrame:
    return ST.throttle(A.table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 86_400).select("event_id", "user_id", "allowed")


_VENDOR = "CASE o_orderkey % 4 WHEN 0 THEN 'newsapi' WHEN 1 THEN 'gnews' WHEN 2 THEN 'google_jobs' ELSE 'serpapi' END"


@query(f"""SELECT o_orderkey, {_VENDOR} AS vendor, CASE WHEN o_orderkey % 4 = 2 THEN 'C' || o_custkey || ' is hiring: ' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS title, CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE o_orderpriority END AS description,
CASE WHEN o_orderkey % 4 = 2 THEN repeat('x', 2000) ELSE '' END AS content, 'https://x.example/' || o_orderkey AS url, CASE WHEN o_orderkey % 4 < 2 THEN CAST(epoch(o_orderdate) AS BIGINT) + 43200 END AS published_s,
CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN 'gnews' WHEN 2 THEN 'google_jobs' ELSE 'serpapi' END AS source_name FROM orders""")
def news_articles(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    title, url, empty, kind = key.alias("title"), F.concat(F.lit("https://x.example/"), key), F.lit(""), F.col("o_orderkey") % 4
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'12:00:00'Z'").alias("publishedAt")
    a = F.struct(title, F.col("o_orderpriority").alias("description"), url.alias("url"), day, F.struct(F.col("o_orderstatus").alias("name")).alias("source"))
    b = F.struct(title, url.alias("url"), day, F.struct(empty.alias("name")).alias("source"))
    job = F.struct(title, F.col("o_orderpriority").alias("location"), F.lit("x" * 2001).alias("description"), F.array(F.struct(empty.alias("link"))).alias("apply_options"), url.alias("share_link"))
    blank = F.struct(empty.alias("title"), F.lit(None).cast("string").alias("location"), empty.alias("description"), F.array(F.struct(empty.alias("link"))).alias("apply_options"), url.alias("share_link"))
    web = F.struct(title, F.col("o_orderpriority").alias("snippet"), url.alias("link"), F.lit("3 hours ago").alias("date"))
    payload = F.when(kind == 0, F.to_json(F.struct(F.array(a).alias("articles")))).when(kind == 1, F.to_json(F.struct(F.array(b).alias("articles")))).when(kind == 2, F.to_json(F.struct(F.array(blank, job).alias("jobs_results"))))
    payload = payload.otherwise(F.to_json(F.struct(F.slice(F.array(web), 1, 0).alias("organic_results"), F.array(web).alias("news_results"))))
    raw = A.table(spark, d, "orders").select("o_orderkey", F.expr(_VENDOR).alias("vendor"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("company"), payload.alias("payload"))
    return V.normalize_articles(raw, "vendor", "payload", "company").withColumn("published_s", F.unix_seconds("published_at")).drop("company", "published_at")


@query("""SELECT page_id, page_id AS company_id, CASE page_id % 3 WHEN 0 THEN 'https://job-boards.greenhouse.io/acme' || page_id ELSE 'https://Jobs.AshbyHQ.com/Co' || page_id END AS board_url, CASE page_id % 3 WHEN 0 THEN 'greenhouse' ELSE 'ashby' END AS provider,
CASE page_id % 3 WHEN 0 THEN 'https://boards-api.greenhouse.io/v1/boards/acme' || page_id || '/jobs?content=true' ELSE 'https://api.ashbyhq.com/posting-api/job-board/Co' || page_id || '?includeCompensation=true' END AS api_url FROM pages WHERE page_id % 3 <> 1 AND page_id % 5 <> 0 AND page_id % 7 <> 0""")
def discovered_boards(spark: SparkSession, d: str) -> DataFrame:
    i, key = F.col("page_id"), F.col("page_id").cast("string")
    ref = F.when(i % 3 == 0, F.concat(F.lit('<a href="https://jobs.lever.co/search"></a><iframe src="//job-boards.greenhouse.io/acme'), key, F.lit('?x=1">'))).when(i % 3 == 1, F.lit("jobs.lever.co/Embed")).otherwise(F.concat(F.lit("'Jobs.AshbyHQ.com/Co"), key, F.lit("/apply'")))
    own = F.when(i % 5 != 0, i).alias("company_id"), F.when(i % 7 == 0, "ats_api").alias("source_type")
    return P.discover_boards(A.table(spark, d, "pages").select("page_id", *own, F.concat(F.coalesce("html", F.lit("")), ref).alias("html")))


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Companies whose names are the opening words of the benchmark passages, with a two-word alias."""
    w = F.split("text", r"\s+")
    return A.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.array_join(F.slice(w, 1, 3), " ").alias("name"), F.array(F.array_join(F.slice(w, 4, 2), " ")).alias("aliases"))


@query()
def mentions(spark: SparkSession, d: str) -> DataFrame:
    return M.find_mentions(A.table(spark, d, "documents"), _named(spark, d))


@query()
def routed_events(spark: SparkSession, d: str) -> DataFrame:
    line = F.substring_index("text", "\n", 1)
    events = A.table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), line.alias("title"), F.expr("substring(text, length(substring_index(text, '\\n', 1)) + 2)").alias("context"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("company_id"))
    return M.route_events(events, _named(spark, d)).select("event_id", "company_id")
