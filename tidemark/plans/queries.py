"""The operators over the driver's whole tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.functions import text as T
from tidemark.operators import listing as L
from tidemark.operators import matching as M
from tidemark.operators import reports as R
from tidemark.operators import scores as C
from tidemark.operators import snapshots as N
from tidemark.operators import vectors as V
from tidemark.sources import adapters as A
from tidemark.streaming import changes as ST

AS_OF, JOBS_SINCE = "2024-02-01 00:00:00", "2001-01-01 00:00:00"
GRID = ["2024-01-10 00:00:00", "2024-01-20 00:00:00", "2024-02-01 00:00:00"]
SINCE = "2024-01-15 00:00:00"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def at(x: str):
    return F.lit(x).cast("timestamp_ntz")


def _case(table: dict, col: str, default: object) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


_HOST = "regexp_replace(lower(regexp_extract(source_url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '')"
_TIER = f"CASE WHEN source_url IS NULL THEN 0.3 WHEN {_HOST} LIKE '%greenhouse.io%' THEN 1.0 WHEN {_HOST} LIKE '%techcrunch.com%' THEN 0.9 WHEN {_HOST} LIKE '%newsapi%' THEN 0.7 ELSE 0.5 END"


def _weight(as_of: str) -> str:
    age = f"greatest(floor((epoch_us({as_of}) - epoch_us(observed_at)) / 86400000000.0), 0)"
    return f"{_case(S.BASE_WEIGHTS, 'event_type', 0)} * pow(0.5, {age} / {_case(S.HALF_LIVES, 'event_type', 90)}.0) * (0.7 + 0.3 * least(source_count, 5) / 5.0) * {_TIER}".replace(" END.0", " END")


_SCORE = "greatest(least(100 / (1 + exp(-(raw - 50) / 20.0)), 100), 0)"
_LABEL = "CASE WHEN momentum_score < 10 AND NOT recent THEN 'none' WHEN momentum_score < 25 THEN 'low' WHEN momentum_score < 50 THEN 'moderate' WHEN momentum_score < 75 THEN 'high' ELSE 'very_high' END"
_SERIES = f"""g AS (SELECT CAST(unnest(['{"', '".join(GRID)}']) AS TIMESTAMP) AS scored_at),
  sw AS (SELECT company_id, scored_at, observed_at, {_weight('scored_at')} AS w FROM ev JOIN g ON observed_at <= scored_at AND observed_at >= scored_at - INTERVAL 180 DAY),
  sr AS (SELECT company_id, scored_at, sum(w) AS raw, max(observed_at >= scored_at - INTERVAL 30 DAY) AS recent, count(*) AS n_events FROM sw GROUP BY ALL),
  ss AS (SELECT *, {_SCORE} AS momentum_score FROM sr),
  sc AS (SELECT company_id, scored_at, momentum_score, {_LABEL} AS momentum_label, raw AS signal_strength, n_events FROM ss)"""
_LATEST = "la AS (SELECT company_id, arg_max(momentum_score, scored_at) AS momentum_score, arg_max(momentum_label, scored_at) AS momentum_label FROM sc GROUP BY company_id)"
_ACTIVE = "aj AS (SELECT company_id, count(*) AS active_jobs FROM jb WHERE is_active GROUP BY company_id)"
_MOVES = f"mv AS (SELECT company_id, arg_max(momentum_score, scored_at) AS latest, arg_max(momentum_score, scored_at) FILTER (WHERE scored_at < TIMESTAMP '{SINCE}') AS baseline FROM sc GROUP BY company_id)"
_TOP = "tp AS (SELECT company_id, arg_max(title, observed_at) AS headline FROM ev GROUP BY company_id)"
_TOP_PUBLIC = _TOP.replace("FROM ev", "FROM pb")


def sql(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(A.SQL.get(p, p) for p in parts) + "\n" + body


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return add


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return C.score_series(A.events(spark, d), GRID)


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query(sql("co", "ev", f"w AS (SELECT company_id, observed_at, {_weight(f"TIMESTAMP '{AS_OF}'")} AS w FROM ev WHERE observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY)", f"r AS (SELECT company_id, sum(w) AS raw, max(observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS recent, count(*) AS n_events FROM w GROUP BY company_id)", f"s AS (SELECT *, {_SCORE} AS momentum_score FROM r)",
     body=f"SELECT co.id AS company_id, co.name, round(coalesce(momentum_score, 0), 6) AS momentum_score, CASE WHEN s.company_id IS NULL THEN 'none' ELSE {_LABEL} END AS momentum_label, round(coalesce(raw, 0), 6) AS signal_strength, coalesce(n_events, 0) AS n_events FROM co LEFT JOIN s ON s.company_id = co.id"))
def momentum_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = C.momentum_scores(A.events(spark, d), A.companies(spark, d), at(AS_OF))
    return rows.select("company_id", "name", F.round("momentum_score", 6).alias("momentum_score"), "momentum_label", F.round("signal_strength", 6).alias("signal_strength"), "n_events")


@query(sql("ev", _SERIES, body="SELECT company_id, strftime(scored_at, '%Y-%m-%d %H:%M:%S') AS scored_at, round(momentum_score, 6) AS momentum_score, momentum_label, n_events FROM sc"))
def score_series(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("company_id", _day("scored_at"), F.round("momentum_score", 6).alias("momentum_score"), "momentum_label", "n_events")


@query(sql("ev", _SERIES, body="SELECT company_id, strftime(scored_at, '%Y-%m-%d %H:%M:%S') AS scored_at, round(momentum_score - lag(momentum_score) OVER (PARTITION BY company_id ORDER BY scored_at), 6) AS score_delta FROM sc"))
def score_deltas(spark: SparkSession, d: str) -> DataFrame:
    return C.score_deltas(_scores(spark, d)).select("company_id", _day("scored_at"), F.round("score_delta", 6).alias("score_delta"))


@query(sql("ev", _SERIES, _MOVES, body="SELECT company_id, round(latest, 6) AS latest, round(baseline, 6) AS baseline, round(latest - coalesce(baseline, 0), 6) AS delta FROM mv"))
def score_movement(spark: SparkSession, d: str) -> DataFrame:
    return C.score_movement(_scores(spark, d), at(SINCE)).select("company_id", *[F.round(c, 6).alias(c) for c in ("latest", "baseline", "delta")])


@query(sql("ev", _SERIES, body="SELECT company_id, strftime(scored_at, '%Y-%m-%d %H:%M:%S') AS scored_at, round(momentum_score, 6) AS momentum_score, place FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY scored_at DESC) AS place FROM sc) WHERE place <= 2"))
def score_history(spark: SparkSession, d: str) -> DataFrame:
    return C.score_history(_scores(spark, d), 2).select("company_id", _day("scored_at"), F.round("momentum_score", 6).alias("momentum_score"), F.col("place").cast("long").alias("place"))


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY user_id")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return C.latest_per_key(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query(sql("ev", body=f"SELECT id, {_TIER.replace('0.3', "'rumor'").replace('1.0', "'first_party'").replace('0.9', "'tier1_press'").replace('0.7', "'aggregator'").replace('0.5', "'blog'")} AS tier FROM ev"))
def evidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    return A.events(spark, d).select("id", S.source_tier(F.col("source_url")).alias("tier"))


@query(sql("co", "ev", _SERIES, _LATEST, body="SELECT industry, count(*) AS companies, round(avg(momentum_score), 6) AS avg_score FROM co LEFT JOIN la ON la.company_id = co.id WHERE is_active AND industry IS NOT NULL GROUP BY industry"))
def industry_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return R.industry_breakdown(A.companies(spark, d), _scores(spark, d)).select("industry", "companies", F.round("avg_score", 6).alias("avg_score"))


@query(sql("jb", body="SELECT coalesce(role_family, 'other') AS role_family, count(*) AS active_jobs FROM jb WHERE is_active GROUP BY 1"))
def jobs_by_family(spark: SparkSession, d: str) -> DataFrame:
    return R.jobs_by_family(A.jobs(spark, d))


@query(sql("co", "jb", body=f"SELECT company_id, count(*) AS new_jobs, any_value(name) AS company_name FROM jb JOIN co ON co.id = company_id WHERE jb.is_active AND first_seen_at >= TIMESTAMP '{JOBS_SINCE}' GROUP BY company_id ORDER BY new_jobs DESC, company_id LIMIT 10"))
def hiring_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return R.hiring_hotspots(A.jobs(spark, d), A.companies(spark, d), at(JOBS_SINCE)).select("company_id", "new_jobs", "company_name")


@query(sql("co", "jb", "ev", "sg", "pb", body=f"SELECT (SELECT count(*) FROM co WHERE is_active) AS active_companies, (SELECT count(*) FROM jb WHERE is_active) AS active_jobs, (SELECT count(*) FROM pb WHERE observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS events_30d, (SELECT count(DISTINCT company_id) FROM pb) AS covered_companies"))
def platform_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.platform_stats(A.companies(spark, d), A.jobs(spark, d), A.signals(spark, d), at(AS_OF))


@query(sql("ev", "sg", "pb", body=f"SELECT company_id, count(*) AS events, count(*) FILTER (WHERE observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS events_30d FROM pb GROUP BY company_id"))
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.event_counts(A.signals(spark, d), at(AS_OF))


@query(sql("co", "ev", "sg", "pb", body="SELECT company_id, pb.id, title, place, name AS company_name FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY observed_at DESC, id DESC) AS place FROM pb) pb JOIN co ON co.id = company_id WHERE place <= 5"))
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return R.recent_events(A.signals(spark, d), A.companies(spark, d), 5).select("company_id", "id", "title", F.col("place").cast("long").alias("place"), "company_name")


@query(sql("ev", "sg", "pb", _TOP_PUBLIC, body="SELECT * FROM tp"))
def top_signal(spark: SparkSession, d: str) -> DataFrame:
    return R.top_signal(A.signals(spark, d))


_TRENDING = "SELECT co.id, name, round(latest - coalesce(baseline, 0), 6) AS delta, coalesce(active_jobs, 0) AS active_jobs, headline FROM co JOIN mv ON mv.company_id = co.id LEFT JOIN aj ON aj.company_id = co.id LEFT JOIN tp ON tp.company_id = co.id WHERE is_active {} ORDER BY latest - coalesce(baseline, 0) DESC, co.id LIMIT {}"


@query(sql("co", "jb", "ev", "sg", "pb", _SERIES, _MOVES, _ACTIVE, _TOP_PUBLIC, body=_TRENDING.format("", 20)))
def trending(spark: SparkSession, d: str) -> DataFrame:
    return R.trending(A.companies(spark, d), _scores(spark, d), A.jobs(spark, d), A.signals(spark, d), at(SINCE), 20).select("id", "name", F.round("delta", 6).alias("delta"), "active_jobs", "headline")


@query(sql("co", "jb", "ev", "sg", "pb", _SERIES, _MOVES, _ACTIVE, _TOP_PUBLIC, body=_TRENDING.format("AND latest - coalesce(baseline, 0) > 0", 10)))
def top_movers(spark: SparkSession, d: str) -> DataFrame:
    return R.trending(A.companies(spark, d), _scores(spark, d), A.jobs(spark, d), A.signals(spark, d), at(SINCE), 10, only_up=True).select("id", "name", F.round("delta", 6).alias("delta"), "active_jobs", "headline")


@query(sql("co", "jb", "ev", _SERIES, _LATEST, _ACTIVE, body="SELECT co.id, name, industry, round(momentum_score, 6) AS momentum_score, momentum_label, coalesce(active_jobs, 0) AS active_jobs FROM co LEFT JOIN la ON la.company_id = co.id LEFT JOIN aj ON aj.company_id = co.id"))
def list_companies(spark: SparkSession, d: str) -> DataFrame:
    return L.list_companies(A.companies(spark, d), _scores(spark, d), A.jobs(spark, d), sort_by="momentum_score", sort_order="desc").select("id", "name", "industry", F.round("momentum_score", 6).alias("momentum_score"), "momentum_label", "active_jobs")


@query(sql("co", "ev", "sg", "pb", body=f"SELECT pb.id, company_id, name AS company_name, title FROM pb JOIN co ON co.id = company_id WHERE event_type = 'funding' AND observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY"))
def list_events(spark: SparkSession, d: str) -> DataFrame:
    return L.list_events(A.signals(spark, d), A.companies(spark, d), event_type="funding", days=20, as_of=at(AS_OF)).select("id", "company_id", "company_name", "title")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_type), 're')")
def search_parts(spark: SparkSession, d: str) -> DataFrame:
    return R.search_contains(A.table(spark, d, "part"), "RE", "p_name", "p_type").select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 50 LIMIT 25")
def paginate_orders(spark: SparkSession, d: str) -> DataFrame:
    return R.paginate(A.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 25)[0]


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages, ceil(count(*) / 25.0) > 3 AS has_next, count(*) > 0 AS has_prev FROM orders")
def paginate_meta(spark: SparkSession, d: str) -> DataFrame:
    return R.paginate(A.table(spark, d, "orders"), [F.asc("o_orderkey")], 3, 25)[1]


@query(sql("co", "jb", "ev", "sg", "pb", _SERIES, _LATEST, _ACTIVE, _TOP_PUBLIC, body="SELECT co.id, name, round(momentum_score, 6) AS momentum_score, coalesce(active_jobs, 0) AS active_jobs, coalesce(n, 0) AS events, headline FROM co LEFT JOIN la ON la.company_id = co.id LEFT JOIN aj ON aj.company_id = co.id LEFT JOIN tp ON tp.company_id = co.id LEFT JOIN (SELECT company_id, count(*) AS n FROM pb GROUP BY 1) c ON c.company_id = co.id"))
def company_detail(spark: SparkSession, d: str) -> DataFrame:
    return R.company_detail(A.companies(spark, d), _scores(spark, d), A.jobs(spark, d), A.signals(spark, d), at(AS_OF)).select("id", "name", F.round("momentum_score", 6).alias("momentum_score"), "active_jobs", "events", "headline")


def _like_any(parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(t, '{p.replace(chr(39), chr(39) * 2)}')" for p in parts) + ")"


_RATIO = "CASE WHEN length({0}) > 0 THEN (length({0}) - length(translate({0}, '<>/{{}}[]', ''))) / length({0}) ELSE 0 END"


@query(f"SELECT doc_id, CASE WHEN length(t) < 100 THEN 'short' WHEN {_RATIO.format('t')} > 0.3 THEN 'markup' WHEN {_like_any(T.INCLUDE)} THEN 'include' WHEN {_like_any(T.EXCLUDE)} THEN 'exclude' ELSE 'unmatched' END AS reason FROM (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+$', '', 'g')) AS t FROM documents)")
def prefilter_documents(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", T.prefilter(F.col("text"), F.col("source")).alias("reason"))


@query(f"SELECT page_id, round({_RATIO.format('html')}, 9) AS ratio FROM pages")
def markup_ratio_pages(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages").select("page_id", F.round(T.markup_ratio(F.col("html")), 9).alias("ratio"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash_documents(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


_DOMAIN = "regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[/?#:].*$', ''), '^www\\.', '')"


@query(f"SELECT page_id, {_DOMAIN} AS domain, array_to_string(list_slice(string_split({_DOMAIN}, '.'), -2, -1), '.') AS registrable FROM pages")
def page_domains(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages").select("page_id", T.normalize_domain(F.col("url")).alias("domain"), T.registrable_domain(F.col("url")).alias("registrable"))


@query("SELECT p_partkey, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE round(len(list_intersect(x, y)) / greatest(len(x), len(y)), 9) END AS overlap FROM (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS x, list_distinct(string_split(lower(p_type), ' ')) AS y FROM part)")
def title_overlap_parts(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "part").select("p_partkey", F.round(T.title_overlap(F.col("p_name"), F.col("p_type")), 9).alias("overlap"))


def _rules(col: str, rules: tuple, otherwise: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({col}, '{T.compile_rule(w)[4:].replace(chr(92) + '-', '-').replace(chr(92) + ' ', ' ').replace(chr(92) + '&', '&').replace(chr(92) + '%', '%')}') THEN '{n}'" for n, w in rules)
    return f"CASE {whens} ELSE {otherwise} END"


@query(f"SELECT p_partkey, {_rules('t', T.ROLE_FAMILIES, chr(39) + 'other' + chr(39))} AS role_family, {_rules('t', T.SENIORITY, chr(39) + 'mid' + chr(39))} AS seniority FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part)")
def classify_titles(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat_ws(" ", "p_name", "p_type")
    return A.table(spark, d, "part").select("p_partkey", T.role_family(t).alias("role_family"), T.seniority(t).alias("seniority"))


@query("SELECT o_orderkey, 'cp_' || substr(sha256(lower(o_orderpriority || '|' || o_orderstatus)), 1, 20) AS external_id FROM orders")
def synthetic_ids(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "orders").select("o_orderkey", T.synthetic_external_id(F.col("o_orderpriority"), F.col("o_orderstatus"), F.lit(None).cast("string")).alias("external_id"))


@query("SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') AS slug FROM supplier")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "supplier").select("s_suppkey", T.slugify(F.col("s_name")).alias("slug"))


_SNAP = "st AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS h, o_orderstatus <> 'P' AS a FROM orders WHERE o_orderpriority <> '1-URGENT'), ic AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS h FROM orders WHERE o_orderpriority <> '5-LOW')"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of one board: stored without the first priority, incoming without the last, and with open orders' prices changed."""
    o = A.table(spark, d, "orders")
    key = F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")
    stored = o.filter("o_orderpriority != '1-URGENT'").select(*key, F.col("o_totalprice").alias("h"), (F.col("o_orderstatus") != "P").alias("is_active"))
    incoming = o.filter("o_orderpriority != '5-LOW'").select(*key, (F.col("o_totalprice") + F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("h"))
    return stored, incoming


_STATUS = "rc AS (SELECT coalesce(st.k, ic.k) AS k, coalesce(st.c, ic.c) AS c, CASE WHEN st.k IS NULL THEN 'new' WHEN ic.k IS NULL AND a THEN 'closed' WHEN ic.k IS NULL THEN 'kept' WHEN NOT a THEN 'reopened' WHEN st.h <> ic.h THEN 'updated' ELSE 'unchanged' END AS status FROM (SELECT * FROM st WHERE c IN (SELECT c FROM ic)) st FULL JOIN ic ON st.k = ic.k AND st.c = ic.c)"


@query(sql(_SNAP, _STATUS, body="SELECT * FROM rc"))
def reconcile_orders(spark: SparkSession, d: str) -> DataFrame:
    return N.reconcile(*_snapshots(spark, d), ["k", "c"], "h", board=["c"])


@query(sql(_SNAP, _STATUS, body="SELECT c, count(*) FILTER (WHERE status = 'new') AS n_new, count(*) FILTER (WHERE status = 'updated') AS n_updated, count(*) FILTER (WHERE status = 'unchanged') AS n_unchanged, count(*) FILTER (WHERE status = 'reopened') AS n_reopened, count(*) FILTER (WHERE status = 'closed') AS n_closed FROM rc GROUP BY c"))
def reconcile_summary(spark: SparkSession, d: str) -> DataFrame:
    return N.reconcile_summary(N.reconcile(*_snapshots(spark, d), ["k", "c"], "h", board=["c"]), ["c"])


@query(sql(_SNAP, body="SELECT coalesce(st.k, ic.k) AS k, CASE WHEN ic.k IS NULL THEN 'removed' WHEN st.k IS NULL THEN 'added' ELSE 'both' END AS side FROM (SELECT DISTINCT k FROM st) st FULL JOIN (SELECT DISTINCT k FROM ic) ic ON st.k = ic.k"))
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return N.snapshot_diff(*_snapshots(spark, d), ["k"])


@query("SELECT event_id, user_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS changed FROM events")
def content_changes(spark: SparkSession, d: str) -> DataFrame:
    return N.content_changes(A.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "changed")


@query("""WITH i AS (SELECT user_id, event_type = 'error' AS bad, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
a AS (SELECT user_id, g, count(*) FILTER (WHERE bad) AS f, count(*) AS n FROM i GROUP BY ALL), l AS (SELECT user_id, arg_max(f, g) AS c, sum(n) AS fetches, sum(f) AS failures FROM a GROUP BY user_id),
e AS (SELECT user_id, arg_max(value > 50, (ts, event_id)) AS changed, arg_max('http ' || CAST(floor(value) AS BIGINT), (ts, event_id)) AS why, arg_max(event_type = 'view', (ts, event_id)) AS last_limited, count(*) FILTER (WHERE event_type = 'view') AS rate_limited FROM events GROUP BY 1)
SELECT user_id, c AS consecutive_failures, CAST(fetches AS BIGINT) AS fetches, CAST(failures AS BIGINT) AS failures, CASE WHEN c = 0 AND (NOT changed OR last_limited) THEN 2160 WHEN c = 0 THEN 1440 ELSE least(1440 * pow(2, c), 10080)::BIGINT END AS next_minutes, c >= 10 AS disabled,
CASE WHEN c > 0 THEN why END AS failure_reason, rate_limited FROM l JOIN e USING (user_id)""")
def source_health(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    kind, why = F.col("event_type"), F.concat(F.lit("http "), F.floor("value").cast("string"))
    logs = e.withColumns({"failed": kind == "error", "changed": F.col("value") > 50, "why": why, "limited": kind == "view"})
    return N.source_health(logs, "user_id", ["ts", "event_id"], "failed", changed="changed", reason="why", limited="limited")


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, least(count(*), 3) AS allowed, 3 - least(count(*), 3) AS remaining FROM events GROUP BY ALL")
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    return N.daily_quota(A.table(spark, d, "events"), "user_id", "ts", ["ts", "event_id"], 3)


@query("SELECT count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS kept, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS dropped FROM orders")
def retention_counts(spark: SparkSession, d: str) -> DataFrame:
    return N.retention(A.table(spark, d, "orders"), "o_orderdate", at("1998-01-01 00:00:00"))[1]


@query("SELECT user_id, event_type, arg_min(event_id, ts) AS event_id FROM events GROUP BY ALL")
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return N.dedupe_keep(A.table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT o_custkey AS k, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY o_custkey")
def register_new(spark: SparkSession, d: str) -> DataFrame:
    known = A.table(spark, d, "events").select(F.col("user_id").alias("k"))
    return N.register_new(known, A.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), "k", ["o_orderkey"])


_NAMES = """CASE c_custkey % 7 WHEN 0 THEN ' https://www.' || s || '.example/jobs?x=1' WHEN 1 THEN upper(c_name) WHEN 2 THEN 'Alias ' || c_custkey WHEN 3 THEN 'alias ' || c_custkey
WHEN 4 THEN replace(c_name, '#', ' / ') WHEN 5 THEN 'Nobody ' || c_custkey ELSE s || '.example' END"""


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 7 IN (3, 5) THEN NULL ELSE c_custkey END AS company_id FROM (SELECT c_custkey, {_NAMES} AS m FROM (SELECT *, regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS s FROM customer))")
def resolve_entities(spark: SparkSession, d: str) -> DataFrame:
    """Mentions by domain, name in capitals, alias, alias in the wrong case (a miss), a spelling with the right slug, a stranger (a miss), bare domain."""
    c = A.table(spark, d, "customer").withColumn("s", F.regexp_replace(F.lower("c_name"), "[^a-z0-9]+", "-"))
    return M.resolve_entities(c.select("c_custkey", F.expr(_NAMES).alias("m")), A.profiles(spark, d), "m").select("c_custkey", "company_id")


@query(sql("ev", body="SELECT a.id AS id_a, b.id AS id_b, a.company_id, a.event_type FROM ev a JOIN ev b ON a.company_id = b.company_id AND a.event_type = b.event_type AND b.id < a.id AND abs(epoch_us(a.observed_at) - epoch_us(b.observed_at)) <= 14 * 86400000000"))
def dedup_candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = A.events(spark, d)
    return M.dedup_candidates(e, e)


_SAME = """CASE event_type WHEN 'funding' THEN l.f_round = x.f_round AND (l.f_amount IS NULL OR x.f_amount IS NULL OR least(l.f_amount, x.f_amount) <= 0 OR abs(l.f_amount - x.f_amount) / greatest(l.f_amount, x.f_amount) <= 0.2)
WHEN 'leadership_change' THEN l.f_person = x.f_person AND (l.f_role = '' OR x.f_role = '' OR l.f_role = x.f_role) WHEN 'new_office' THEN x.f_city <> '' AND l.f_city = x.f_city WHEN 'acquisition' THEN x.f_target <> '' AND l.f_target = x.f_target ELSE l.f_title = x.f_title END"""
_LED = f"""nr AS (SELECT company_id, event_type, row_number() OVER (PARTITION BY company_id, event_type ORDER BY id) AS n,
  struct_pack(id := id, t := epoch_us(observed_at), f_title := f_title, f_round := f_round, f_amount := f_amount, f_person := f_person, f_role := f_role, f_city := f_city, f_target := f_target) AS x FROM rp),
  ld AS (SELECT company_id, event_type, n, [x] AS leaders, x.id AS id, x.id AS canonical_id FROM nr WHERE n = 1 UNION ALL
    SELECT company_id, event_type, n, CASE WHEN m IS NULL THEN list_append(leaders, x) ELSE leaders END, x.id, coalesce(m, x.id) FROM (
      SELECT nr.company_id, nr.event_type, nr.n, leaders, x, list_filter(leaders, lambda l: abs(l.t - x.t) <= 1209600000000 AND {_SAME.replace('event_type', 'nr.event_type', 1)})[1].id AS m
      FROM ld JOIN nr ON nr.company_id = ld.company_id AND nr.event_type = ld.event_type AND nr.n = ld.n + 1))"""


@query(sql("ev", "rp", _LED, body="SELECT id, canonical_id FROM ld").replace("WITH", "WITH RECURSIVE", 1))
def dedup_events(spark: SparkSession, d: str) -> DataFrame:
    return M.dedup_events(A.reports(spark, d))


@query(sql("ev", "rp", _LED, "fs AS (SELECT canonical_id, source_url, min(rp.id) AS first, arg_min(confidence, rp.id) AS confidence FROM rp JOIN ld ON ld.id = rp.id GROUP BY ALL)",
     body="SELECT canonical_id, count(source_url) AS urls, count(*) AS source_count, max(confidence) AS confidence, coalesce(string_agg(source_url, ' ' ORDER BY first), '') AS evidence FROM fs GROUP BY canonical_id").replace("WITH", "WITH RECURSIVE", 1))
def merge_evidence(spark: SparkSession, d: str) -> DataFrame:
    return M.merge_evidence(A.reports(spark, d), dedup_events(spark, d)).withColumn("evidence", F.array_join("evidence", " "))


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 50 = 0)
SELECT query_id, item_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS place FROM p) WHERE place <= 5""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    return M.vector_topk(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"), "label"), 5, None).select("query_id", "item_id", F.round("similarity", 6).alias("similarity"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = A.table(spark, d, "embeddings")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label"), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"), "label")


@query()
def vector_topk_pruned(spark: SparkSession, d: str) -> DataFrame:
    return V.vector_topk_pruned(*_sides(spark, d), 5, None).select("query_id", "item_id", F.round("similarity", 6).alias("similarity"), "place")


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 50 = 0),
n AS (SELECT query_id, least(count(*), 5) AS n FROM p GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS pairs, true AS enough FROM n""")
def vector_topk_recall(spark: SparkSession, d: str) -> DataFrame:
    """The pruned search against the exact one: pairs of the exact one, and whether nine tenths or more were found."""
    sides = _sides(spark, d)
    found = V.topk_recall(V.vector_topk_pruned(*sides, 5, None), M.vector_topk(*sides, 5, None))
    return found.select("pairs", (F.col("recall") >= 0.9).alias("enough"))


_STOP = ", ".join(f"'{w}'" for w in sorted(M.SEARCH_STOPWORDS))


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({_STOP})) AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '^hand(s|es|ed|ing|ings)?$'))) AS a, len(list_filter(w, lambda x: regexp_matches(x, '^thing(s|es|ed|ing|ings)?$'))) AS b FROM w),
t AS (SELECT count(*) AS d, avg(n) AS m, count(*) FILTER (WHERE a > 0) AS fa, count(*) FILTER (WHERE b > 0) AS fb FROM c)
SELECT doc_id, round(ln(1 + (d - fa + 0.5) / (fa + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (d - fb + 0.5) / (fb + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)), 6) AS rank FROM c, t WHERE a > 0 AND b > 0""")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    return M.text_search(A.table(spark, d, "documents").select("doc_id", "text"), "the Handed things").select("doc_id", F.round("rank", 6).alias("rank"))


@query(sql("co", "ro", """w AS (SELECT id, company_id, regexp_split_to_array(lower(title || ' ' || description_text), '[^a-z0-9]+') AS w FROM ro WHERE is_active)""",
     body="SELECT w.id, co.name AS company_name FROM w JOIN co ON co.id = company_id WHERE len(list_filter(w, lambda x: x IN ('engineer', 'engineering', 'engineers'))) > 0 AND list_contains(w, 'urgent')"))
def search_jobs(spark: SparkSession, d: str) -> DataFrame:
    return M.search_jobs(A.roles(spark, d), A.companies(spark, d), "an urgent ENGINEERS").select("id", "company_name")


@query("""WITH f AS (SELECT vec_id, label, embedding, vec_id % 25 = 0 AS q FROM embeddings), p AS (SELECT a.vec_id AS resume_id, b.vec_id AS job_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s
FROM f a JOIN f b ON b.vec_id % 4 <> 0 AND (a.vec_id % 2 = 0 OR b.label IN (a.label, (a.label + 1) % 10)) WHERE a.q)
SELECT resume_id, job_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY s DESC, job_id) AS place FROM p WHERE s >= 0.1) WHERE place <= 5""")
def match_jobs(spark: SparkSession, d: str) -> DataFrame:
    e, family = A.table(spark, d, "embeddings"), F.col("label").cast("string")
    families = F.when(F.col("vec_id") % 2 == 1, F.array(family, ((F.col("label") + 1) % 10).cast("string")))
    resumes = e.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("id"), families.alias("parsed_role_families"), "embedding")
    jobs = e.select(F.col("vec_id").alias("id"), family.alias("role_family"), "embedding", (F.col("vec_id") % 4 != 0).alias("is_active"))
    return M.match_jobs(resumes, jobs, 5, 0.1).select("resume_id", "job_id", F.round("similarity", 6).alias("similarity"))


def _limited(n: int) -> str:
    """Calls in turn, with the last n allowed times of each user."""
    return f"""WITH RECURSIVE c AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT event_id, user_id, n, [t] AS held, true AS allowed FROM c WHERE n = 1 UNION ALL
  SELECT event_id, user_id, n, CASE WHEN len(near) < {n} THEN list_append(near, t) ELSE near END, len(near) < {n} FROM (
    SELECT c.event_id, c.user_id, c.n, c.t, list_filter(held, lambda h: c.t - h < 86400000000) AS near FROM s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1))
SELECT event_id, user_id, allowed FROM s"""


@query(_limited(2))
def sliding_limit(spark: SparkSession, d: str) -> DataFrame:
    return ST.sliding_limit(A.table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", 2, 86_400, "event_id").select("event_id", "user_id", "allowed")


def _load() -> None:
    """Imports the modules whose queries register themselves here."""
    from tidemark.plans import extracted, ingest, listings, profiles  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
