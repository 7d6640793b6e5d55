"""The weekly digest, its recipients, and the counts behind the operators' pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import reports as R
from tidemark.operators.listing import public_events

MOVERS, EVENTS, ENTRANTS, HOTSPOTS = 10, 15, 10, 10


def notable_events(events: DataFrame, companies: DataFrame, since: Column, n: int = EVENTS) -> DataFrame:
    """The newest public events of the window with their first evidence and effective time."""
    rows = public_events(events).filter(F.col("observed_at") >= since).orderBy(F.desc("observed_at"), F.desc("id")).limit(n)
    return R.with_company(rows, companies).select(
        "id", "company_id", "company_name", "company_slug", "event_type", "title", F.coalesce("occurred_at", "observed_at").alias("occurred_at"),
        F.get("evidence", F.lit(0))["source_url"].alias("evidence_url"), "observed_at",
    )


def new_entrants(companies: DataFrame, since: Column, n: int = ENTRANTS) -> DataFrame:
    """The active companies created in the window, newest first."""
    return companies.filter(F.col("is_active") & (F.col("created_at") >= since)).orderBy(F.desc("created_at"), "id").limit(n)


def digest_events_by_type(events: DataFrame) -> DataFrame:
    """event_type, place (order of first appearance), titles: ``notable_events`` grouped, newest first."""
    key = F.struct((-F.unix_micros(F.col("observed_at").cast("timestamp"))).alias("t"), (-F.col("id")).alias("i"))
    rows = events.groupBy("event_type").agg(F.min(key).alias("first"), F.sort_array(F.collect_list(F.struct(key.alias("k"), "title"))).alias("all"))
    titles = F.transform("all", lambda x: x["title"])
    place = F.aggregate("firsts", F.lit(1).cast("long"), lambda a, f: a + (f < F.col("first")).cast("long"))
    firsts = rows.agg(F.collect_list("first").alias("firsts"))  # one entry for each event type
    return rows.join(F.broadcast(firsts)).select("event_type", place.alias("place"), titles.alias("titles"))


def weekly_digest(companies: DataFrame, scores: DataFrame, jobs: DataFrame, events: DataFrame, as_of: Column, window_days: int = 7) -> DataFrame:
    """One row: top_movers, hiring_hotspots, notable_events, new_entrants (arrays of struct, in order) and is_empty, which new companies don't fill."""
    since = as_of - F.expr(f"INTERVAL {window_days} DAYS")
    movers = R.trending(companies, scores, jobs, events, since, MOVERS, only_up=True)

    def packed(df: DataFrame, name: str, *cols: Column | str) -> DataFrame:  # each section has a bounded number of rows
        return df.agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))

    parts = [
        packed(movers, "top_movers", (-F.col("delta")).alias("down"), "id", "name"),
        packed(R.hiring_hotspots(jobs, companies, since, HOTSPOTS), "hiring_hotspots", (-F.col("new_jobs")).alias("down"), "company_id", "company_name"),
        packed(notable_events(events, companies, since), "notable_events", (-F.unix_micros(F.col("observed_at").cast("timestamp"))).alias("down"), "id", "title", "evidence_url"),
        packed(new_entrants(companies, since), "new_entrants", (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("down"), "id", "name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    empty = (F.size("top_movers") == 0) & (F.size("hiring_hotspots") == 0) & (F.size("notable_events") == 0)
    return out.withColumn("is_empty", empty)


def apply_send_cap(recipients: DataFrame, order: list[str], cap: int, sent_today: int = 0) -> DataFrame:
    """Recipients with ``sent``: the first ones, as many as today's cap still lets go; the rest is put off. order must be unique."""
    first = recipients.orderBy(*order).limit(max(cap - sent_today, 0)).select(*order).withColumn("sent", F.lit(True))
    return recipients.join(F.broadcast(first) if cap <= 100_000 else first, order, "left").fillna(False, ["sent"])


def _counts(df: DataFrame, by: str) -> Column:
    return df.groupBy(by).count()


def source_stats(sources: DataFrame, companies: DataFrame) -> DataFrame:
    """One row: total_sources, by_type and by_status (maps), companies_with_sources, companies_without_sources (never negative)."""
    as_map = lambda by: _counts(sources, by).agg(F.map_from_entries(F.collect_list(F.struct(by, "count"))).alias(f"by_{by}"))
    one = sources.agg(F.count("*").alias("total_sources"), F.count_distinct(F.when(F.col("status") == "approved", F.col("company_id"))).alias("companies_with_sources"))
    total = companies.agg(F.count_if("is_active").alias("__tm_n"))
    out = one.join(F.broadcast(total)).withColumn("companies_without_sources", F.greatest(F.col("__tm_n") - F.col("companies_with_sources"), F.lit(0).cast("long"))).drop("__tm_n")
    return out.join(F.broadcast(as_map("source_type").withColumnRenamed("by_source_type", "by_type"))).join(F.broadcast(as_map("status")))


def _metrics(parts: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """metric, value: one count each."""
    out = None
    for name, df, hit in parts:
        row = df.agg(F.lit(name).alias("metric"), F.count_if(hit).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def instance_metrics(companies: DataFrame, sources: DataFrame, events: DataFrame, jobs: DataFrame, users: DataFrame, subscribers: DataFrame) -> DataFrame:
    """metric, value; sources by status under ``sources_<status>``."""
    every, active = F.lit(True), F.col("is_active")
    flat = _metrics([
        ("total_companies", companies, every), ("active_companies", companies, active), ("total_sources", sources, every), ("total_events", events, F.col("is_canonical")),
        ("active_jobs", jobs, active), ("closed_jobs", jobs, ~active), ("total_users", users, every), ("total_subscribers", subscribers, active),
    ])
    return flat.unionByName(_counts(sources, "status").select(F.concat(F.lit("sources_"), "status").alias("metric"), F.col("count").alias("value")))


def weekly_stats(companies: DataFrame, sources: DataFrame, events: DataFrame, jobs: DataFrame, subscribers: DataFrame, scores: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """metric, value: what the last days brought, and the active jobs that matching can't see."""
    since = as_of - F.expr(f"INTERVAL {days} DAYS")
    new = lambda c: F.col(c) >= since
    return _metrics([
        ("new_companies", companies, new("created_at")), ("new_sources", sources, new("created_at")), ("new_events", public_events(events), new("observed_at")),
        ("new_jobs", jobs, new("first_seen_at")), ("closed_jobs", jobs, new("closed_at")), ("new_subscribers", subscribers, new("created_at")),
        ("confirmed_subscribers", subscribers, new("confirmed_at")), ("scores_computed", scores, new("scored_at")),
        ("jobs_missing_embedding", jobs, F.col("is_active") & F.col("embedding").isNull()),
    ])


def quota_status(calls: DataFrame, limits: DataFrame, key: str, ts: str, now: Column) -> DataFrame:
    """key, limit, used, remaining, exhausted, resets_at (next UTC midnight), paused (every configured key is spent) for the day of ``now``."""
    day = F.date_trunc("day", now)
    used = calls.filter(F.date_trunc("day", ts) == day).groupBy(key).agg(F.count("*").alias("__tm_n"))
    rows = limits.join(used, key, "left").select(key, "limit", F.coalesce("__tm_n", F.lit(0).cast("long")).alias("used"))
    rows = rows.withColumn("remaining", F.greatest(F.col("limit") - F.col("used"), F.lit(0).cast("long"))).withColumn("exhausted", F.col("used") >= F.col("limit")).withColumn("resets_at", day + F.expr("INTERVAL 1 DAY"))
    spent = rows.agg(F.coalesce(F.every("exhausted"), F.lit(False)).alias("paused"))
    return rows.join(F.broadcast(spent))
