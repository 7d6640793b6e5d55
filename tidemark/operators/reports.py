"""Joins, counts and rankings behind listings, the dashboard and the weekly digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scores import latest_per_key, score_movement


def with_company(df: DataFrame, companies: DataFrame) -> DataFrame:
    return df.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"), F.col("slug").alias("company_slug")), "company_id")


def latest_scores(scores: DataFrame) -> DataFrame:
    return latest_per_key(scores.select("company_id", "scored_at", "momentum_score", "momentum_label"), ["company_id"], ["scored_at"])


def with_latest_score(companies: DataFrame, scores: DataFrame) -> DataFrame:
    return companies.join(latest_scores(scores).withColumnRenamed("company_id", "id"), "id", "left")


def with_active_jobs(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    n = jobs.filter("is_active").groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("active_jobs"))
    return companies.join(n, "id", "left").fillna(0, ["active_jobs"])


def industry_breakdown(companies: DataFrame, scores: DataFrame) -> DataFrame:
    rows = with_latest_score(companies.filter("is_active and industry is not null"), scores)
    return rows.groupBy("industry").agg(F.count("*").alias("companies"), F.avg("momentum_score").alias("avg_score"))


def jobs_by_family(jobs: DataFrame) -> DataFrame:
    return jobs.filter("is_active").groupBy(F.coalesce("role_family", F.lit("other")).alias("role_family")).agg(F.count("*").alias("active_jobs"))


def hiring_hotspots(jobs: DataFrame, companies: DataFrame, since: Column, n: int = 10) -> DataFrame:
    rows = jobs.filter(F.col("is_active") & (F.col("first_seen_at") >= since)).groupBy("company_id").agg(F.count("*").alias("new_jobs"))
    return with_company(rows, companies).orderBy(F.desc("new_jobs"), "company_id").limit(n)


def public_events(events: DataFrame) -> DataFrame:
    """Canonical, active events: all that readers see."""
    return events.filter(F.col("is_canonical") & (F.col("status") == "active"))


def _public(events: DataFrame) -> DataFrame:
    """What readers may see, where the events say so."""
    return public_events(events) if {"is_canonical", "status"} <= set(events.columns) else events


def event_counts(events: DataFrame, as_of: Column) -> DataFrame:
    return _public(events).groupBy("company_id").agg(F.count("*").alias("events"), F.count_if(F.col("observed_at") >= as_of - F.expr("INTERVAL 30 DAYS")).alias("events_30d"))


def recent_events(events: DataFrame, companies: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy(F.desc_nulls_last("observed_at"), F.desc("id"))
    return with_company(_public(events).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n), companies)


def top_signal(events: DataFrame) -> DataFrame:
    return _public(events).groupBy("company_id").agg(F.max_by("title", F.struct("observed_at", "id")).alias("headline"))


def platform_stats(companies: DataFrame, jobs: DataFrame, events: DataFrame, as_of: Column, sources: DataFrame | None = None) -> DataFrame:
    """One row of totals of public events; with sources (last_successful_crawl) also the newest crawl that worked."""
    events = _public(events)
    parts = (
        companies.agg(F.count_if("is_active").alias("active_companies")),
        jobs.agg(F.count_if("is_active").alias("active_jobs")),
        events.agg(F.count_if(F.col("observed_at") >= as_of - F.expr("INTERVAL 30 DAYS")).alias("events_30d"), F.count_distinct("company_id").alias("covered_companies")),
        *([sources.agg(F.max("last_successful_crawl").alias("last_crawl"))] if sources is not None else []),
    )
    out = parts[0]
    for p in parts[1:]:  # rows of one aggregate each
        out = out.join(F.broadcast(p))
    return out


def trending(companies: DataFrame, scores: DataFrame, jobs: DataFrame, events: DataFrame, since: Column, n: int, only_up: bool = False, industry: str | None = None) -> DataFrame:
    moved = score_movement(scores, since).withColumnRenamed("company_id", "id")
    active = companies.filter("is_active")
    rows = (active.filter(F.col("industry") == industry) if industry is not None else active).join(moved, "id")
    rows = rows.filter("delta > 0") if only_up else rows
    top = rows.orderBy(F.desc("delta"), "id").limit(n)
    return with_active_jobs(top, jobs).join(top_signal(events).withColumnRenamed("company_id", "id"), "id", "left")


def search_contains(df: DataFrame, q: str, *cols: str) -> DataFrame:
    """Rows where one of the columns holds q, letter case aside; % and _ stand for themselves."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.lower(c).contains(q.lower()), F.lit(False))
    return df.filter(hit)


def paginate(df: DataFrame, order: list[Column], page: int, per_page: int) -> tuple[DataFrame, DataFrame]:
    """The page's rows; and one row total, total_pages, has_next, has_prev."""
    per_page = min(max(per_page, 1), 100)
    total = F.count("*")
    pages = F.ceil(total / per_page)
    meta = df.agg(total.alias("total"), pages.alias("total_pages"), (pages > page).alias("has_next"), (F.lit(page > 1) & (total > 0)).alias("has_prev"))
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page), meta


def company_detail(companies: DataFrame, scores: DataFrame, jobs: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    rows = with_active_jobs(with_latest_score(companies, scores), jobs)
    counts, top = event_counts(events, as_of), top_signal(events)
    return rows.join(counts.withColumnRenamed("company_id", "id"), "id", "left").join(top.withColumnRenamed("company_id", "id"), "id", "left").fillna(0, ["events", "events_30d"])


def newest(rows: DataFrame, key: str, order: list[Column], n: int, fields: list[str], name: str) -> DataFrame:
    """key, name: an array of the first n rows of each key by order. Spark cuts to n within each task before anything is shuffled, so no list is longer."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    top = rows.select(key, *fields, place.alias("__tm_place")).filter(F.col("__tm_place") <= n)
    each = F.collect_list(F.struct("__tm_place", F.struct(*fields).alias("row")))
    return top.groupBy(key).agg(F.transform(F.array_sort(each), lambda e: e["row"]).alias(name))


def company_profile(companies: DataFrame, scores: DataFrame, jobs: DataFrame, events: DataFrame, sources: DataFrame, as_of: Column, n_scores: int = 10, n_events: int = 5) -> DataFrame:
    """The company page, a row for each company: newest score with its delta (null for a first score), score_history oldest first, active_jobs and
    jobs_by_family, events and events_30d, recent_events (both of public events, newest first) and the approved sources.

    companies: id, name, slug, industry; scores: company_id, scored_at, momentum_score, momentum_label; events: id, company_id, title, event_type, observed_at.
    """
    points = newest(scores, "company_id", [F.desc("scored_at")], n_scores, ["scored_at", "momentum_score", "momentum_label"], "points")
    public = _public(events)
    recent = newest(public, "company_id", [F.desc_nulls_last("observed_at"), F.desc("id")], n_events, ["id", "event_type", "title", "observed_at"], "recent_events")
    families = jobs.filter("is_active").groupBy("company_id", F.coalesce("role_family", F.lit("other")).alias("family")).agg(F.count("*").alias("n"))
    families = families.groupBy("company_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("family", "n")))).alias("jobs_by_family"), F.sum("n").alias("active_jobs"))
    approved = sources.filter("status = 'approved' AND company_id IS NOT NULL").groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("source_type", "url"))).alias("sources"))
    rows = companies.withColumnRenamed("id", "company_id")
    for part in (points, event_counts(public, as_of), recent, families, approved):
        rows = rows.join(part, "company_id", "left")
    score = lambda i: F.get("points", F.lit(i))
    rows = rows.withColumns({
        "momentum_score": score(0)["momentum_score"], "momentum_label": score(0)["momentum_label"], "scored_at": score(0)["scored_at"], "score_delta": score(0)["momentum_score"] - score(1)["momentum_score"],
        "score_history": F.reverse("points"),
    })
    return rows.fillna(0, ["active_jobs", "events", "events_30d"]).drop("points").withColumnRenamed("company_id", "id")


def compare_profiles(companies: DataFrame, scores: DataFrame, jobs: DataFrame, events: DataFrame, slugs: list[str], as_of: Column) -> DataFrame:
    """The profiles of two to five companies in the order asked for, with ten scores and three events each; only their rows of the tables are read into it."""
    asked = compare_companies(companies, slugs).filter("id IS NOT NULL")
    own = lambda df: df.join(F.broadcast(asked.select(F.col("id").alias("company_id"))), "company_id", "left_semi")
    none = companies.sparkSession.createDataFrame([], "company_id long, status string, source_type string, url string")
    return company_profile(asked, own(scores), own(jobs), own(events), none, as_of, n_events=3)


def compare_companies(companies: DataFrame, slugs: list[str]) -> DataFrame:
    """Two to five companies in the order asked for; repeats collapse, missing slugs are rows without a company."""
    wanted = list(dict.fromkeys(slugs))
    if not 2 <= len(wanted) <= 5:
        raise ValueError("compare two to five companies")
    asked = companies.sparkSession.createDataFrame([(i, s) for i, s in enumerate(wanted)], "place int, slug string")
    return F.broadcast(asked).join(companies, "slug", "left")
