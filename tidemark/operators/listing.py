"""Listings, searches and lookups over companies, events, jobs, sources and subscribers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import reports as R
from tidemark.operators.reports import public_events

PREVIEW = 5


def _equal(df: DataFrame, **wanted: object) -> DataFrame:
    for c, v in wanted.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df


def _sorted(df: DataFrame, sort_by: str, sort_order: str, allowed: tuple[str, ...], tie: Column) -> DataFrame:
    if sort_by not in allowed:
        raise ValueError(f"sort_by must be one of {', '.join(allowed)}")
    return df.orderBy(F.desc_nulls_last(sort_by) if sort_order == "desc" else F.asc_nulls_last(sort_by), tie)


def list_events(
    events: DataFrame, companies: DataFrame, *, event_type: str | None = None, company_slug: str | None = None, days: int | None = None,
    as_of: Column | None = None, sort_by: str = "observed_at", sort_order: str = "desc",
) -> DataFrame:
    """Public events with their company; ``days`` counts back from as_of by when an event was observed."""
    rows = _equal(public_events(events), event_type=event_type)
    rows = rows.filter(F.col("observed_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")) if days else rows
    return _sorted(_equal(R.with_company(rows, companies), company_slug=company_slug), sort_by, sort_order, ("observed_at", "occurred_at"), F.desc("id"))


def list_jobs(
    jobs: DataFrame, companies: DataFrame, *, company_slug: str | None = None, role_family: str | None = None, seniority: str | None = None, work_mode: str | None = None,
    is_active: bool | None = True, search: str | None = None, sort_by: str = "first_seen_at", sort_order: str = "desc",
) -> DataFrame:
    """Jobs with their company; % and _ in ``search`` act as wildcards on the title."""
    rows = _equal(jobs, role_family=role_family, seniority=seniority, work_mode=work_mode, is_active=is_active)
    rows = rows.filter(F.col("title").ilike(f"%{search}%")) if search else rows
    return _sorted(_equal(R.with_company(rows, companies), company_slug=company_slug), sort_by, sort_order, ("first_seen_at", "last_seen_at", "title"), F.desc("id"))


def list_companies(
    companies: DataFrame, scores: DataFrame, jobs: DataFrame, *, industry: str | None = None, stage: str | None = None, is_active: bool | None = None, search: str | None = None,
    min_score: float | None = None, has_active_jobs: bool | None = None, sort_by: str = "name", sort_order: str = "asc",
) -> DataFrame:
    """Companies with latest score and active jobs; ``search`` takes wildcards in name and domain; min_score drops companies without a score."""
    rows = _equal(companies, industry=industry, stage=stage, is_active=is_active)
    if search:
        pattern = f"%{search.lower()}%"
        rows = rows.filter(F.lower("name").like(pattern) | F.coalesce(F.lower("canonical_domain").like(pattern), F.lit(False)))
    rows = R.with_active_jobs(R.with_latest_score(rows, scores), jobs)
    rows = rows.filter(F.col("momentum_score") >= min_score) if min_score is not None else rows
    rows = rows.filter((F.col("active_jobs") > 0) == has_active_jobs) if has_active_jobs is not None else rows
    return _sorted(rows, sort_by, sort_order, ("name", "momentum_score", "active_jobs", "created_at"), F.asc("id"))


def list_sources(sources: DataFrame, *, status: str | None = None, company_id: object = None, source_type: str | None = None, submitted_by: object = None) -> DataFrame:
    return _equal(sources, status=status, company_id=company_id, source_type=source_type, submitted_by=submitted_by).orderBy(F.desc_nulls_last("created_at"), "id")


def company_sources(sources: DataFrame, company_id: object = None) -> DataFrame:
    """Approved sources of one company, or of each, by type and address."""
    return _equal(sources.filter("status = 'approved'"), company_id=company_id).orderBy("company_id", "source_type", "url")


def browse_sources(sources: DataFrame, companies: DataFrame) -> DataFrame:
    """slug, name, sources (array of struct source_type, url, id; sorted) of the approved sources: a row for each company, and one for each source of no company, under a null slug.

    Sources of no company are as many as the table has, so they are rows and never one list.
    """
    named = companies.select(F.col("id").alias("company_id"), "slug", "name")
    rows = sources.filter("status = 'approved'").join(named, "company_id", "left").withColumn("alone", F.when(F.col("slug").isNull(), F.col("id")))
    return rows.groupBy("slug", "name", "alone").agg(F.sort_array(F.collect_list(F.struct("source_type", "url", "id"))).alias("sources")).drop("alone")


def drop_superseded(sources: DataFrame) -> DataFrame:
    """Without the career pages of companies that have an approved board."""
    boards = sources.filter("fetch_tier = 'ats_api' AND status = 'approved' AND company_id IS NOT NULL").select("company_id").distinct()
    pages = F.col("source_type") == "career_page"
    return sources.filter(~pages).unionByName(sources.filter(pages).join(boards, "company_id", "left_anti").select(*sources.columns))


def due_sources(sources: DataFrame, now: Column, limit: int = 10, lease: int = 60) -> DataFrame:
    """The approved sources that have been due longest, their next crawl put off by the lease in minutes."""
    due = sources.filter((F.col("status") == "approved") & (F.col("next_crawl_at") <= now)).orderBy("next_crawl_at", "id").limit(limit)
    return due.withColumn("next_crawl_at", now + F.expr(f"INTERVAL {lease} MINUTES"))


def crawler_health(sources: DataFrame, companies: DataFrame, n: int = 200, only_failing: bool = False) -> DataFrame:
    """Approved sources, most failures first, then the next to be crawled; those never crawled again last."""
    rows = sources.filter("status = 'approved'")
    rows = rows.filter("consecutive_failures > 0") if only_failing else rows
    rows = rows.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id", "left")
    return rows.orderBy(F.desc("consecutive_failures"), F.asc_nulls_last("next_crawl_at"), "id").limit(n)


def sync_targets(sources: DataFrame, companies: DataFrame) -> DataFrame:
    """Approved boards of active companies."""
    active = companies.filter("is_active").select(F.col("id").alias("company_id"))
    return sources.filter("source_type = 'ats_api' AND status = 'approved'").join(active, "company_id", "left_semi")


def rescore_set(summary: DataFrame) -> DataFrame:
    """company_id of those whose boards gained or lost postings."""
    return summary.filter((F.col("n_new") > 0) | (F.col("n_closed") > 0)).select("company_id").distinct()


def active_subscribers(subscribers: DataFrame) -> DataFrame:
    """Confirmed and still subscribed, in the order they came."""
    return subscribers.filter(F.col("is_active") & F.col("confirmed_at").isNotNull()).orderBy("created_at", "id")


def list_subscribers(subscribers: DataFrame, is_active: bool | None = None) -> DataFrame:
    return _equal(subscribers, is_active=is_active).orderBy(F.desc("created_at"), "id")


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows with that key; none if there is no such row or the value is null."""
    return df.filter(F.col(key) == F.lit(value))


def _holds(col: str, q: str) -> Column:
    """Whether a text holds q, letter case aside; % and _ stand for themselves."""
    return F.coalesce(F.lower(F.col(col)).contains(q.lower()), F.lit(False))


def search_companies(companies: DataFrame, scores: DataFrame, q: str) -> DataFrame:
    """Active companies whose name, slug, domain or description holds q, or one of whose aliases is q to the letter; by name."""
    hit = F.coalesce(F.array_contains("aliases", q), F.lit(False))
    for c in ("name", "slug", "canonical_domain", "description"):
        hit = hit | _holds(c, q)
    return R.with_latest_score(companies.filter(F.col("is_active") & hit), scores).orderBy("name", "id")


def search_events(events: DataFrame, companies: DataFrame, q: str) -> DataFrame:
    """Public events whose title or company's name holds q, newest first."""
    return R.with_company(public_events(events), companies).filter(_holds("title", q) | _holds("company_name", q)).orderBy(F.desc("observed_at"), F.desc("id"))


def search_all(sections: dict[str, DataFrame], order: dict[str, list[Column]], entity_type: str = "all", page: int = 1, per_page: int = 20) -> tuple[dict[str, DataFrame], DataFrame]:
    """The found rows of each section (company, job, event), and one row a section: section, total.

    ``all`` gives the first five of each section, a named section its page, and then the others are empty with a total of 0.
    """
    shown, totals = {}, None
    for name, rows in sections.items():
        wanted = entity_type in ("all", name)
        limit, offset = (PREVIEW, 0) if entity_type == "all" else (per_page, (page - 1) * per_page)
        shown[name] = rows.orderBy(*order[name]).offset(offset).limit(limit) if wanted else rows.limit(0)
        total = rows.agg(F.lit(name).alias("section"), (F.count("*") if wanted else F.lit(0).cast("long")).alias("total"))
        totals = total if totals is None else totals.unionByName(total)
    return shown, totals


def recent_activity(events: DataFrame, companies: DataFrame, n: int = 20, event_type: str | None = None) -> DataFrame:
    return R.with_company(_equal(public_events(events), event_type=event_type), companies).orderBy(F.desc("observed_at"), F.desc("id")).limit(n)
