"""Momentum scores per company and what is derived from their series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scoring as S


def with_factor(events: DataFrame) -> DataFrame:
    """Events with ``factor``, that of the best tier of their evidence: of an array ``evidence`` if there is one, else of ``source_url``; a ``domain`` marks the company's own."""
    domain = F.col("domain") if "domain" in events.columns else None
    if "evidence" in events.columns:
        return events.withColumn("factor", S.best_tier_factor(F.transform("evidence", lambda e: e["source_url"]), domain))
    return events.withColumn("factor", S.tier_factor(S.source_tier(F.col("source_url"), domain)))


def weighted(events: DataFrame, as_of: Column) -> DataFrame:
    ts, factor = S.effective_time(F.col("occurred_at"), F.col("observed_at")), F.col("factor")
    events = events if "factor" in events.columns else with_factor(events)
    return events.withColumn("effective", ts).withColumn("weight", S.event_weight(F.col("event_type"), ts, as_of, F.col("source_count"), factor))


def _scored(rows: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    recent = F.max(F.col("effective") >= as_of - F.expr(f"INTERVAL {S.RECENT_DAYS} DAYS"))
    out = rows.groupBy(*keys).agg(F.sum("weight").alias("raw"), recent.alias("recent"), F.count("*").alias("n_events"))
    score = S.momentum(F.col("raw"))
    return out.select(*keys, score.alias("momentum_score"), S.momentum_label(score, F.col("recent")).alias("momentum_label"), F.col("raw").alias("signal_strength"), "n_events")


def momentum_scores(events: DataFrame, companies: DataFrame, as_of: Column) -> DataFrame:
    """A row for each company; one without events in the lookback scores 0 and is labelled none."""
    seen = weighted(events, as_of).filter(F.col("effective") >= as_of - F.expr(f"INTERVAL {S.LOOKBACK_DAYS} DAYS"))
    scored = _scored(seen, ["company_id"], as_of)
    out = companies.select(F.col("id").alias("company_id"), "name").join(scored, "company_id", "left")
    return out.fillna({"momentum_score": 0.0, "momentum_label": "none", "signal_strength": 0.0, "n_events": 0})


def momentum_report(events: DataFrame, companies: DataFrame, prev_scores: DataFrame, as_of: Column) -> DataFrame:
    """``momentum_scores`` of public events over all their evidence, with contributing_event_ids (heaviest first) and score_delta (null for a company's first score)."""
    public = events.filter(F.col("is_canonical") & (F.col("status") == "active")).join(companies.select(F.col("id").alias("company_id"), F.col("canonical_domain").alias("domain")), "company_id", "left")
    seen = weighted(public, as_of).filter(F.col("effective") >= as_of - F.expr(f"INTERVAL {S.LOOKBACK_DAYS} DAYS"))
    ids = seen.groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.abs("weight")).alias("w"), "id"))), lambda x: x["id"]).alias("contributing_event_ids"))
    before = latest_per_key(prev_scores.select("company_id", "scored_at", F.col("momentum_score").alias("before")), ["company_id"], ["scored_at"]).select("company_id", "before")
    rows = momentum_scores(seen.drop("effective", "weight"), companies, as_of).join(ids, "company_id", "left").join(before, "company_id", "left")
    none = F.expr("CAST(array() AS array<bigint>)")
    return rows.withColumn("contributing_event_ids", F.coalesce("contributing_event_ids", none)).withColumn("score_delta", F.col("momentum_score") - F.col("before")).drop("before")


def score_series(events: DataFrame, grid: list[str]) -> DataFrame:
    """company_id, scored_at (of the grid's dates) and score; an event counts from when it was observed. Each event meets only its grid dates."""
    dates = F.array(*[F.lit(d).cast("timestamp_ntz") for d in grid])
    ts = S.effective_time(F.col("occurred_at"), F.col("observed_at"))
    live = F.filter(dates, lambda d: (d >= F.col("observed_at")) & (ts >= d - F.expr(f"INTERVAL {S.LOOKBACK_DAYS} DAYS")))
    rows = weighted(with_factor(events).withColumn("scored_at", F.explode(live)), F.col("scored_at"))
    return _scored(rows, ["company_id", "scored_at"], F.col("scored_at"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row of each key by order; a hash aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def score_deltas(scores: DataFrame) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy("scored_at")
    return scores.withColumn("score_delta", F.col("momentum_score") - F.lag("momentum_score").over(w))


def score_movement(scores: DataFrame, since: Column) -> DataFrame:
    """Latest score against the last one before ``since`` (0 if there is none), in one aggregate."""
    before = F.when(F.col("scored_at") < since, F.col("scored_at"))
    out = scores.groupBy("company_id").agg(F.max_by("momentum_score", "scored_at").alias("latest"), F.max_by("momentum_score", before).alias("baseline"))
    return out.withColumn("delta", F.col("latest") - F.coalesce("baseline", F.lit(0.0)))


def score_history(scores: DataFrame, n: int, days: int | None = None, as_of: Column | None = None) -> DataFrame:
    """The last n scores of each company, of the last ``days`` if given, with their place, newest first."""
    scores = scores.filter(F.col("scored_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")) if days is not None else scores
    w = Window.partitionBy("company_id").orderBy(F.desc("scored_at"))
    return scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
