"""Snapshot reconciliation, content changes, source health, quotas and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reconcile(stored: DataFrame, incoming: DataFrame, keys: list[str], hash_col: str, *, board: list[str] | None = None, allow_close: bool = True) -> DataFrame:
    """keys, status: new, updated, unchanged, reopened or closed; one full outer join on the keys.

    ``stored`` has is_active. Boards (``board``, a subset of keys) without incoming rows are left alone: an empty scrape closes nothing.
    """
    s = stored.select(*keys, F.col(hash_col).alias("old_hash"), "is_active")
    if board:
        s = s.join(incoming.select(*board).distinct(), board, "left_semi")
    i = incoming.select(*keys, F.col(hash_col).alias("new_hash")).withColumn("there", F.lit(True))
    both = s.withColumn("known", F.lit(True)).join(i, keys, "full_outer")
    gone = F.col("there").isNull()
    status = (
        F.when(F.col("known").isNull(), "new").when(gone & F.col("is_active") & F.lit(allow_close), "closed").when(gone, "kept")
        .when(~F.col("is_active"), "reopened").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "updated").otherwise("unchanged")
    )
    return both.select(*keys, status.alias("status"))


def apply_reconciled(stored: DataFrame, incoming: DataFrame, keys: list[str], hash_col: str, now: Column, *, board: list[str] | None = None, allow_close: bool = True) -> DataFrame:
    """The stored table after a snapshot: keys, ``hash_col`` and the incoming's other columns, first_seen_at, last_seen_at, closed_at, is_active.

    Fields follow the incoming row only where the hash differs (or the row is new); what was seen is seen again now, what reopens is judged by its hash too.
    """
    status = reconcile(stored, incoming, keys, hash_col, board=board, allow_close=allow_close)
    fields = [c for c in incoming.columns if c not in keys]
    i = incoming.select(*keys, *[F.col(c).alias(f"__tm_{c}") for c in fields])
    rows = stored.join(status, keys, "full_outer").join(i, keys, "left")
    seen = F.col("status").isin("new", "updated", "unchanged", "reopened")
    take = (F.col("status") == "new") | (seen & ~F.col(hash_col).eqNullSafe(F.col(f"__tm_{hash_col}")))
    closed = F.col("status") == "closed"
    return rows.select(
        *keys, *[F.when(take, F.col(f"__tm_{c}")).otherwise(F.col(c)).alias(c) for c in fields],
        F.when(F.col("status") == "new", now).otherwise(F.col("first_seen_at")).alias("first_seen_at"), F.when(seen, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(closed, now).when(~seen | F.col("status").isNull(), F.col("closed_at")).alias("closed_at"), F.when(seen, True).when(closed, False).otherwise(F.col("is_active")).alias("is_active"),
    )


def reconcile_summary(result: DataFrame, by: list[str]) -> DataFrame:
    return result.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("new", "updated", "unchanged", "reopened", "closed")])


def snapshot_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with their side: removed (only a), both, added (only b)."""
    x, y = a.select(*keys).distinct().withColumn("in_a", F.lit(True)), b.select(*keys).distinct().withColumn("in_b", F.lit(True))
    side = F.when(F.col("in_b").isNull(), "removed").when(F.col("in_a").isNull(), "added").otherwise("both")
    return x.join(y, keys, "full_outer").select(*keys, side.alias("side"))


def content_changes(fetches: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """Fetches whose content differs from the one before; a key's first is a change."""
    h = F.sha2(F.coalesce(F.col(content), F.lit("")), 256)
    before = F.lag("content_hash").over(Window.partitionBy(key).orderBy(*order))
    return fetches.withColumn("content_hash", h).withColumn("changed", ~F.col("content_hash").eqNullSafe(before))


def source_health(logs: DataFrame, key: str, order: list[str], failed: str, frequency: int = 1440, disable_after: int = 10, most: int = 10_080, changed: str | None = None, reason: str | None = None, limited: str | None = None) -> DataFrame:
    """Failures since the last success, minutes until the next try, and whether the source is disabled: gaps and islands, then counts.

    After a success whose content did not change (``changed``) the wait is half as long again. ``reason`` names the column of which the last failure's is kept
    (500 characters) while the source fails; ``limited`` one that marks throttled fetches, which count as unchanged successes and on their own.
    """
    ok = ~F.col(failed)
    island = F.sum(ok.cast("long")).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = logs.select(key, failed, island.alias("island"))
    last = rows.groupBy(key, "island").agg(F.count_if(F.col(failed)).alias("failures"), F.count("*").alias("n"))
    out = last.groupBy(key).agg(F.max_by("failures", "island").alias("consecutive_failures"), F.sum("n").alias("fetches"), F.sum("failures").alias("failures"))
    wait = F.when(F.col("consecutive_failures") == 0, F.lit(frequency)).otherwise(F.least(frequency * F.pow(F.lit(2.0), F.least("consecutive_failures", F.lit(30))), F.lit(most)).cast("long"))
    ends = [F.struct(*order)]
    last_of = lambda c: F.max_by(c, *ends)
    more = [last_of(F.col(c)).alias(n) for c, n in ((changed, "__tm_changed"), (reason, "__tm_reason")) if c]
    if limited:
        more.append(F.count_if(limited).alias("rate_limited"))
        more.append(last_of(F.col(limited)).alias("__tm_limited"))
    if more:
        out = out.join(logs.groupBy(key).agg(*more), key)
        quiet = F.lit(False) if not changed else ~F.coalesce("__tm_changed", F.lit(True))
        quiet = quiet | F.col("__tm_limited") if limited else quiet
        wait = F.when((F.col("consecutive_failures") == 0) & quiet, F.lit(int(frequency * 1.5))).otherwise(wait)
        if reason:
            out = out.withColumn("failure_reason", F.when(F.col("consecutive_failures") > 0, F.substring("__tm_reason", 1, 500)))
    out = out.withColumn("next_minutes", wait.cast("long")).withColumn("disabled", F.col("consecutive_failures") >= disable_after)
    return out.drop("__tm_changed", "__tm_reason", "__tm_limited")


def daily_quota(calls: DataFrame, key: str, ts: str, order: list[str], limit: int) -> DataFrame:
    """Per key and UTC day: calls, allowed (the first ``limit``), remaining."""
    w = Window.partitionBy(key, F.to_date(ts)).orderBy(*order)
    rows = calls.withColumn("place", F.row_number().over(w))
    return rows.groupBy(key, F.to_date(ts).cast("string").alias("day")).agg(F.count("*").alias("calls"), F.count_if(F.col("place") <= limit).alias("allowed")).withColumn("remaining", F.lit(limit) - F.col("allowed"))


def retention(df: DataFrame, ts: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Rows at or after the cutoff (or without a time), and one row of counts."""
    keep = F.coalesce(F.col(ts) >= cutoff, F.lit(True))
    return df.filter(keep), df.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


def dedupe_keep(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    rest = F.struct(*[c for c in df.columns if c not in keys])
    pick = F.min_by if keep == "first" else F.max_by
    return df.groupBy(*keys).agg(pick(rest, F.struct(*order)).alias("r")).select(*keys, "r.*")


def register_new(existing: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Incoming rows whose key isn't registered; the first of each key."""
    return dedupe_keep(incoming, [key], order).join(existing.select(key).distinct(), key, "left_anti")


def stalest(df: DataFrame, ts: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.asc_nulls_first(ts), tie).limit(n)
