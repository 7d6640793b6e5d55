"""Column functions of the momentum score; the clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import bound, holds_any

# Fixed values of the scoring model.
BASE_WEIGHTS = {"funding": 25, "new_office": 20, "leadership_change": 18, "engineering_expansion": 15, "ai_division": 15, "infrastructure_investment": 10, "product_launch": 8, "acquisition": 12, "partnership": 5, "career_page_update": 8, "layoff": -20}
HALF_LIVES = {"funding": 120, "new_office": 90, "leadership_change": 90, "engineering_expansion": 60, "ai_division": 90, "infrastructure_investment": 60, "product_launch": 45, "acquisition": 90, "partnership": 30, "career_page_update": 14, "layoff": 90}
TIER_FACTORS = {"first_party": 1.0, "tier1_press": 0.9, "aggregator": 0.7, "blog": 0.5, "rumor": 0.3}
PRESS = ("techcrunch.com", "yourstory.com", "inc42.com", "entrackr.com", "economictimes.indiatimes.com", "livemint.com", "moneycontrol.com", "business-standard.com", "thehindubusinessline.com", "reuters.com", "bloomberg.com", "forbes.com", "vccircle.com")
AGGREGATORS = ("newsapi", "gnews", "serpapi", "news.google", "bing.com")
BOARDS = ("greenhouse.io", "lever.co", "ashbyhq.com", "workable.com", "recruitee.com", "breezy.hr", "freshteam.com", "pinpointhq.com")
LOOKBACK_DAYS, RECENT_DAYS, MIDPOINT, STEEPNESS, DEFAULT_HALF_LIFE = 180, 30, 50.0, 20.0, 90


def lookup(table: dict, key: Column, default: object) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def host(url: Column) -> Column:
    """Lower-case host of a URL, or the text itself if it has none, without a leading www."""
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(F.when(h == "", url).otherwise(h)), r"^www\.", "")


def source_tier(url: Column, domain: Column | None = None) -> Column:
    """The host is taken from the address once, not for each name it is held against."""

    def judged(h: Column) -> Column:
        own = F.coalesce((F.length(domain) > 0) & h.contains(F.lower(domain)), F.lit(False)) if domain is not None else F.lit(False)
        return (
            F.when(own | holds_any(h, BOARDS), "first_party").when(holds_any(h, PRESS), "tier1_press")
            .when(holds_any(h, AGGREGATORS) | holds_any(F.lower(url), AGGREGATORS), "aggregator").when(h != "", "blog").otherwise("rumor")
        )

    return F.when(url.isNull() | (url == ""), "rumor").otherwise(bound(host(url), judged))


def effective_time(occurred: Column, observed: Column) -> Column:
    return F.coalesce(occurred, observed)


def age_days(ts: Column, as_of: Column) -> Column:
    """Whole elapsed days, never negative."""
    return F.greatest(F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000), F.lit(0))


def decay(ts: Column, as_of: Column, event_type: Column) -> Column:
    return F.pow(F.lit(0.5), age_days(ts, as_of) / lookup(HALF_LIVES, event_type, DEFAULT_HALF_LIFE))


def corroboration(n: Column) -> Column:
    n = F.when(F.coalesce(n, F.lit(0)) == 0, 1).otherwise(n)
    return 0.7 + 0.3 * F.least(n, F.lit(5)) / 5


def tier_factor(tier: Column) -> Column:
    return lookup(TIER_FACTORS, tier, 0.3)


def best_tier_factor(urls: Column, domain: Column | None = None) -> Column:
    """Of an array of evidence URLs; none is a rumour."""
    return F.coalesce(F.array_max(F.transform(urls, lambda u: tier_factor(source_tier(u, domain)))), F.lit(0.3))


def event_weight(event_type: Column, ts: Column, as_of: Column, n: Column, factor: Column) -> Column:
    return lookup(BASE_WEIGHTS, event_type, 0) * decay(ts, as_of, event_type) * corroboration(n) * factor


def momentum(raw: Column) -> Column:
    return F.greatest(F.least(100 / (1 + F.exp(-(raw - MIDPOINT) / STEEPNESS)), F.lit(100.0)), F.lit(0.0))


def momentum_label(score: Column, recent: Column) -> Column:
    """The label names follow ascending thresholds on the unrounded score."""
    return F.when((score < 10) & ~recent, "none").when(score < 25, "low").when(score < 50, "moderate").when(score < 75, "high").otherwise("very_high")
