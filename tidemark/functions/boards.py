"""Which job board, fetch tier and schedule a source's address stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scoring import lookup

# Boards by host and path, in order, with the address of their payload; vendors whose payloads can be read.
BOARDS = (
    (r"^(?:boards|job-boards)\.greenhouse\.io/([^/?#]+)", "greenhouse", "https://boards-api.greenhouse.io/v1/boards/{}/jobs?content=true"),
    (r"^boards-api\.greenhouse\.io/v1/boards/([^/?#]+)", "greenhouse", "https://boards-api.greenhouse.io/v1/boards/{}/jobs?content=true"),
    (r"^jobs\.lever\.co/([^/?#]+)", "lever", "https://api.lever.co/v0/postings/{}?mode=json"),
    (r"^api\.lever\.co/v0/postings/([^/?#]+)", "lever", "https://api.lever.co/v0/postings/{}?mode=json"),
    (r"^jobs\.ashbyhq\.com/([^/?#]+)", "ashby", "https://api.ashbyhq.com/posting-api/job-board/{}?includeCompensation=true"),
    (r"^api\.ashbyhq\.com/posting-api/job-board/([^/?#]+)", "ashby", "https://api.ashbyhq.com/posting-api/job-board/{}?includeCompensation=true"),
    (r"^apply\.workable\.com/([^/?#]+)", "workable", "https://apply.workable.com/api/v1/companies/{}/jobs"),
    (r"^([^.]+)\.recruitee\.com", "recruitee", "https://{}.recruitee.com/api/offers/"),
    (r"^([^.]+)\.breezy\.hr", "breezy", "https://{}.breezy.hr/positions?format=json"),
    (r"^([^.]+)\.freshteam\.com", "freshteam", "https://{}.freshteam.com/jobs.json"),
    (r"^([^.]+)\.pinpointhq\.com", "pinpoint", "https://{}.pinpointhq.com/jobs.json"),
)
# What the fetcher itself looks for anywhere in an address, in order; the words that are routes, not boards; payload addresses.
FETCHER = (
    (r"(?i)boards(?:-api)?\.greenhouse\.io/(?:embed/job_board\?for=)?([a-z0-9_-]+)", "greenhouse"),
    (r"(?i)job-boards\.greenhouse\.io/([a-z0-9_-]+)", "greenhouse"),
    (r"(?i)//([a-z0-9-]+)\.greenhouse\.io", "greenhouse"),
    (r"(?i)(?:jobs|api)\.lever\.co/(?:v0/postings/)?([a-z0-9_-]+)", "lever"),
    (r"(?i)(?:jobs|api)\.ashbyhq\.com/(?:posting-api/job-board/)?([a-z0-9_-]+)", "ashby"),
)
ROUTES = ("embed", "www", "api", "v0", "posting-api")
FETCHER_API = {
    "greenhouse": "https://boards-api.greenhouse.io/v1/boards/{}/jobs?content=true",
    "lever": "https://api.lever.co/v0/postings/{}?mode=json",
    "ashby": "https://api.ashbyhq.com/posting-api/job-board/{}",
}
READABLE = ("greenhouse", "lever", "ashby")
PSEUDO = ("newsapi://", "gnews://", "serpapi://")
FEED_HINTS = ("/feed", "/rss", "feed.xml", "rss.xml", "atom.xml", "/index.xml", ".cms")
# Minutes between crawls and trust, by source type.
FREQUENCIES = {
    "ats_api": 720, "career_page": 1440, "rss_feed": 360, "company_blog": 1440, "engineering_blog": 2880,
    "news_site": 360, "news_api": 360, "search_api": 1440, "github_org": 4320,
}
RELIABILITY = {
    "ats_api": 1.0, "career_page": 0.9, "company_blog": 0.9, "engineering_blog": 0.8, "news_site": 0.8,
    "rss_feed": 0.7, "news_api": 0.7, "search_api": 0.7, "github_org": 0.5,
}


def _filled(template: str, token: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), token, F.lit(after))


def detect_board(url: Column, mode: str = "source") -> Column:
    """struct<provider, token, api_url> or null; ``source``: anchored at host and path; ``fetcher``: anywhere, and routes are no boards."""
    out = F.lit(None).cast("struct<provider:string,token:string,api_url:string>")
    if mode == "fetcher":
        for pattern, provider in reversed(FETCHER):
            token = F.regexp_extract(url, pattern, 1)
            found = F.struct(F.lit(provider).alias("provider"), token.alias("token"), _filled(FETCHER_API[provider], token).alias("api_url"))
            out = F.when((token != "") & ~F.lower(token).isin(*ROUTES), found).otherwise(out)
        return out
    whole = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(F.regexp_extract(whole, r"^[^:]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(whole, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    target = F.concat(host, path)
    for pattern, provider, api in reversed(BOARDS):
        token = F.regexp_extract(target, pattern, 1)
        found = F.struct(F.lit(provider).alias("provider"), token.alias("token"), _filled(api, token).alias("api_url"))
        out = F.when(token != "", found).otherwise(out)
    return out


def is_pseudo_url(url: Column) -> Column:
    """Names of news and search interfaces, which are never fetched as addresses."""
    low, out = F.lower(url), F.lit(False)
    for scheme in PSEUDO:
        out = out | low.startswith(scheme)
    return out


def detect_fetch_tier(url: Column, source_type: Column) -> Column:
    low, feed = F.lower(url), F.lit(False)
    for hint in FEED_HINTS:
        feed = feed | low.contains(hint)
    return (
        F.when(low.startswith("newsapi://") | low.startswith("gnews://"), "news_api").when(low.startswith("serpapi://"), "search_api")
        .when(F.coalesce(detect_board(url)["provider"].isin(*READABLE), F.lit(False)), "ats_api").when(feed, "rss").when(source_type == "rss_feed", "rss")
        .when(source_type.isin("news_api", "search_api", "ats_api"), source_type).otherwise("static_http")
    )


def source_defaults(source_type: Column) -> tuple[Column, Column]:
    """Minutes between crawls, and reliability; null for an unknown type."""
    return lookup(FREQUENCIES, source_type, None), lookup(RELIABILITY, source_type, None)
