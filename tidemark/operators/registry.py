"""A hand-kept registry of companies and publications in Markdown tables, as rows, companies and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import boards as B
from tidemark.functions import text as T
from tidemark.functions.scoring import lookup

# Spellings of column names, what each section holds, words that stand for nothing.
HEADER_ALIASES = {
    "career_pg": "career_page", "eng_blog": "engineering_blog", "github_org": "github_organization", "github_url": "github_organization", "public_api": "public_api_available",
    "api_docs": "api_documentation", "crawl_method": "crawl_method_recommendation", "frequency": "suggested_crawl_frequency", "crawl_frequency": "suggested_crawl_frequency",
    "feed_name": "name", "rss_atom_feed_url": "rss_feed", "source_category": "category", "parent_company": "name",
}
COMPANY_SECTIONS = ("indian_unicorns", "indian_startups", "ai_companies", "global_engineering_blogs")
NEWS_SECTIONS = ("startup_news", "tech_news", "vcs", "accelerators", "rss_feeds")
ENRICHMENT_SECTIONS = ("github_orgs",)
BLOG_SECTION = "global_engineering_blogs"
NOTHING = ("", "n/a", "na", "none", "-", "unknown", "tbd")
# Patterns of names.
QUALIFIER = (
    r"(?i)\b(india|global|us|uk)?\s*(r&d|ops|operations|subsidiary|india ops|ai infra|infra|posting surface, not ats|via rss|recruiter tool|vc arm)\b"
)
PUBLICATION = (
    r"(?i)\s*\b(tech ?blog|technology blog|engineering blog|eng blog|research blog|machine learning research|code as craft|architecture blog|engineering|blog|science|hacks|newsletter)\b\s*$"
)
GENERIC = (
    "ai", "api", "blog", "eng", "engineering", "etc", "global", "group", "holdings", "inc", "india", "infra", "labs", "ltd", "newsletter", "news", "ops", "research", "science",
    "startup", "startups", "subsidiary", "subsidiary lines", "tech", "technology", "uk", "us", "usa", "ventures",
)
URL = r"(?i)^(?:https?://)?[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+(?:/[^\s]*)?$"
# Schedules, trust, hosts that many share, and the columns that name sources (type, tier, floor and default minutes, reliability).
FREQUENCY = {"hourly": 60, "daily": 1440, "weekly": 10080, "biweekly": 20160, "monthly": 43200}
PRIORITY = {"high": 0.9, "medium": 0.7, "low": 0.5}
SHARED_HOSTS = ("medium.com", "github.io", "substack.com", "wordpress.com", "blogspot.com", "netlify.app", "vercel.app", "notion.site", "wixsite.com", "ghost.io")
SITE_PREFIXES = (
    "jobs.", "careers.", "career.", "hiring.", "hire.", "apply.", "blog.", "blogs.", "eng.", "engineering.", "tech.", "developer.", "developers.", "news.", "about.", "life.", "www.",
)
COLUMN_SOURCES = (
    ("career_page", "career_page", "static_http", 720, 1440, 0.9), ("company_blog", "company_blog", "static_http", 720, 1440, 0.8),
    ("engineering_blog", "engineering_blog", "static_http", 1440, 2880, 0.8), ("rss_feed", "rss_feed", "rss", 180, 360, 0.7),
    ("github_organization", "github_org", "static_http", 10080, 10080, 0.5),
)
NEWS_COLUMNS = ("company_blog", "engineering_blog", "rss_feed")
BOARD_COLUMNS = ("career_page", "ats_board", "website", "api_documentation")
BOARD_OF_VENDOR = {"greenhouse": "https://boards.greenhouse.io/", "lever": "https://jobs.lever.co/", "ashby": "https://jobs.ashbyhq.com/"}
BOARD_MINUTES = 720


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``registry_rows`` of Markdown files, each read whole."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return registry_rows(files)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with new columns that later steps read without computing them again: the optimizer merges projections, but not through a generator."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__tm_made")
    return df.select(*[c for c in df.columns if c not in columns], made).select("*", "__tm_made.*").drop("__tm_made")


def _slug(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clean_cell(col: Column) -> Column:
    """Without emphasis; the many spellings of nothing are empty."""
    t = F.trim(F.regexp_replace(F.trim(col), "^[*`]+|[*`]+$", ""))
    return F.when(F.lower(t).isin(*NOTHING), "").otherwise(t)


def registry_rows(files: DataFrame) -> DataFrame:
    """file, lineno, section, data (map of column to cell): the table rows under known sections that have a name.

    files: file, text. A heading names the section of what follows; a table's first line names its columns, of which
    one that a later column takes the name of gets a leading underscore; rows of another width go.
    """
    lines = files.select("file", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("lineno", "raw")).select("file", (F.col("lineno") + 1).cast("long").alias("lineno"), F.trim("raw").alias("line"))
    heading, table = F.col("line").startswith("#"), F.col("line").startswith("|")
    of_file = Window.partitionBy("file").orderBy("lineno")
    named = F.regexp_replace(_slug(F.regexp_replace(F.regexp_replace("line", "^#+", ""), r"\*.*$", "")), "_txt$", "")
    # a file is a hand-kept document: its lines are few, and each file is a group of its own
    lines = lines.withColumn("section", F.last(F.when(heading, named), ignorenulls=True).over(of_file)).withColumn("under", F.sum(heading.cast("long")).over(of_file))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|", -1), F.trim)
    lines = computed(lines.filter(table), {"cells": cells}).filter(~F.forall("cells", lambda c: c.rlike("^[-: ]+$")))
    first = F.row_number().over(Window.partitionBy("file", "under").orderBy("lineno")) == 1
    lines = lines.withColumn("header", F.first("cells").over(Window.partitionBy("file", "under").orderBy("lineno"))).withColumn("is_header", first)
    rows = lines.filter(~F.col("is_header") & (F.size("cells") == F.size("header")) & F.col("section").isin(*COMPANY_SECTIONS, *NEWS_SECTIONS, *ENRICHMENT_SECTIONS))
    alias = F.transform("header", lambda h: lookup(HEADER_ALIASES, _slug(h), None))
    plain = F.transform("header", _slug)
    names = F.zip_with(alias, plain, lambda a, p: F.coalesce(a, p))
    # of columns with one name the last keeps it, those before get as many underscores as there are columns after them
    rows = computed(rows, {"names": names})
    later = lambda n, i: F.size(F.filter(F.slice("names", i + 2, F.size("names")), lambda m: m == n))
    rows = computed(rows, {"names": F.transform("names", lambda n, i: F.concat(F.repeat(F.lit("_"), later(n, i)), n))})
    whole = F.size("names") == F.size("cells")  # a filter may be moved past the one above
    rows = computed(rows, {"data": F.when(whole, F.map_from_arrays("names", F.transform("cells", clean_cell)))})
    return rows.filter(F.coalesce(F.col("data")["name"], F.lit("")) != "").select("file", "lineno", "section", "data")


def registry_url(cell: Column) -> Column:
    """An absolute address, or empty if the cell is not an address alone."""
    t = F.coalesce(clean_cell(cell), F.lit(""))
    return F.when(~t.rlike(URL), "").when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def _tidy(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, r"\s+", " "), "^[ –,-]+|[ –,-]+$", "")


def company_name(name: Column, section: Column) -> Column:
    """What a row is about: in the section of blogs without parentheses and the publication's suffix, unless nothing is left."""
    bare = _tidy(F.regexp_replace(F.regexp_replace(name, r"\([^)]+\)", ""), PUBLICATION, ""))
    return F.when((section == BLOG_SECTION) & (bare != ""), bare).otherwise(_tidy(name))


def name_aliases(name: Column, section: Column) -> Column:
    """Other names: those in parentheses, those parted by slashes, and each without qualifiers and suffix; none generic, of two letters or the name itself."""
    inner = F.flatten(F.transform(F.regexp_extract_all(name, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda x: F.split(x, r"[,/]| and ")))
    inner = F.transform(inner, lambda p: _tidy(F.regexp_replace(F.trim(p), r"(?i)^(formerly|now|aka|previously)\s+", "")))
    inner = F.filter(inner, lambda p: (p != "") & ~p.rlike(f"^(?:{QUALIFIER})$"))
    outer = F.transform(F.split(_tidy(F.regexp_replace(name, r"\([^)]+\)", "")), r"\s*/\s*"), lambda p: _tidy(F.regexp_replace(p, QUALIFIER, "")))
    outer = F.flatten(F.transform(outer, lambda p: F.array(p, company_name(p, section))))
    fit = lambda own: F.filter(F.concat(inner, outer), lambda a: (F.length(a) > 2) & ~F.lower(a).isin(*GENERIC) & a.rlike(r"\p{L}") & (F.lower(a) != own))
    return T.clean_str_list(T.bound(F.lower(company_name(name, section)), fit))


def merge_aliases(a: Column, b: Column) -> Column:
    """The union, letter case aside, in order; the first spelling stays."""
    none = F.expr("CAST(array() AS array<string>)")
    return T.clean_str_list(F.concat(F.coalesce(a, none), F.coalesce(b, none)))


def company_domain(*urls: Column) -> Column:
    """The first address's domain that is not a host many share, without one site prefix if more than a dot is in it; empty if there is none."""
    def usable(d: Column) -> Column:
        several = F.length(d) - F.length(F.replace(d, F.lit("."), F.lit(""))) > 1
        prefix = "^(?:" + "|".join(p.replace(".", r"\.") for p in SITE_PREFIXES) + ")"
        return F.when((d != "") & ~d.isin(*SHARED_HOSTS), F.when(several, F.regexp_replace(d, prefix, "")).otherwise(d))

    return F.coalesce(*[T.bound(T.normalize_domain(u), usable) for u in urls], F.lit(""))


def registry_names(rows: DataFrame) -> DataFrame:
    """``registry_rows`` with name, aliases, slug, website, domain, is_news, is_enrichment, requires_js, minutes, reliability and, from the vendor named, the likely board token."""
    rows = computed(rows, {f"__tm_{c}": F.coalesce(F.col("data")[c], F.lit("")) for c in (
        "name", "website", "career_page", "company_blog", "engineering_blog", "crawl_method_recommendation", "suggested_crawl_frequency", "priority", "category", "country")})
    d = lambda c: F.col(f"__tm_{c}")
    rows = computed(rows, {f"__tm_{c}": registry_url(d(c)) for c in ("website", "career_page", "company_blog", "engineering_blog")})
    out = computed(rows, {
        "name": company_name(d("name"), F.col("section")), "aliases": name_aliases(d("name"), F.col("section")), "website": d("website"),
        "domain": company_domain(*[d(c) for c in ("website", "career_page", "company_blog", "engineering_blog")]),
        "is_news": F.col("section").isin(*NEWS_SECTIONS), "is_enrichment": F.col("section").isin(*ENRICHMENT_SECTIONS),
        "requires_js": F.lower(d("crawl_method_recommendation")).contains("playwright"), "minutes": lookup(FREQUENCY, F.lower(F.trim(d("suggested_crawl_frequency"))), None),
        "reliability": lookup(PRIORITY, F.lower(F.trim(d("priority"))), None), "category": F.nullif(d("category"), F.lit("")), "country": F.nullif(d("country"), F.lit("")),
    })
    out = out.drop(*[c for c in out.columns if c.startswith("__tm_")])
    host = T.normalize_domain(F.col("website"))
    tokens = F.array(T.slugify(F.col("name")), F.regexp_replace(F.lower("name"), "[^a-z0-9]+", ""), F.when((host != "") & ~host.isin(*SHARED_HOSTS), F.substring_index(host, ".", 1)))
    return computed(out, {"slug": T.slugify(F.col("name")), "tokens": F.array_distinct(F.filter(tokens, lambda t: F.length(t) > 0))})


def upsert_companies(named: DataFrame, companies: DataFrame) -> DataFrame:
    """slug, name, canonical_domain, aliases, status of each company touched: updated (new aliases), known or inserted; and ``rows``, the (file, lineno) behind it.

    named: ``registry_names``; companies: slug, name, canonical_domain, aliases. Publications never make a company, enrichment rows only match by name or slug, rows without a
    domain go. Rows of one domain are one company, then those of one slug; the first row names it. Stored companies are found by domain first, then by slug.
    """
    own = named.filter(~F.col("is_news") & ~F.col("is_enrichment") & (F.col("domain") != ""))
    first = lambda keys: Window.partitionBy(*keys).orderBy("file", "lineno")
    own = own.withColumn("slug", F.first("slug").over(first(["domain"]))).withColumn("domain", F.first("domain").over(first(["slug"])))
    spelt = F.transform(F.array_sort(F.collect_list(F.struct("file", "lineno", F.concat(F.array("name"), "aliases").alias("names")))), lambda r: r["names"])
    made = own.groupBy("slug", "domain").agg(F.min_by("name", F.struct("file", "lineno")).alias("name"), F.flatten(spelt).alias("names"), F.collect_list(F.struct("file", "lineno")).alias("rows"))
    by_domain = companies.select(F.col("canonical_domain").alias("domain"), F.col("slug").alias("d_slug"))
    by_slug = companies.select(F.col("slug"), F.col("slug").alias("s_slug"))
    made = made.join(by_domain, "domain", "left").join(by_slug, "slug", "left").withColumn("known", F.coalesce("d_slug", "s_slug"))
    stored = companies.select(F.col("slug").alias("known"), F.col("name").alias("k_name"), F.col("canonical_domain").alias("k_domain"), F.col("aliases").alias("k_aliases"))
    rows = made.join(stored, "known", "left")
    kept_name = F.coalesce("k_name", "name")
    rows = computed(rows, {"kept_name": kept_name, "low_name": F.lower(kept_name), "merged": merge_aliases(F.col("k_aliases"), F.col("names"))})
    rows = computed(rows, {"extra": F.filter("merged", lambda a: F.lower(a) != F.col("low_name"))})
    kept_name, extra = F.col("kept_name"), F.col("extra")
    before = F.size(F.coalesce("k_aliases", F.expr("CAST(array() AS array<string>)")))
    status = F.when(F.col("known").isNull(), "inserted").when(F.size(extra) > before, "updated").otherwise("known")
    return rows.select(F.coalesce("known", "slug").alias("slug"), kept_name.alias("name"), F.coalesce("k_domain", "domain").alias("canonical_domain"), extra.alias("aliases"), status.alias("status"), "rows")


def derive_sources(named: DataFrame, owners: DataFrame) -> DataFrame:
    """url, slug (null for publications), source_type, fetch_tier, status, minutes, reliability, requires_js of each row's sources; the first of each address stays.

    owners: file, lineno, slug of the rows that have a company. A cadence is honoured down to the column's floor. A board that a column names is approved, one guessed from the vendor waits.
    """
    rows = named.join(owners.select("file", "lineno", F.col("slug").alias("owner")), ["file", "lineno"], "left").filter(F.col("is_news") | F.col("owner").isNotNull())
    names = {*(c[0] for c in COLUMN_SOURCES), *BOARD_COLUMNS}
    rows = computed(rows, {f"u_{c}": registry_url(F.coalesce(F.col("data")[c], F.lit(""))) for c in sorted(names)})
    d = lambda c: F.col(f"u_{c}")
    found = []
    for place, (column, kind, tier, floor, default, trust) in enumerate(COLUMN_SOURCES, 1):
        minutes = F.when(F.col("minutes").isNull(), default).otherwise(F.greatest(F.col("minutes"), F.lit(floor)))
        wanted = ~F.col("is_news") | F.lit(column in NEWS_COLUMNS)
        js = F.col("requires_js") & F.lit(tier == "static_http")
        found.append(F.when(wanted & (d(column) != ""), _source(place, d(column), F.when(F.col("is_news"), "news_site").otherwise(kind), tier, "approved", minutes, F.coalesce("reliability", F.lit(trust)), js)))
    sure = F.coalesce(*[F.when(B.detect_board(d(c), "fetcher").isNotNull(), d(c)) for c in BOARD_COLUMNS])
    guess = F.concat(lookup(BOARD_OF_VENDOR, F.lower(F.trim(F.coalesce(F.col("data")["ats_used"], F.lit("")))), None), F.get("tokens", F.lit(0)))
    board = F.coalesce(sure, guess)
    found.append(F.when(~F.col("is_news") & board.isNotNull(), _source(0, board, F.lit("ats_api"), "ats_api", F.when(sure.isNotNull(), "approved").otherwise("pending"), F.lit(BOARD_MINUTES), F.lit(1.0), F.lit(False))))
    each = rows.select("file", "lineno", F.when(~F.col("is_news"), F.col("owner")).alias("slug"), F.explode(F.filter(F.array(*found), lambda s: s.isNotNull())).alias("s"))
    rest = F.struct("slug", *[F.col(f"s.{c}").alias(c) for c in ("source_type", "fetch_tier", "status", "minutes", "reliability", "requires_js")])
    return each.groupBy(F.col("s.url").alias("url")).agg(F.min_by(rest, F.struct("file", "lineno", "s.place")).alias("r")).select("url", "r.*")


def _source(place: int, url: Column, kind: Column, tier: str, status: str | Column, minutes: Column, trust: Column, js: Column) -> Column:
    kind, status = (F.lit(x) if isinstance(x, str) else x for x in (kind, status))
    return F.struct(
        F.lit(place).alias("place"), url.alias("url"), kind.alias("source_type"), F.lit(tier).alias("fetch_tier"), status.alias("status"), minutes.cast("long").alias("minutes"),
        trust.cast("double").alias("reliability"), js.alias("requires_js"),
    )


def ingest_summary(named: DataFrame, upserted: DataFrame, sources: DataFrame) -> DataFrame:
    """metric, value: companies inserted, updated and known, sources by type, and company rows without a usable domain."""
    status = upserted.groupBy("status").count().select(F.concat(F.lit("companies_"), "status").alias("metric"), F.col("count").alias("value"))
    kinds = sources.groupBy("source_type").count().select(F.concat(F.lit("sources_"), "source_type").alias("metric"), F.col("count").alias("value"))
    lost = named.agg(F.lit("rows_without_domain").alias("metric"), F.count_if(~F.col("is_news") & ~F.col("is_enrichment") & (F.col("domain") == "")).alias("value"))
    return status.unionByName(kinds).unionByName(lost)
