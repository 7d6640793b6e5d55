"""What models return about pages, made into events, postings and résumés; and when two reports are of one event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.scoring import BASE_WEIGHTS

# Vocabularies, words that mean nothing, caps and floors.
NULLISH = ("", "null", "none", "unknown", "n/a")
EVENT_TYPES = tuple(BASE_WEIGHTS)
ROLE_FAMILIES = (*(name for name, _ in T.ROLE_FAMILIES), "other")
SENIORITIES = tuple(T.LEVEL_YEARS)
WORK_MODES = ("remote", "hybrid", "onsite")
STAGES = ("pre_seed", "seed", "series_a", "series_b", "series_c", "growth", "public", "bootstrapped", "unknown")
LEAST_CONFIDENCE, DEFAULT_CONFIDENCE, MAX_TITLE, MAX_EXCERPT = 0.3, 0.5, 500, 200
MAX_POSTINGS, POSTING_TITLE = 200, (3, 200)
MAX_SKILLS, MAX_PLACES, MAX_YEARS = 60, 10, 60
AMOUNT_TOLERANCE, TITLE_OVERLAP, ROLE_OVERLAP = 0.2, 0.6, 0.5
_EVENT = "struct<event_type string, title string, event_occurred_at string, structured_data string, evidence_excerpt string, confidence string>"


def parse_event_date(text: Column) -> Column:
    """Timestamp of an ISO date or date and time (UTC where it names no zone); null for anything else."""
    t = F.trim(text)
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
    return F.when(t.rlike(shape), F.try_to_timestamp(t))


def conform_enum(col: Column, vocabulary: tuple[str, ...]) -> Column:
    """Trimmed and in lower case; null if it says nothing or is outside the vocabulary."""
    t = F.lower(F.trim(col))
    return F.when(t.isin(*[v for v in vocabulary if v not in NULLISH]), t)


def conform_number(col: Column, least: float, most: float) -> Column:
    """As a double; null if it is none or out of range."""
    n = col.try_cast("double")
    return F.when(n.between(least, most), n)


def explode_model_events(answers: DataFrame, raw: str) -> DataFrame:
    """The caller's columns but ``raw``, and pos and the event's six fields as texts: a row for each object of the list under events, or else data, results or items."""
    kept = [c for c in answers.columns if c != raw]
    # a step for each, and fields out of a generator: the optimiser would put an answer's parsing into every place that reads it
    found = answers.select(*kept, T.model_json(F.col(raw)).alias("__tm_json"))
    names = ("events", "data", "results", "items")
    lists = found.select(*kept, *[F.when(F.col("__tm_json").startswith("{"), F.get_json_object("__tm_json", f"$.{k}")).alias(f"__tm_{k}") for k in names])
    # only an absent or null ``events`` lets the others speak, and of those the first that is a list
    other = F.coalesce(*[F.when(F.col(f"__tm_{k}").startswith("["), F.col(f"__tm_{k}")) for k in names[1:]])
    listed = lists.select(*kept, F.coalesce("__tm_events", other).alias("__tm_list"))
    items = F.when(F.col("__tm_list").startswith("["), F.from_json("__tm_list", "array<string>"))
    event = lambda x, i: F.struct(i.cast("long").alias("pos"), F.trim(x).startswith("{").alias("__tm_is"), F.from_json(x, _EVENT[len("struct<") : -1]).alias("__tm_e"))
    return listed.select(*kept, F.inline_outer(F.transform(items, event))).filter("__tm_is").select(*kept, "pos", "__tm_e.*")


def validate_extracted(events: DataFrame) -> DataFrame:
    """Events with a known type, a title of 1 to 500 characters and a confidence of 0.3 to 1 (0.5 if absent); each bad one goes alone.

    An unreadable date is null, the excerpt is trimmed and cut at 200 characters.
    """
    kind = conform_enum(F.col("event_type"), EVENT_TYPES)
    confidence = F.when(F.col("confidence").isNull(), F.lit(DEFAULT_CONFIDENCE)).otherwise(F.col("confidence").try_cast("double"))
    rows = events.withColumn("event_type", kind).withColumn("confidence", confidence)
    rows = rows.filter(F.col("event_type").isNotNull() & F.length("title").between(1, MAX_TITLE) & F.col("confidence").between(LEAST_CONFIDENCE, 1.0))
    excerpt = F.substring(F.trim(F.coalesce("evidence_excerpt", F.lit(""))), 1, MAX_EXCERPT)
    return rows.withColumn("event_occurred_at", parse_event_date(F.col("event_occurred_at"))).withColumn("evidence_excerpt", excerpt)


def _squeezed(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, r"(?U)\s+", " "), r"^ | $", "")


def normalize_career_jobs(pages: DataFrame, jobs: str = "jobs", page_url: str = "page_url") -> DataFrame:
    """external_id, title, location_raw, application_url and the caller's other columns: of a page's first 200 roles those with a fit title, one for each id.

    jobs: array<struct<title, location, url>>. A url that is no address goes, and the page's own stands in.
    """
    kept = [c for c in pages.columns if c not in (jobs, page_url)]
    rows = pages.select(*kept, F.col(page_url).alias("__tm_page"), F.posexplode(F.slice(jobs, 1, MAX_POSTINGS)).alias("__tm_pos", "__tm_job")).filter(F.col("__tm_job").isNotNull())
    url = F.when(F.lower(F.col("__tm_job.url")).rlike("^https?://"), F.col("__tm_job.url"))
    rows = rows.select(*kept, "__tm_page", "__tm_pos", _squeezed(F.col("__tm_job.title")).alias("title"), _squeezed(F.col("__tm_job.location")).alias("location_raw"), url.alias("__tm_url"))
    rows = rows.filter(F.length("title").between(*POSTING_TITLE)).withColumn("external_id", T.synthetic_external_id(F.col("title"), F.col("location_raw"), F.col("__tm_url")))
    rest = F.struct("title", "location_raw", F.coalesce("__tm_url", "__tm_page").alias("application_url"))
    return rows.groupBy(*kept, "external_id").agg(F.min_by(rest, "__tm_pos").alias("r")).select(*kept, "external_id", "r.*")


def conform_resume(parsed: DataFrame) -> DataFrame:
    """Every field mended on its own: lists cleaned and cut, vocabularies kept, years of 0 to 60."""
    known = F.filter(T.clean_str_list(F.col("role_families")), lambda r: F.lower(r).isin(*ROLE_FAMILIES))
    mended = {
        "skills": T.clean_str_list(F.col("skills"), MAX_SKILLS),
        "role_families": known,
        "seniority": conform_enum(F.col("seniority"), SENIORITIES),
        "experience_years": conform_number(F.col("experience_years"), 0, MAX_YEARS),
        "locations": T.clean_str_list(F.col("locations"), MAX_PLACES),
        "work_mode_preference": conform_enum(F.col("work_mode_preference"), WORK_MODES),
    }
    return parsed.withColumns(mended)


def conform_company(companies: DataFrame) -> DataFrame:
    """Stage from its vocabulary, headcount of 0 or more, founded 1800 to 2100, slug of its pattern; null otherwise."""
    mended = {
        "stage": F.when(F.col("stage").isin(*STAGES), F.col("stage")),
        "headcount_estimate": conform_number(F.col("headcount_estimate"), 0, 2**31 - 1).cast("long"),
        "founded_year": conform_number(F.col("founded_year"), 1800, 2100).cast("long"),
        "slug": F.when(F.col("slug").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), F.col("slug")),
    }
    return companies.withColumns({k: v for k, v in mended.items() if k in companies.columns})


def posting_signals(summary: DataFrame, companies: DataFrame, now: Column, *, scraped: bool = False) -> DataFrame:
    """An event for each board with new postings: company_id, event_type, title, observed_at, source_url, new_postings, confidence.

    summary: company_id, source_url, n_new. A vendor's count is sure, a scraped one less so.
    """
    rows = summary.filter("n_new > 0").join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("__tm_name")), "company_id")
    title = F.concat(F.col("__tm_name"), F.lit(" listed " if scraped else " posted "), F.col("n_new").cast("string"), F.lit(" new roles"))
    return rows.select(
        "company_id", F.lit("career_page_update").alias("event_type"), title.alias("title"), now.alias("observed_at"), "source_url",
        F.col("n_new").alias("new_postings"), F.lit(0.8 if scraped else 1.0).alias("confidence"),
    )


FACTS = ("round", "amount_usd", "person", "role", "city", "target")


def _norm(col: Column) -> Column:
    return F.lower(F.trim(F.coalesce(col.cast("string"), F.lit(""))))


def facts(reports: DataFrame) -> list[Column]:
    """What decides whether two reports are of one event, as columns f_tokens, f_round, f_amount, f_person, f_role (tokens), f_city, f_target; absent columns count as null."""
    of = {c: F.col(c) if c in reports.columns else F.lit(None).cast("string") for c in FACTS}
    title = F.col("title") if "title" in reports.columns else F.lit("")
    return [
        T.title_tokens(F.coalesce(title, F.lit(""))).alias("f_tokens"), _norm(of["round"]).alias("f_round"), of["amount_usd"].try_cast("double").alias("f_amount"),
        _norm(of["person"]).alias("f_person"), T.title_tokens(_norm(of["role"])).alias("f_role"), _norm(of["city"]).alias("f_city"), _norm(of["target"]).alias("f_target"),
    ]


FACT_COLUMNS = ("f_tokens", "f_round", "f_amount", "f_person", "f_role", "f_city", "f_target")


def _overlap(a: Column, b: Column) -> Column:
    return F.when(F.least(F.size(a), F.size(b)) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def amounts_match(a: Column, b: Column) -> Column:
    """Whether two amounts may be of one round: one is absent, no number or not positive, or they differ by a fifth of the larger at most."""
    x, y = a.try_cast("double"), b.try_cast("double")
    known = x.isNotNull() & y.isNotNull() & (F.least(x, y) > 0)
    return F.when(known, F.abs(x - y) / F.greatest(x, y) <= AMOUNT_TOLERANCE).otherwise(True)


def same_event(kind: Column, a: str, b: str) -> Column:
    """Whether the reports whose ``facts`` stand in structs a and b, both of type ``kind``, are of one event."""
    x, y = (lambda c: F.col(f"{a}.f_{c}")), (lambda c: F.col(f"{b}.f_{c}"))
    role = (F.size(x("role")) == 0) | (F.size(y("role")) == 0) | (_overlap(x("role"), y("role")) > ROLE_OVERLAP)
    return (
        F.when(kind == "funding", (x("round") == y("round")) & amounts_match(x("amount"), y("amount")))
        .when(kind == "leadership_change", (x("person") != "") & (x("person") == y("person")) & role)
        .when(kind == "new_office", (x("city") != "") & (x("city") == y("city"))).when(kind == "acquisition", (x("target") != "") & (x("target") == y("target")))
        .otherwise(_overlap(x("tokens"), y("tokens")) > TITLE_OVERLAP)
    )


def same_facts(kind: str, a: tuple, b: tuple, overlap: float = TITLE_OVERLAP) -> bool:
    """``same_event`` for two rows of FACT_COLUMNS inside a task; tokens as sets."""
    share = lambda s, t: len(s & t) / max(len(s), len(t)) if s and t else 0.0
    if kind == "funding":
        x, y = a[2], b[2]
        known = x is not None and y is not None and x == x and y == y and min(x, y) > 0
        return a[1] == b[1] and (not known or abs(x - y) / max(x, y) <= AMOUNT_TOLERANCE)
    if kind == "leadership_change":
        return a[3] != "" and a[3] == b[3] and (not a[4] or not b[4] or share(a[4], b[4]) > ROLE_OVERLAP)
    if kind in ("new_office", "acquisition"):
        at = 5 if kind == "new_office" else 6
        return a[at] != "" and a[at] == b[at]
    return share(a[0], b[0]) > overlap
