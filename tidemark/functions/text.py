"""Column functions on text, URLs and titles."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What makes a text relevant or not, in the order of the rules.
EXCLUDE = ("happy diwali", "merry christmas", "season's greetings", "happy holi", "eid mubarak", "happy new year", "happy independence day", "happy pongal", "employee of the month", "meet our team", "day in the life", "team outing", "company picnic", "annual day", "women's day celebration", "limited time offer", "discount code", "sale ends", "coupon", "promo code", "subscribe to our channel", "use code", "cookie policy", "privacy policy", "terms of service", "terms and conditions")
INCLUDE = ("hiring", "we're hiring", "we are hiring", "join us", "open position", "job opening", "now hiring", "career opportunit", "funding", "raised", "series a", "series b", "series c", "series d", "seed round", "valuation", "investment", "office", "expansion", "expanding", "new facility", "launch", "acquired", "acquisition", "merger", "partnership", "engineer", "team growth", "headcount", "grew the team", "vp of", "cto", "ceo", "cfo", "leadership", "appointed", "joins as", "infrastructure", "data center", "datacenter", "cloud migration", "layoff", "restructur", "downsiz")
MARKUP = "<>/{}[]"
STOPWORDS = ("a", "an", "the", "in", "on", "at", "to", "for", "of", "and", "or", "its", "as", "with", "from", "by", "is", "are", "was", "were", "has", "have", "new", "million", "billion", "crore", "usd", "inr")
SUFFIXES = ("co.in", "co.uk", "com.au", "co.jp", "co.nz", "com.br", "com.sg", "co.za", "com.mx", "co.kr", "com.tr", "org.uk", "net.in", "org.in", "ac.in", "gov.in", "com.cn", "co.il")
SENIORITY = (("c_level", ("cto", "ceo", "cfo", "coo", "cmo", "chief")), ("vp", ("vp", "vice president", "svp", "evp")), ("director", ("director",)), ("principal", ("principal", "distinguished", "fellow")), ("staff", ("staff",)), ("intern", ("intern", "trainee", "apprentice", "co-op", "graduate trainee")), ("junior", ("junior", "jr", "jr.", "entry level", "fresher")), ("senior", ("senior", "sr", "sr.", "lead", "tech lead")))
WORK_MODES = (("remote", ("fully remote", "100% remote", "work from anywhere", "remote-first", "remote first", "wfh", "work from home")), ("hybrid", ("hybrid", "2 days in office", "3 days in office", "flexible working")), ("onsite", ("onsite", "on-site", "in-office", "office-based", "in office", "work from office")))
ROLE_FAMILIES = (
    ("data", ("data scientist", "data engineer", "data analyst", "machine learning", "ml engineer", "ai engineer", "analytics", "bi analyst", "data science", "deep learning", "nlp engineer")),
    ("devops", ("devops", "sre", "site reliability", "infrastructure engineer", "cloud engineer", "platform engineer", "reliability engineer")),
    ("design", ("designer", "design", "ux", "ui", "user experience", "user interface", "creative director")),
    ("product", ("product manager", "program manager", "product owner", "tpm", "technical program", "product analyst", "product")),
    ("engineering", ("engineer", "engineering", "developer", "development", "swe", "sde", "architect", "backend", "back-end", "frontend", "front-end", "fullstack", "full-stack", "full stack", "embedded", "firmware", "qa", "test engineer", "automation", "programmer", "technology", "technical")),
    ("marketing", ("marketing", "growth", "content", "brand", "seo", "social media", "communications", "copywriter")),
    ("sales", ("sales", "account executive", "business development", "bdr", "sdr", "partnerships", "account manager")),
    ("hr", ("recruiter", "recruiting", "recruitment", "people", "talent", "human resource", "hr")),
    ("finance", ("finance", "financial", "accounting", "accountant", "controller", "treasury", "fp&a")),
    ("legal", ("legal", "counsel", "compliance", "regulatory")),
    ("operations", ("operations", "operation", "supply chain", "logistics", "procurement", "ops")),
)


def markup_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.translate(text, MARKUP, ""))) / n).otherwise(0.0)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Stripped, with runs of white space as one space."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def bound(col: Column, body) -> Column:
    """``body`` of a column that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(col), body), F.lit(0))


def holds_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text holds one of the literals, by byte search; one that holds another needs no search of its own."""
    parts = tuple(p for p in parts if not any(q != p and q in p for q in parts))
    out = text.contains(parts[0])
    for p in parts[1:]:
        out = out | text.contains(p)
    return out


def prefilter(text: Column, source_type: Column) -> Column:
    """Why a text passes or not: always, short, markup, include, exclude or unmatched."""

    def judged(t: Column) -> Column:
        return (
            F.when(F.length(t) < 100, "short").when(markup_ratio(t) > 0.3, "markup")
            .when(holds_any(t, INCLUDE), "include").when(holds_any(t, EXCLUDE), "exclude").otherwise("unmatched")
        )

    return F.when(source_type.isin("career_page", "ats_api"), "always").otherwise(bound(F.lower(strip(F.coalesce(text, F.lit("")))), judged))


def passes(reason: Column) -> Column:
    return reason.isin("always", "include", "unmatched")


def compile_rule(words: tuple[str, ...]) -> str:
    """A pattern with word bounds only where a keyword begins or ends with a letter or digit."""
    return "(?U)" + "|".join((r"\b" if w[0].isalnum() else "") + re.escape(w) + (r"\b" if w[-1].isalnum() else "") for w in words)


def first_rule(col: Column, rules: tuple, otherwise: Column) -> Column:
    out = F.when(F.coalesce(F.trim(col), F.lit("")) == "", None)
    for name, words in rules:
        out = out.when(F.lower(col).rlike(compile_rule(words)), name)
    return out.otherwise(otherwise)


def role_family(title: Column) -> Column:
    return first_rule(title, ROLE_FAMILIES, F.lit("other"))


def seniority(title: Column) -> Column:
    return first_rule(title, SENIORITY, F.lit("mid"))


def work_mode(description: Column, location: Column) -> Column:
    return first_rule(F.concat_ws(" ", description, location), WORK_MODES, F.lit(None).cast("string"))


def title_tokens(title: Column) -> Column:
    parts = F.split(F.lower(F.regexp_replace(title, r"(?U)[^\p{Alnum}\s]", " ")), r"(?U)\s+")
    return F.array_except(F.array_distinct(parts), F.array(*[F.lit(w) for w in ("", *STOPWORDS)]))


def title_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set's size; 0 if either is empty."""
    x, y = title_tokens(a), title_tokens(b)
    most = F.greatest(F.size(x), F.size(y))
    return F.when(F.least(F.size(x), F.size(y)) == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / most)


def content_hash(text: Column, normalised: bool = False) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.sha2(squeeze(F.lower(t)) if normalised else t, 256)


def normalize_domain(url: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[/?#:].*$", ""), r"\.+$", ""), r"^www\.", "")


def registrable_domain(url: Column) -> Column:
    labels = F.split(normalize_domain(url), r"\.")
    n = F.size(labels)
    last = F.concat_ws(".", F.slice(labels, -2, 2))
    return F.when(F.coalesce(normalize_domain(url), F.lit("")) == "", "unknown").when(n <= 2, F.concat_ws(".", labels)).when(last.isin(*SUFFIXES), F.concat_ws(".", F.slice(labels, -3, 3))).otherwise(last)


@F.pandas_udf(StringType())
def fold_ascii(text: pd.Series) -> pd.Series:
    """Compatibility decomposition with all that is not ASCII dropped."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def slugify(name: Column, fold: bool = False) -> Column:
    """For names in ASCII; ``fold`` takes others through ``fold_ascii`` first, which costs a pass through Python."""
    name = fold_ascii(name) if fold else name
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "company").otherwise(s)


def synthetic_external_id(title: Column, location: Column, url: Column) -> Column:
    same = F.concat_ws("|", *[squeeze(F.lower(F.coalesce(c, F.lit("")))) for c in (title, location)])
    return F.concat(F.lit("cp_"), F.substring(F.sha2(F.when(F.length(url) > 0, url).otherwise(same), 256), 1, 20))


def embedding_text(*cols: Column, most: int = 8000) -> Column:
    parts = F.filter(F.array(*cols), lambda c: F.length(F.trim(c)) > 0)
    return F.substring(F.regexp_replace(F.trim(F.concat_ws(" ", parts)), r"(?U)\s+", " "), 1, most)


def job_embedding_text(title: Column, department: Column, family: Column, description: Column) -> Column:
    return embedding_text(title, department, family, F.substring(description, 1, 500))


def resume_embedding_text(skills: Column, families: Column, seniority: Column, locations: Column) -> Column:
    return embedding_text(F.array_join(skills, " "), F.array_join(families, " "), seniority, F.array_join(locations, " "))


def article_text(*cols: Column) -> Column:
    """The parts that are not empty, by a blank line."""
    return F.array_join(F.filter(F.array(*cols), lambda c: F.length(c) > 0), "\n\n")


def entry_text(title: Column, body: Column) -> Column:
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))))


def is_unreadable(text: Column) -> Column:
    """Whether a document's normalised text is too short to be one."""
    return F.length(normalize_document_text(text)) < 50


def clean_str_list(col: Column, cap: int | None = None) -> Column:
    """Trimmed, without blanks, the first of each spelling letter case aside, at most cap where one is given."""
    trimmed = F.filter(F.transform(col, lambda x: strip(x)), lambda x: x != "")
    first = lambda t: bound(F.transform(t, F.lower), lambda low: F.filter(t, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))
    kept = bound(trimmed, first)
    return kept if cap is None else F.slice(kept, 1, cap)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def unit_normalize(v: Column) -> Column:
    """Divided by its length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def normalize_document_text(text: Column) -> Column:
    """Line ends as ``\\n``, runs of spaces and tabs as one space, lines stripped, one blank line at most in a row."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "[ \\t\u00a0]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, " ?\n ?", "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def _model_variant(raw: Column) -> Column:
    bare = F.trim(F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*\z", "$1"))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0)))


def parse_model_json(raw: Column) -> Column:
    """The JSON object in a model's answer as a variant: without code fences, or else between the outermost braces; null for anything else."""
    found = _model_variant(raw)
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def model_json(raw: Column) -> Column:
    """As ``parse_model_json``, as compact JSON, which begins with a brace if it is an object, and read once."""
    return F.to_json(_model_variant(raw))


# Years of experience that fit a level.
LEVEL_YEARS = {"intern": (0, 1), "junior": (0, 2), "mid": (2, 5), "senior": (5, 9), "staff": (8, 14), "principal": (10, 20), "director": (10, 25), "vp": (12, 30), "c_level": (15, 40)}


def explain_match(r: dict[str, Column], j: dict[str, Column], similarity: Column) -> Column:
    """Reasons for a match, in order; the similarity if there is none.

    r: skills, role_families, seniority, years, locations, work_mode of the résumé; j: skills, role_family, seniority, location, work_mode of the job.
    """
    low = lambda col: F.filter(F.transform(col, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    wanted = low(j["skills"])
    shared = F.filter(r["skills"], lambda s: (F.trim(s) != "") & F.array_contains(wanted, F.lower(F.trim(s))))
    n, more = F.size(shared), F.size(shared) - 4
    skills = F.concat(F.lit("You have "), n.cast("string"), F.when(n == 1, " matching skill: ").otherwise(" matching skills: "), F.array_join(F.slice(shared, 1, 4), ", "), F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(""))
    fits = F.lit(False)
    for name, (least, most) in LEVEL_YEARS.items():
        fits = fits | ((j["seniority"] == name) & r["years"].between(least, most))
    fits = fits | (~j["seniority"].isin(*LEVEL_YEARS) & r["years"].between(0, 100))
    years = F.when(r["years"] == F.floor(r["years"]), F.floor(r["years"]).cast("string")).otherwise(r["years"].cast("string"))
    label = F.initcap(F.replace(j["seniority"], F.lit("_"), F.lit(" ")))
    level = F.when(F.coalesce(j["seniority"] == r["seniority"], F.lit(False)), F.concat(label, F.lit(" level matches your profile"))).when(
        (F.length(j["seniority"]) > 0) & fits, F.concat(label, F.lit(" level matches your "), years, F.when(r["years"] == 1, " year").otherwise(" years"), F.lit(" of experience"))
    )
    place = F.trim(j["location"])
    reasons = F.filter(
        F.array(
            F.when(n > 0, skills),
            F.when((F.length(j["role_family"]) > 0) & F.array_contains(low(r["role_families"]), j["role_family"]), F.concat(F.lit("This "), j["role_family"], F.lit(" role matches your experience"))),
            level,
            F.when((place != "") & F.exists(low(r["locations"]), lambda x: F.lower(place).contains(x)), F.concat(F.lit("This role is in "), place, F.lit(", where you're based"))),
            F.when((F.length(j["work_mode"]) > 0) & (j["work_mode"] == r["work_mode"]), F.concat(F.initcap(j["work_mode"]), F.lit(" work matches your preference"))),
        ),
        lambda x: x.isNotNull(),
    )
    fallback = F.array(F.concat(F.lit("Your profile is a "), F.bround(similarity * 100).cast("long").cast("string"), F.lit("% semantic match for this role")))
    return F.when(F.size(reasons) > 0, reasons).otherwise(fallback)
