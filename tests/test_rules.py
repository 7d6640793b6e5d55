"""Rules on small inputs: same events, dates, slugs, boards, quotas, stems, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import boards as B
from tidemark.functions import text as T
from tidemark.operators import digest as D
from tidemark.operators import extraction as E
from tidemark.operators import matching as M
from tidemark.operators import registry as G

PAIRS = [
    ("funding", {"round": "series_f", "amount_usd": "75000000"}, {"round": "Series_F ", "amount_usd": "80000000"}, True),
    ("funding", {"round": "series_f", "amount_usd": "75000000"}, {"round": "series_f", "amount_usd": "200000000"}, False),
    ("funding", {"round": "series_a"}, {"round": "series_b"}, False),
    ("funding", {"amount_usd": "undisclosed"}, {"amount_usd": "5"}, True),
    ("leadership_change", {"person": "A B", "role": "VP of Engineering"}, {"person": "a b", "role": "VP Engineering"}, True),
    ("leadership_change", {"person": "A B", "role": "CFO"}, {"person": "a b", "role": "VP Engineering"}, False),
    ("leadership_change", {}, {}, False),
    ("new_office", {"city": "Pune"}, {"city": " pune"}, True),
    ("acquisition", {"target": "X"}, {"target": "Y"}, False),
    ("partnership", {"title": "Acme partners with Globex on cloud"}, {"title": "Acme partners Globex on the cloud"}, True),
    ("partnership", {"title": "Acme partners with Globex"}, {"title": "Initech ships a printer"}, False),
]


def test_same_event(spark):
    fields = ["title", *E.FACTS]
    rows = [(i, side, *[x.get(f) for f in fields]) for i, (_, a, b, _) in enumerate(PAIRS) for side, x in ((0, a), (1, b))]
    df = spark.createDataFrame(rows, "i int, side int, " + ", ".join(f"{f} string" for f in fields))
    facts = df.select("i", "side", F.struct(*E.facts(df)).alias("f"))
    both = facts.filter("side = 0").select("i", F.col("f").alias("a")).join(facts.filter("side = 1").select("i", F.col("f").alias("b")), "i").join(spark.createDataFrame([(i, p[0]) for i, p in enumerate(PAIRS)], "i int, kind string"), "i")
    got = {r.i: r for r in both.select("i", "a", "b", E.same_event(F.col("kind"), "a", "b").alias("same")).collect()}
    assert [got[i].same for i in range(len(PAIRS))] == [p[3] for p in PAIRS]
    assert [E.same_facts(p[0], M.as_facts(got[i].a), M.as_facts(got[i].b)) for i, p in enumerate(PAIRS)] == [p[3] for p in PAIRS]


@pytest.mark.parametrize(("text", "want"), [("2024-01-05", "2024-01-05 00:00:00"), ("2024-01-05T10:00:00+02:00", "2024-01-05 08:00:00"), (" 2024-01-05 10:00 ", "2024-01-05 10:00:00"), ("null", None), ("5 May", None), ("2024-13-01", None), (None, None)])
def test_dates(spark, text, want):
    assert spark.range(1).select(F.date_format(E.parse_event_date(F.lit(text).cast("string")), "yyyy-MM-dd HH:mm:ss")).first()[0] == want


def test_model_answers_with_other_shapes(spark):
    raw = ['{"events": []}', '{"data": [{"title": "a"}]}', '{"events": null, "results": [{"title": "b"}, 3, {"title": "c"}]}', '{"events": 1, "data": [{"title": "d"}]}', "[1]", None, '{"data": 1, "items": [{"title": "e"}]}']
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    assert sorted((r.i, r.title) for r in E.explode_model_events(df, "raw").collect()) == [(1, "a"), (2, "b"), (2, "c"), (6, "e")]


def test_model_answers_are_read_once(spark):
    """Parsing is not repeated wherever its result is used."""
    df = spark.createDataFrame([(1, '{"events": [{"title": "a"}]}')], "i int, raw string")
    plan = E.validate_extracted(E.explode_model_events(df, "raw"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") <= 2 and plan.count("from_json") <= 2, plan


def test_resolving_holds_shares(spark):
    """Neither side is broadcast, nor gathered before its spellings are dealt out."""
    rows = spark.createDataFrame([(i, f"C {i}", f"c-{i}", f" c {i} ") for i in range(40)], "id long, name string, slug string, m string")
    got = M.resolve_entities(rows.select("id", "m"), rows.select("id", "name", "slug"), "m")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
    dealt = plan.split("REPARTITION_BY_NUM")
    assert len(dealt) == 3 and "HashAggregate" not in dealt[2], plan
    assert all(r.id == r.company_id for r in got.collect())


def test_career_jobs(spark):
    jobs = [("  Data   Engineer ", " Pune  City ", "https://x/1"), ("data engineer", "pune city", "HTTPS://X/2"), ("All", None, "Data"), ("ab", None, None), (None, None, None), ("x" * 201, None, None), ("All", "", "again")]
    df = spark.createDataFrame([(1, jobs, "https://page")], "company_id long, jobs array<struct<title string, location string, url string>>, page_url string")
    got = {(r.title, r.location_raw, r.application_url) for r in E.normalize_career_jobs(df).collect()}
    assert got == {("Data Engineer", "Pune City", "https://x/1"), ("data engineer", "pune city", "HTTPS://X/2"), ("All", None, "https://page")}


def test_registry_cells(spark):
    urls = {"inc42.com/feed": "https://inc42.com/feed", "sebi.gov.in (unsure)": "", "N/A": "", "**https://a.b**": "https://a.b", "word": "", None: ""}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.x for r in df.select("u", G.registry_url(F.col("u")).alias("x")).collect()} == urls
    names = {"Zomato (Eternal)": ["Eternal", "Zomato"], "API Holdings (PharmEasy)": ["PharmEasy", "API Holdings"], "NVIDIA (AI infra)": ["NVIDIA"], "Peak XV (formerly Matrix Partners India)": ["Matrix Partners India", "Peak XV"], "A / Beta Co": ["Beta Co"]}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.a for r in df.select("n", G.name_aliases(F.col("n"), F.lit("vcs")).alias("a")).collect()} == names
    one = spark.createDataFrame([("f", "## github_orgs\n| GitHub Org | GitHub URL | Parent company |\n|-|-|-|\n| acme | github.com/acme | Acme |\n## tech_news.txt *(x)*\n| Name |\n| A |\n| |\n")], "file string, text string")
    rows = [(r.lineno, r.section, r.data) for r in G.registry_rows(one).orderBy("lineno").collect()]
    assert rows == [(4, "github_orgs", {"_github_organization": "acme", "github_organization": "github.com/acme", "name": "Acme"}), (7, "tech_news", {"name": "A"})]
    assert G.registry_rows(one.limit(0)).count() == 0


def test_lists_of_any_length(spark):
    """Aliases and families are kept however many there are; a cap cuts only where one is given."""
    many = [f"Name {i}" for i in range(1200)]
    df = spark.createDataFrame([("Acme (" + ", ".join(many) + ")", many, [*many, "name 3", " "], ["data"] * 3 + many + ["Legal"])], "n string, a array<string>, b array<string>, role_families array<string>")
    one = df.select(G.name_aliases(F.col("n"), F.lit("vcs")).alias("names"), G.merge_aliases(F.col("a"), F.col("b")).alias("merged"), T.clean_str_list(F.col("a"), 5).alias("cut")).first()
    assert one.names == [*many, "Acme"] and one.merged == many and one.cut == many[:5]
    rest = {c: F.lit(None).cast("array<string>" if c in ("skills", "locations") else "string") for c in ("skills", "seniority", "experience_years", "locations", "work_mode_preference")}
    assert E.conform_resume(df.select("role_families").withColumns(rest)).first().role_families == ["data", "Legal"]


def test_tiers_and_slugs(spark):
    want = {"https://x/feed": "rss", "gnews://q": "news_api", "https://jobs.lever.co/a": "ats_api", "https://apply.workable.com/a": "static_http", "https://x": "static_http"}
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.t for r in df.select("u", B.detect_fetch_tier(F.col("u"), F.lit(None).cast("string")).alias("t")).collect()} == want
    names = [("Crème Brûlée!", "creme-brulee"), ("日本", "company"), (None, None), ("A  b", "a-b")]
    assert [tuple(r) for r in spark.createDataFrame([(n,) for n, _ in names], "n string").select("n", T.slugify(F.col("n"), fold=True)).collect()] == names


def test_stems_and_empty_search(spark):
    words = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "filing": "file", "sky": "sky", "controll": "control", "engineering": "engin", "adjustable": "adjust"}
    assert {w: M.stem(w) for w in words} == words
    docs = spark.createDataFrame([(1, "Engineers hired"), (2, None), (3, "engine hire")], "doc_id long, text string")
    assert {r.doc_id for r in M.text_search(docs, "the engineering hires").collect()} == {1, 3} and M.text_search(docs, "the of").count() == 0 and M.text_search(docs.limit(0), "x").count() == 0


def test_send_cap_spent(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "id long")
    assert {r.id for r in D.apply_send_cap(df, ["id"], 3, 1).filter("sent").collect()} == {0, 1} and D.apply_send_cap(df, ["id"], 3, 9).filter("sent").count() == 0


def test_vectors_of_no_length(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 0.0], "a"), (3, None, "a"), (4, [1.0, 0.0], "none")], "query_id long, q array<double>, label string")
    i = spark.createDataFrame([(5, [1.0, 0.0], "a"), (4, [2.0, 0.0], "a"), (6, [0.0, 0.0], "a"), (7, None, "a"), (8, [-1.0, 0.0], "a")], "item_id long, v array<double>, label string")
    assert [(r.query_id, r.item_id) for r in M.vector_topk(q, i, 2).orderBy("place").collect()] == [(1, 4), (1, 5)]
    assert M.vector_topk(q, i, 9, None).count() == 3
