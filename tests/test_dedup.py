"""Event dedup against a search of all earlier leaders."""

import random

from pyspark.sql import functions as F

from tidemark.operators import dedup as D
from tidemark.operators import extraction as E

SCHEMA = "id long, company_id long, event_type string, title string, s long, round string, amount_usd string, person string, role string, city string, target string"
DAY = 86_400


def reports(seed, n, companies=2, days=120):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    titles = ["raised series b round", "raised series b round today", "opens office pune campus", "opens office delhi campus", "campus opens", "", None, "pune office opens campus wide"]
    return [
        (
            i, pick(*range(companies), None), pick("funding", "leadership_change", "new_office", "acquisition", "partnership", "award", None), pick(*titles), rng.randrange(days * DAY), pick("Series A", "series a", "Series B", None),
            pick("100", "110", "300", None, "x"), pick("Ann Lee", "ann lee", "Bo", "", None), pick("VP of Engineering", "VP Engineering", "Designer", None), pick("Pune", "Delhi", "", None), pick("Acme", "acme", None),
        )
        for i in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("observed_at", F.timestamp_seconds("s")).drop("s")


def brute(spark, df, days=14):
    """Facts come from the library's columns; the order and the search are plain."""
    rows = df.select("id", "company_id", "event_type", F.unix_seconds("observed_at").alias("s"), *E.facts(df)).orderBy("id").collect()
    leaders, out = [], {}
    for r in rows:
        own = D.as_facts(tuple(r[c] for c in E.FACT_COLUMNS))
        hit = next((j for j, c, k, s, f in leaders if c == r.company_id and k == r.event_type and abs(s - r.s) <= days * DAY and E.same_facts(k or "", own, f)), r.id)
        out[r.id] = hit
        if hit == r.id:
            leaders.append((r.id, r.company_id, r.event_type, r.s, own))
    return out


def test_arrival_order_and_facts(spark):
    df = frame(spark, reports(1, 700))
    got = {r.id: r.canonical_id for r in D.dedup_events(df.repartition(5)).collect()}
    want = brute(spark, df)
    assert got == want and 100 < len(set(want.values())) < 600


def test_busy_company_splits(spark):
    """One company of one type without a gap is as many chains as it has topics."""
    rows = [(i, 1, "acquisition", None, i * 3600, None, None, None, None, None, f"target {i % 40}") for i in range(1200)]
    df = frame(spark, rows)
    got = {r.id: r.canonical_id for r in D.dedup_events(df).collect()}
    assert got == brute(spark, df)
    cut = D.chains(df.select("id", F.lit("x").alias("scope"), F.col("target").alias("topic"), F.unix_micros("observed_at").alias("t")), ["scope", "topic"], "t", 14 * D.DAY)
    assert cut.select("topic", "chain").distinct().count() == 40


def test_chains_cut_at_gaps_only(spark):
    times = [0, 10, 24, 39, 53, 80, 81, 94, 200, 214, 229]
    df = spark.createDataFrame([(t,) for t in times], "t long").withColumn("k", F.lit("x"))
    got = {r.t: r.chain for r in D.chains(df, ["k"], "t", 14).collect()}
    want, chain = {}, 0
    for a, b in zip([0, *times], times, strict=False):
        chain += b - a > 14
        want[b] = chain
    assert len(set(got.values())) == len(set(want.values())) and all((got[a] == got[b]) == (want[a] == want[b]) for a in times for b in times)


def test_title_topics_keep_all_overlaps(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(14)]
    titles = sorted({" ".join(sorted(rng.sample(words, rng.randint(1, 6)))) for _ in range(90)})
    df = spark.createDataFrame([("s", t) for t in titles], "scope string, sig string")
    topic = {r.sig: r.topic for r in D.title_topics(df).collect()}
    assert set(topic) == set(titles)
    for a in titles:
        for b in titles:
            x, y = set(a.split()), set(b.split())
            if len(x & y) / max(len(x), len(y)) > E.TITLE_OVERLAP:
                assert topic[a] == topic[b]
    far = spark.createDataFrame([("s", "a b"), ("s", "c d"), ("t", "a b")], "scope string, sig string")
    assert len({r.topic for r in D.title_topics(far).collect()}) == 3


def test_order_and_empty(spark):
    rows = [(5, 1, "new_office", None, 0, None, None, None, None, "pune", None), (2, 1, "new_office", None, 10, None, None, None, None, "pune", None)]
    df = frame(spark, rows).withColumn("batch", F.when(F.col("id") == 5, 0).otherwise(1))
    assert {r.id: r.canonical_id for r in D.dedup_events(df, order=("batch", "id")).collect()} == {5: 5, 2: 5}
    assert D.dedup_events(df.limit(0)).collect() == []


def test_reports_are_read_once(spark):
    df, read = frame(spark, reports(4, 300)), spark.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    assert {r.id: r.canonical_id for r in D.dedup_events(df.mapInPandas(run, df.schema)).collect()} == brute(spark, df) and read.value == 300
