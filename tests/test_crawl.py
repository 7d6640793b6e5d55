"""The incremental crawl against the batch operators over all rows."""

import random

from pyspark.sql import functions as F

from tidemark.operators import crawl as W
from tidemark.operators import dedup as D
from tidemark.operators import matching as J

TEXT = " has news about hiring engineers, an office in a city far away, and it raised a round of funding as well, the company said."
FETCH = "source_id long, company_id long, source_type string, s long, url string, text string"
NAMES = [(7, "Razorpay", None), (8, "Zomato", None), (9, "Groww", None)]


def fetches(spark, rows):
    df = spark.createDataFrame(rows, FETCH)
    return df.select("source_id", "company_id", "source_type", F.timestamp_seconds("s").alias("fetched_at"), "url", "text")


def events_of(docs):
    """A document is one event: kind and place stand in its text."""
    return docs.select(
        F.xxhash64("source_id", "fetched_at").alias("event_id"), F.split("text", "\n")[0].alias("title"), F.lit("").alias("context"), "company_id", F.regexp_extract("text", "kind=(\\w+)", 1).alias("event_type"),
        F.col("fetched_at").alias("observed_at"), F.col("url").alias("source_url"), F.regexp_extract("text", "city=(\\w+)", 1).alias("city"), F.regexp_extract("text", "round=(\\w+)", 1).alias("round"),
    )


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(["Razorpay", "Zomato", "Groww", "Nobody"])
        kind, city, round_ = rng.choice(["new_office", "funding", "partnership"]), rng.choice(["pune", "delhi"]), rng.choice(["a", "b"])
        company = rng.choice([None, None, 7, 8])
        url = rng.choice([f"https://techcrunch.com/{i % 5}", "https://blog.example.com/x", None])
        rows.append((i % 30, company, "news_site", 1_700_000_000 + i * 30_000, url, f"{name} news\nkind={kind} city={city} round={round_}" + TEXT))
    return rows


def test_three_batches_one_replayed(spark, tmp_path):
    rows = made(150, 1)
    companies = spark.createDataFrame(NAMES, "id long, name string, aliases array<string>")
    store, as_of = str(tmp_path / "store"), F.lit("2024-02-01").cast("timestamp")
    cuts = [rows[:60], rows[60:100], rows[100:]]
    for number, part in enumerate(cuts):
        W.crawl_batch(fetches(spark, part).repartition(3), number, store, events_of, companies, as_of)
        if number == 1:
            W.crawl_batch(fetches(spark, part).repartition(2), number, store, events_of, companies, as_of)
    every = fetches(spark, rows).cache()
    changed = W.changed_fetches(every, spark.createDataFrame([], W.HASHES))
    events = events_of(W.relevant_fetches(changed, companies))
    from tidemark.operators import mentions as M

    events = M.route_events(events, companies).cache()
    number = spark.createDataFrame([(i % 30, 1_700_000_000 + i * 30_000, b) for i, b in ((i, 0 if i < 60 else 1 if i < 100 else 2) for i in range(150))], "source_id long, s long, batch int")
    number = number.select(F.xxhash64("source_id", F.timestamp_seconds("s")).alias("event_id"), "batch")
    events = events.join(number, "event_id")
    canonical = D.dedup_events(events.withColumnRenamed("event_id", "id"), order=("batch", "id"))
    stored = {r.event_id: r.canonical_id for r in spark.read.parquet(f"{store}/reports").collect()}
    assert stored == {r.id: r.canonical_id for r in canonical.collect()} and 3 < len(set(stored.values())) < len(stored)
    whole = W.canonical_events(events.join(canonical.withColumnRenamed("id", "event_id"), "event_id"))
    key = lambda df: sorted((r.id, r.company_id, r.event_type, r.source_count, len(r.evidence)) for r in df.collect())
    assert key(W.crawled_events(spark, store)) == key(whole)
    urls = {r.canonical_id: r.urls for r in J.merge_evidence(events.withColumnRenamed("event_id", "id"), canonical).collect()}
    assert {r.id: len(r.evidence) for r in whole.collect()} == urls
    touched = spark.createDataFrame([(c,) for c in {r.company_id for r in events.collect()}], "id long")
    want = {r.company_id: (round(r.momentum_score, 6), r.momentum_label, r.n_events) for r in W.company_scores(whole, companies.join(touched, "id"), as_of).collect()}
    assert {r.company_id: (round(r.momentum_score, 6), r.momentum_label, r.n_events) for r in W.crawled_scores(spark, store).collect()} == want and max(v[2] for v in want.values()) > 2


def test_stream_scores_touched_companies_only(spark, tmp_path):
    """A file is a batch; as_of follows the batch, so a company that the second leaves alone keeps its first score."""
    one = [(1, None, "news_site", 1_700_000_000, "u1", "Razorpay news\nkind=new_office city=pune" + TEXT), (2, None, "news_site", 1_700_000_000, "u2", "Groww news\nkind=new_office city=pune" + TEXT)]
    two = [(2, None, "news_site", 1_700_100_000, "u3", "Groww news\nkind=new_office city=Pune" + TEXT), (1, None, "news_site", 1_700_100_000, "u1", one[0][5]), (3, None, "news_site", 1_700_100_000, "u4", "Nobody" + TEXT)]
    companies = spark.createDataFrame(NAMES, "id long, name string, aliases array<string>")
    for part in (one, two):
        fetches(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fetches(spark, one).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    when = lambda n: F.lit(f"2023-11-{16 + n}").cast("timestamp")
    W.run_crawl(stream, str(tmp_path / "store"), events_of, companies, str(tmp_path / "ckpt"), when).awaitTermination(240)
    scores = {r.company_id: r.scored_at.day for r in W.crawled_scores(spark, str(tmp_path / "store")).collect()}
    parts = spark.read.parquet(str(tmp_path / "store" / "scores")).groupBy("company_id").count().collect()
    (groww,) = [r for r in W.crawled_events(spark, str(tmp_path / "store")).collect() if r.company_id == 9]
    assert len(scores) == 2 and sum(r["count"] for r in parts) == 3 and sorted(scores.values()) == [16, 17] and groww.source_count == 2


def test_batch_is_read_twice_and_names_are_searched_only_for_loose_fetches(spark, tmp_path, monkeypatch):
    """Keys and fetches are one pass each, events are made once, and where all have a company the spellings are not touched."""
    rows = [(i, 7 + i % 2, "news_site", 1_700_000_000 + i * 30_000, f"u{i % 3}", f"x\nkind=new_office city=pune{i % 3}" + TEXT) for i in range(40)]
    companies, as_of = spark.createDataFrame(NAMES, "id long, name string, aliases array<string>"), F.lit("2024-02-01").cast("timestamp")
    read, made, searched = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), []

    def counted(df, n):
        def run(batches):
            for pdf in batches:
                n.add(len(pdf))
                yield pdf

        return df.mapInPandas(run, df.schema)

    find = W.M.find_mentions
    monkeypatch.setattr(W.M, "find_mentions", lambda *a: searched.append(1) or find(*a))
    for number, part in enumerate((rows[:30], rows[30:])):
        W.crawl_batch(counted(fetches(spark, part), read), number, str(tmp_path / "store"), lambda docs: counted(events_of(docs), made), companies, as_of)
    assert (read.value, made.value, searched) == (2 * len(rows), len(rows), [])
    loose = [(41, None, *rows[0][2:5], "Groww " + rows[0][5]), (42, *rows[1][1:])]
    W.crawl_batch(fetches(spark, loose), 2, str(tmp_path / "store"), events_of, companies, as_of)
    assert searched == [1, 1] and {r.company_id for r in spark.read.parquet(str(tmp_path / "store" / "reports")).collect()} == {7, 8, 9}


def test_scored_events_are_the_canonical_ones(spark):
    """Sources and best tier without lists, reports without a URL included."""
    urls = [None, "https://blog.example.com/x", "https://techcrunch.com/1", "https://techcrunch.com/1", "https://newsapi.org/2"]
    rows = [(i, i // 4 * 4, 7, "funding", "t", urls[i % 5], 0) for i in range(24)] + [(90, 90, 8, "funding", "t", None, 0)]
    df = spark.createDataFrame(rows, "event_id long, canonical_id long, company_id long, event_type string, title string, source_url string, batch int").withColumn("observed_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    got = {r.canonical_id: (r.source_count, r.factor) for r in W.scored_events(df).collect()}
    want = {r.id: (r.source_count, r.factor) for r in W.C.with_factor(W.canonical_events(df)).collect()}
    assert got == want and got[90] == (1, 0.3) and len({f for _, f in got.values()}) > 1
