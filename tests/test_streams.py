"""Streaming forms against their batch forms, and the embedder's edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest as G
from tidemark.operators import matching as J
from tidemark.operators import snapshots as N
from tidemark.streaming import changes as ST
from tidemark.streaming import states as SS


def fed(spark, tmp_path, parts, build, name):
    """Rows that a stream of the given files yields, a file a batch."""
    source = tmp_path / "in"
    schema = parts[0].schema
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(source / f"p={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "p=*"))
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_stream_throttle(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted((rng.randint(0, 200), i, i % 3) for i in range(120))
    df = spark.createDataFrame([(k, s, i) for s, i, k in rows], "k long, s long, id long").select("k", F.timestamp_seconds("s").alias("ts"), "id").cache()
    parts = [df.filter("ts < '1970-01-01 00:01:30'"), df.filter("ts >= '1970-01-01 00:01:30'")]
    got = {r[2]: r[3] for r in fed(spark, tmp_path, parts, lambda s: ST.stream_throttle(s, "k", "ts", "id"), "throttled")}
    assert got == {r.id: r.allowed for r in ST.throttle(df, "k", "ts", "id").collect()} and len(set(got.values())) == 2


def test_stream_dedup(spark, tmp_path):
    rng = random.Random(2)
    titles = ["raised series b round", "raised series b round today", "opens office pune", "opens office delhi campus", "", None]
    rows = [(i, i % 2, "funding", rng.choice(titles), 1_700_000_000 + i * 40_000) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, company_id long, event_type string, title string, s long").select("id", "company_id", "event_type", "title", F.timestamp_seconds("s").alias("observed_at")).cache()
    parts = [df.filter("id < 40"), df.filter("id >= 40 and id < 80"), df.filter("id >= 80")]
    got = {r[2]: r[3] for r in fed(spark, tmp_path, parts, SS.stream_dedup, "deduped")}
    assert got == {r.id: r.canonical_id for r in J.dedup_events(df).collect()} and len(set(got.values())) < 120


@pytest.mark.parametrize("n", [1, 3])
def test_sliding_limit(spark, n):
    rng = random.Random(n)
    rows = sorted((rng.randint(0, 99), i, i % 2) for i in range(100))
    df = spark.createDataFrame([(i, k, s) for s, i, k in rows], "id long, k long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want, held = {}, {}
    for s, i, k in rows:
        near = [t for t in held.get(k, []) if s - t < 7]
        want[i] = len(near) < n
        held[k] = [*near, s] if want[i] else near
    assert {r.id: r.allowed for r in ST.sliding_limit(df, "k", "ts", n, 7, "id").collect()} == want


def test_embed_table(spark):
    def embed(texts):
        assert len(texts) <= 2 and len(set(texts)) == len(texts)
        if "boom" in texts:
            raise ValueError
        return [None if t == "none" else [3.0, 4.0] if t != "wide" else [1.0] * 3 for t in texts]

    rows = [(1, "a"), (2, "a"), (3, None), (4, " "), (5, "none"), (6, "wide"), (7, "b")]
    got = {r.id: r.embedding and [round(x, 3) for x in r.embedding] for r in J.embed_table(spark.createDataFrame(rows, "id long, t string"), "t", embed, 2, 2).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.6, 0.8], 3: None, 4: None, 5: None, 6: None, 7: [0.6, 0.8]}
    assert J.embed_table(spark.createDataFrame([(1, "boom")], "id long, t string"), "t", embed, 2).first().embedding is None


def test_stream_changes(spark, tmp_path):
    """The stream emits what the batch form marks, going back to an older content included."""
    texts = ["a", "a", "b", None, "", "a", "a", "c"]
    rows = [(k, 1000 + 10 * i + k, texts[(i + k) % len(texts)]) for i in range(24) for k in range(2)]
    df = spark.createDataFrame(rows, "source_id long, s long, text string").select("source_id", F.timestamp_seconds("s").alias("fetched_at"), "text").cache()
    parts = [df.filter("fetched_at < '1970-01-01 00:18:00'"), df.filter("fetched_at >= '1970-01-01 00:18:00'")]
    got = sorted((r[0], r[1]) for r in fed(spark, tmp_path, parts, ST.stream_changes, "changed"))
    want = sorted((r.source_id, r.fetched_at) for r in N.content_changes(df, "source_id", ["fetched_at"], "text").filter("changed").collect())
    assert got == want and 0 < len(want) < 48


def test_stream_quota(spark, tmp_path):
    rows = [(i % 3, 1_700_000_000 + i * 7_000) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, s long").select("k", F.timestamp_seconds("s").alias("ts")).cache()
    got = fed(spark, tmp_path, [df.filter("k < 2"), df.filter("k = 2")], lambda s: ST.stream_quota(s, "k", "ts"), "quota")
    days = {(r.k, r.d): r["count"] for r in df.groupBy("k", F.to_date("ts").alias("d")).count().collect()}
    assert got and all(days[(k, w.start.date())] == n for w, k, n in got if k < 2)


def test_incremental_pipeline(spark, tmp_path):
    """Only changed, relevant fetches reach the extractor, and only their companies are touched; a fetch that repeats the stored text is not."""
    long = " is hiring engineers for its new office in a city far away, and raised a series a round of funding too."
    old = spark.createDataFrame([(1, "Razorpay" + long)], "source_id long, text string").select("source_id", F.sha2("text", 256).alias("content_hash"))
    rows = [(1, 10, "Razorpay" + long), (2, 10, "Zomato" + long), (2, 20, "Zomato" + long), (3, 10, "short"), (4, 10, "Nobody" + long)]
    fetches = spark.createDataFrame(rows, "source_id long, s long, text string").select("source_id", F.lit(None).cast("long").alias("company_id"), F.lit("news_site").alias("source_type"), F.timestamp_seconds("s").alias("fetched_at"), F.lit("u").alias("url"), "text")
    fetches.coalesce(1).write.parquet(str(tmp_path / "in"))
    companies = spark.createDataFrame([(7, "Razorpay", None), (8, "Zomato", None)], "id long, name string, aliases array<string>")
    seen = {}

    def write(tables, number):
        seen[number] = {k: [tuple(r) for r in v.collect()] for k, v in tables.items()}

    events = lambda df: df.select(F.col("source_id").alias("event_id"), F.col("text").alias("title"), F.lit("").alias("context"), "company_id")
    stream = spark.readStream.schema(fetches.schema).parquet(str(tmp_path / "in"))
    G.run_incremental(stream, lambda: old, write, events, companies, str(tmp_path / "ckpt")).awaitTermination(120)
    (batch,) = seen.values()
    assert batch["touched"] == [(8,)] and sorted(r[0] for r in batch["changed"]) == [2, 3, 4]


def test_append_scores_and_fan_out(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0, 0), (2, 6.0, 90_000)], "company_id long, momentum_score double, s long").select("company_id", "momentum_score", F.timestamp_seconds("s").alias("scored_at"))
    for _ in range(2):
        G.append_scores(df, str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "scores")).groupBy("score_date").count().count() == 2 and spark.read.parquet(str(tmp_path / "scores")).count() == 4
    jobs = spark.createDataFrame([(i, t, None, "h", 0, True, [1.0] if i == 1 else None) for i, t in enumerate(["A b", "x", "x", "a  B", ""])], "id long, title string, department string, content_hash string, first_seen_at long, is_active boolean, embedding array<float>")
    jobs = jobs.withColumn("role_family", F.lit(None).cast("string")).withColumn("description_text", F.lit(None).cast("string"))
    copied = G.copy_sibling_vectors(jobs)
    assert {r.id for r in copied.filter("embedding is not null").collect()} == {1, 2}
    work = G.embedding_worklist(copied)
    vectors = work.select("digest", F.when(F.col("text") == "A b", F.array(F.lit(2.0))).alias("embedding"))
    out = G.fan_out(vectors, work)
    assert {r.id: r.embedding for r in out.collect()} == {0: [2.0], 3: [2.0]}
    assert tuple(G.embedding_counts(jobs, copied, out).first()) == (4, 1, 2, 1)
