"""Streams with list and value state against their batch forms."""

import collections
import random

from pyspark.sql import functions as F
from test_dedup import frame
from test_streams import fed

from tidemark.operators import dedup as D
from tidemark.operators import snapshots as N
from tidemark.streaming import states as SS


def test_stream_dedup_by_facts(spark, tmp_path):
    """Rounds, persons, cities, targets and titles, in time order over three batches, with leaders that expire in between."""
    rng = random.Random(4)
    kinds = ["funding", "leadership_change", "new_office", "acquisition", "partnership"]
    pick = rng.choice
    rows = [
        (
            i, i % 3, pick(kinds), pick(["raised series b round", "raised series b round today", "opens office pune campus", "", None]), 1_700_000_000 + i * 20_000, pick(["Series A", "series a", "Series B", None]), pick(["100", "110", "300", None]),
            pick(["Ann Lee", "ann lee", "Bo", None]), pick(["VP of Engineering", "VP Engineering", "Designer", None]), pick(["Pune", "Delhi", None]), pick(["Acme", "acme", None]),
        )
        for i in range(300)
    ]
    df = frame(spark, rows).cache()
    parts = [df.filter("id < 100"), df.filter("id >= 100 and id < 110"), df.filter("id >= 110")]
    got = {r[2]: r[3] for r in fed(spark, tmp_path, parts, SS.stream_dedup, "deduped_facts")}
    want = {r.id: r.canonical_id for r in D.dedup_events(df).collect()}
    assert got == want and 30 < len(set(want.values())) < 250


def test_leaders_expire(spark, tmp_path):
    """The state of a topic shrinks to the leaders that can still match."""
    day = 86_400
    rows = [(i, 1, "acquisition", None, 1_700_000_000 + i * 16 * day, None, None, None, None, None, "acme") for i in range(6)]
    df = frame(spark, rows).cache()
    parts = [df.filter(F.col("id") == i) for i in range(6)]
    got = {r[2]: r[3] for r in fed(spark, tmp_path, parts, SS.stream_dedup, "expired")}
    assert got == {i: i for i in range(6)}
    held = spark.read.format("statestore").option("stateVarName", "leaders").option("path", str(tmp_path / "ckpt")).load()
    assert held.count() <= 2


def test_quota_calls(spark, tmp_path):
    """Shuffled batches, late calls included: the flags add up to the batch operator's counts, and each is right in its order of arrival."""
    rng = random.Random(5)
    base = 1_699_920_000  # a day's start
    rows = [(i, i % 3, base + rng.randrange(2 * 86_400)) for i in range(90)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, k long, s long").select("id", "k", F.timestamp_seconds("s").alias("ts")).cache()
    batch = {i: n // 30 for n, (i, _, _) in enumerate(rows)}
    parts = [df.filter(F.col("id").isin([i for i in batch if batch[i] == b])) for b in range(3)]
    got = {r[2]: r[3] for r in fed(spark, tmp_path, parts, lambda s: SS.stream_quota_calls(s, "k", "ts", "id", 7, "3 days"), "quota_calls")}
    used, want = collections.Counter(), {}
    for b in range(3):
        for s, i, k in sorted((s, i, k) for i, k, s in rows if batch[i] == b):
            want[i] = used[k, s // 86_400] < 7
            used[k, s // 86_400] += 1
    assert got == want and len(got) == 90
    days = {(r.k, r.day): r.allowed for r in N.daily_quota(df, "k", "ts", ["ts", "id"], 7).collect()}
    flags = collections.Counter((k, str(s // 86_400)) for i, k, s in rows if got[i])
    assert sorted(days.values()) == sorted(flags.values())
