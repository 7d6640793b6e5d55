"""Whole results of the queries without SQL against brute force, column by column."""

import bisect
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprint, lm, packing, quality
from tidemark.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, source string"
TEXTS = [None, "", "a", "ab", "abc é日本", "x" * 40, "the cat sat on the mat. " * 30, "the cat sat on the mat. " * 29 + "a dog stood by it now..", "tail words here " * 50, "# $ % & | < >\na b c\na b c\na b c", "Wörter ÄÖ\n\nWörter ÄÖ\n  \nEnd 1 2 3."]
ROWS = [(i * 3, t, "s") for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def test_buckets_by_cuts(spark):
    rng = random.Random(3)
    for n in (0, 1, 2, 5, 50, 300):
        cut = sorted(rng.sample(range(-1000, 1000), n), reverse=True)
        xs = [*cut, *(rng.randint(-1100, 1100) for _ in range(60))]
        got = spark.createDataFrame([(x,) for x in xs], "x long").select("x", fingerprint._at_least(cut, F.col("x")).alias("n")).collect()
        assert [(r.x, r.n) for r in got] == [(x, sum(c >= x for c in cut)) for x in xs]


def test_fingerprint_columns(docs):
    order = [(i, t or "") for i, t, _ in sorted(ROWS, key=lambda r: -r[0])]
    want = {}
    for (i, t), (_, nxt) in zip(order, [*order[1:], order[0]], strict=True):
        made = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        fps = [fingerprint.fingerprint(fingerprint.Prefix(x)) for x in (t, made, nxt)]
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        want[i] = (len(t), hashlib.sha256(made.encode()).hexdigest(), fps[0], fps[1], fingerprint.likeness(fps[0], fps[1]), fingerprint.likeness(fps[0], fps[2]), common(t, made), common(t, nxt))
    got = {r.doc_id: tuple(r)[1:] for r in fingerprint.fingerprints(docs).collect()}
    assert got == want


def test_likeness():
    base = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(3200))
    like = lambda a, b: fingerprint.likeness(*(fingerprint.fingerprint(fingerprint.Prefix(x)) for x in (a, b)))
    assert like(base, base) == 1 and like(base, "") == 0 and like("", "") == 1
    two = base[:100] + "#" + base[101:3100] + "#" + base[3101:]
    assert like(base, two) > 0.85
    assert like(base, base[:1600] + "inserted " + base[1600:]) > 0.85 and like(base, "head " + base) > 0.9 and like(base, base + " tail") > 0.9
    other = "".join(chr(97 + (i * 11 + i * i // 5) % 26) for i in range(3200))
    assert like(base, other) < 0.1


def test_long_text_in_chunks(monkeypatch):
    text = "".join(chr(97 + i % 23) for i in range(5000))
    whole = fingerprint.Prefix(text)
    monkeypatch.setattr(fingerprint, "CHUNK", 64)
    cut = fingerprint.Prefix(text)
    assert all((a == b).all() for a, b in zip(whole.at, cut.at, strict=True)) and cut.extension(0, whole, 0) == 5000


def test_packing_columns(docs, spark):
    """Every id lies in one piece, offsets are gapless from 0, costs are even and sequences few."""
    many = docs.union(docs).union(spark.createDataFrame([(1000 + i, "some words go here " * (i % 90), "s") for i in range(600)] + [(5, "again and again", "s")] * 300, SCHEMA))
    enc, out = Encoder(packing.TOKENIZER), packing.pack(many, group=200).collect()
    texts = collections.defaultdict(collections.Counter)
    for r in many.collect():
        texts[r.doc_id][r.text or ""] += 1
    ids = {(d, t): np.append(enc.encode_all([t])[0], 1).astype("<u4") for d, c in texts.items() for t in c}
    pieces = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out)
    want = collections.Counter()
    for (d, t), x in ids.items():
        for s, n in packing.cuts(len(x)):
            want[d, s, n, zlib.crc32(x[s : s + n].tobytes()), len(x)] += texts[d][t]
        assert sum(n for _, n in packing.cuts(len(x))) == len(x)
    assert pieces == want
    held = collections.defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        spans.sort()
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) <= packing.SIZE
    assert len(held) <= 1.1 * sum(r.length for r in out) / packing.SIZE + 12
    costs = np.array([packing.cost(np.array([n for _, n in s])).sum() for s in held.values() if sum(n for _, n in s) > 1900])
    assert costs.max() <= 1.6 * costs.min()


def test_model_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = lm.fit_and_score(docs).collect()
    texts = {r.doc_id: re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower()) for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    seen = {w for i, t in texts.items() if not held[i] for w in t}
    assert {r.doc_id: (r.held_out, r.n_tokens, r.n_known) for r in out} == {i: (held[i], len(t) + 1, sum(w in seen for w in t) + 1) for i, t in texts.items()}
    apart = [r for r in out if r.held_out]
    assert sum(r.score > r.base_score for r in apart) > 0.9 * len(apart) and sum(r.score for r in apart) > sum(r.base_score for r in apart) * 0.97


def test_quality_columns(docs):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    votes, weights = [], []
    for i, t, _ in ROWS:
        t = t or ""
        w, r = re.findall(r"[^\x20\x09-\x0D]+", t), got[i]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {k + j for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert r.kept == (not r.base_failed and r.quality >= quality.KEEP)
    names = list(quality.rules())
    for r in quality.features(docs).select("doc_id", *[v.alias(k) for k, v in quality.rules().items()]).collect():
        votes.append([r[n] for n in names])
        weights.append(1.0)
    share, right = quality.em(np.array(votes, float), np.array(weights))
    for r, v in zip(quality.features(docs).select("doc_id").collect(), votes, strict=True):
        odds = share / (1 - share)
        for x, a in zip(v, right, strict=True):
            odds *= (a / (1 - a)) ** x
        assert got[r.doc_id].quality == pytest.approx(odds / (1 + odds))


def test_likelihood_rises():
    rng = np.random.default_rng(2)
    good = rng.random(4000) < 0.7
    votes = np.where(rng.random((4000, 4)) < 0.85, 1, -1) * np.where(good, 1, -1)[:, None] * (rng.random((4000, 4)) < 0.8)
    table, counts = np.unique(votes, axis=0, return_counts=True)
    share, right = quality.em(table.astype(float), counts.astype(float))
    assert share == pytest.approx(0.7, abs=0.03) and right == pytest.approx([0.85] * 4, abs=0.03)
    p = quality.posterior(votes.astype(float), share, right)
    assert ((p > 0.5) == good).mean() > 0.93 and bisect.bisect([0, 1], share) == 1


def test_variety_has_no_step_in_length():
    """A text that goes on in the same way is judged in the same way at any length."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    few, many = [f"w{i % 90}" for i in range(12_000)], [f"w{i * i % 7919}" for i in range(12_000)]
    for words in (few, many):
        rows = [(n, " ".join(words[:n])) for n in (1000, 4999, 5000, 5001, 9000, 12_000)]
        votes = quality.features(spark.createDataFrame(rows, "doc_id long, text string")).select(quality.rules()["variety"].alias("v")).distinct().collect()
        assert [r.v for r in votes] == [-1 if words is few else 0]
