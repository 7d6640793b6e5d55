import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import shingles, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(rng, n):
    """n groups of an original and two near copies, each with words / 60 words replaced, and n texts of their own; blanks."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, group = [], []
    for g in range(n):
        base = [word() for _ in range(rng.choice([120, 300, 900]))]
        for copy in range(3):
            w = list(base)
            for i in rng.sample(range(len(w)), len(w) // 60 if copy else 0):
                w[i] = word()
            texts.append(" ".join(w))
            group.append(g)
    texts += [" ".join(word() for _ in range(100)) for _ in range(n)] + [None, "", " \n"]
    return texts, group


def brute(texts, similarity=0.8):
    sets = [set(shingles.shingles((t or "").encode()).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        n = len(sets[a] & sets[b])
        if n >= similarity * (len(sets[a]) + len(sets[b]) - n):
            root = [root[a] if r == root[b] else r for r in root]
    return len(set(root)), sets


def test_planted_near_copies_go(spark):
    texts, group = planted(random.Random(8), 25)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    n, sets = brute(texts)
    assert len(kept) == n
    for a, b in itertools.combinations(kept, 2):
        both = len(sets[a] & sets[b])
        assert both < 0.8 * (len(sets[a]) + len(sets[b]) - both)


@pytest.mark.parametrize("bucket", [shingles.BUCKET, 20])
def test_large_buckets(spark, bucket):
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(200)]
    texts = []
    for _ in range(120):
        w = list(base)
        w[rng.randrange(200)] = str(rng.random())
        texts.append(" ".join(w))
    shared = " ".join(base[:60])
    texts += [shared + " " + " ".join(str(rng.random()) for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert shingles.keep_one(docs, bucket=bucket).count() == 61


def test_short_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "", "", 0), (2, "A  b", "", "", 0), (3, "a c", "", "", 0), (None, None, "", "", 0), (5, "", "", "", 0)], SCHEMA)
    assert {r.doc_id for r in shingles.keep_one(docs).collect()} == {1, 3, 5}
    assert shingles.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("changed", [(4, 9), (6, 12)])
def test_groups_around_the_threshold(spark, changed):
    """Copies of one text of which most pairs lie just under the similarity: spanning pairs fail, and the classes are still those of all pairs."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(240)]
    texts = []
    for _ in range(90):
        w = list(base)
        for i in rng.sample(range(240), rng.randint(*changed)):
            w[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    n, _ = brute(texts)
    assert shingles.keep_one(docs).count() == n


def test_pairs_come_from_the_gray_index():
    """Signatures that agree are not enough: only texts that the index finds within the radius are proposed, in small buckets and large."""
    rng = np.random.default_rng(4)
    for n in (6, 40):
        base = rng.integers(0, 1 << 63, 2, np.uint64)
        base[1] = base[0] ^ np.uint64((1 << 40) - 1)  # 40 bits away
        flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False))) for _ in range(n)]
        fp = np.array([base[i % 2] ^ f for i, f in enumerate(flips)], np.uint64).view(np.int64)
        near = shingles.searcher(fp)
        far = np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64))
        assert all(near(i).tolist() == np.flatnonzero(far[i] <= shingles.RADIUS).tolist() for i in range(n))
        th, sig = np.arange(n), np.zeros((n, shingles.HASHES), np.uint8)
        a, b, _ = shingles.spanning(th, fp, sig)
        assert len(a) == n - 2 and all(x % 2 == y % 2 for x, y in zip(a, b, strict=True))
        a, b, _ = shingles.crossing(th, fp, np.zeros((n, shingles.WIDE), np.uint8), th, [[7]] * n)
        assert len(a) == 2 * (n // 2) * (n // 2 - 1) // 2 and all(x % 2 == y % 2 for x, y in zip(a, b, strict=True))


def test_fingerprints_of_similar_sets_lie_within_the_radius():
    rng = np.random.default_rng(6)
    for both, one, other in ((4, 1, 0), (8, 1, 1), (8, 2, 0), (80, 10, 10), (800, 100, 100)):
        for _ in range(300):
            h = rng.integers(0, 1 << 63, both + one + other, np.uint64) * np.uint64(2) + rng.integers(0, 2, both + one + other, np.uint64)
            x, y = simhash.majority(h[: both + one]), simhash.majority(np.concatenate([h[:both], h[both + one :]]))
            assert (x ^ y).bit_count() <= shingles.RADIUS


def test_classes_of_fingerprints_are_buckets(spark):
    """Texts whose fingerprints lie within 2 bits meet even where they share no band; others don't."""
    sig = bytes(shingles.HASHES)
    rows = [(i, i, fp, sig, [100 * i + k for k in range(shingles.BANDS)]) for i, fp in enumerate([5, 7, 7, 1 << 40 | 0xFFFF])]
    sigs = spark.createDataFrame(rows, "doc_id long, th long, fp long, sig binary, keys array<long>")
    pairs, _ = shingles.candidates(sigs)
    near = {tuple(r) for r in pairs.select("a", "b").collect()}
    assert near and {x for p in near for x in p} == {0, 1, 2}


def test_repeated_shingles_do_not_move_the_fingerprint(spark):
    """Likeness is of sets, so a text that says its words many times has the fingerprint of one that says them once."""
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(words + words[:5]), " ".join(words * 9)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    a, b = (r.fp for r in shingles.signatures(docs).collect())
    assert ((a ^ b) & (1 << 64) - 1).bit_count() <= shingles.RADIUS
    assert shingles.keep_one(docs).count() == 1
