"""Collocations against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from tidemark.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"


def brute(rows, min_count, covered=80, top=2000):
    counts = collections.Counter()
    for _, text, lang in rows:
        folded = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^\x20\x09]+", piece)
            counts.update((lang if lang is not None else "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    total = collections.Counter()
    for (lang, p), n in counts.items():
        total[lang] += n * (len(p) == 1)
    cands = {x: n for x, n in counts.items() if len(x[1]) > 1 and n >= min_count}
    gone = {(lang, q[i : i + m]) for (lang, q), n in cands.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * n >= covered * counts[lang, q[i : i + m]]}
    out = collections.defaultdict(list)
    for (lang, p), a in cands.items():
        if (lang, p) not in gone:
            score, _, l, r = min((2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, each in out.items() for i, (s, a, p, l, r) in enumerate(sorted(each)[:top]))


def made(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in phrases.collocations(df, **how).collect())


def corpus(seed, n):
    """Few words, so that counts lie around the threshold and reach it in different scans; phrases repeat."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "日本", "New", "york", "x'y", "a-b", "\x00"]
    fixed = ["New York City hall", "a-b x'y", "the 日本 É\tw1"]
    text = lambda: "".join(rng.choice([*rng.choices(words, k=6), *fixed]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\xa0"]) for _ in range(rng.randrange(40)))
    return [(i, text(), rng.choice(["en", "en", "en", "de", None, "und", ""])) for i in range(n)]


@pytest.mark.parametrize(("seed", "min_count", "top"), [(1, 4, 2000), (2, 7, 25)])
def test_collocations(spark, monkeypatch, seed, min_count, top):
    monkeypatch.setattr(phrases, "SLOTS", 1 << 12)
    rows = corpus(seed, 260)
    assert made(spark, rows, min_count=min_count, top=top) == brute(rows, min_count, top=top)


def test_shared_slots_never_change_a_count(spark):
    """So small a table lets nearly all through, early and in vain."""
    rows = corpus(3, 120)
    for slots in (64, 1 << 16):
        got, words = phrases.counted_phrases(spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA).repartition(4), min_count=5, slots=slots)
        assert sum(r.n for r in words.collect()) > 0
        found = {(r.lang, r.phrase): r.n for r in got.collect()}
        assert len(found) == got.count()
        want = collections.Counter()
        for _, text, lang in rows:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if c.isascii() else c for c in text)):
                w = re.findall(r"[^\x20\x09]+", piece)
                want.update((lang if lang is not None else "und", " ".join(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
        assert found == {x: n for x, n in want.items() if n >= 5}


def test_long_text_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 50)
    text = "one two three four five, " * 400 + "six seven " * 300
    assert b"".join(phrases.slices(text.encode())) == text.replace(",", "\n").encode() + b"\n"
    rows = [(1, text, "en"), (1, text, "en"), (2, text, None)]
    assert made(spark, rows) == brute(rows, 30)


def test_odd_rows(spark):
    assert made(spark, []) == []
    assert made(spark, [(1, None, None), (2, "", "en"), (None, " \t\n.,", "en")]) == []


def test_slots_of_tasks_and_table_agree(spark):
    """A phrase is found in the table under the hash that the scan gives it."""
    tables = np.full((3, 1 << 10), phrases.NEVER, np.uint8)
    phrases.note(tables, spark.createDataFrame([("en", 2, "a b"), ("de", 1, "é")], "lang string, k int, phrase string"), 6)
    h = np.array([phrases.word_hash("en", w) for w in (b"a", b"b")], np.uint64)
    assert phrases.started(tables[1], phrases.longer_hash(h[:1], h[1:])).tolist() == [6]
    assert phrases.started(tables[0], np.array([phrases.word_hash("de", "é".encode())], np.uint64)).tolist() == [6] and (tables[2] == phrases.NEVER).all()
