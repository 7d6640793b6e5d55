"""Mentions and routing against a plain alternation over all names, and on hand-made texts."""

import random
import re

import pytest

from tidemark.operators import mentions as M

COMPANIES = [(1, "Razorpay", None), (2, "Zomato", ["Eternal"]), (3, "Blinkit", []), (4, "Ola", None), (5, "Ola Electric", None), (6, "Open", None), (7, "Meta", None), (8, "Sarvam", ["Sarvam AI", " "]), (9, "Twin Co", None), (10, "twin co", None), (11, "X", None), (12, None, ["Node.js"])]


def plain(text):
    """doc -> rows by brute force: one expression of every spelling, longest first."""
    owner = {}
    for i, name, aliases in COMPANIES:
        for s in [name, *(aliases or [])]:
            s = (s or "").strip()
            if len(s) >= 3:
                owner[s.lower()] = (None if s.lower() in owner and owner[s.lower()][0] != i else i, s)
    every = re.compile(r"(?<![\w.])(" + "|".join(re.escape(k) for k in sorted(owner, key=len, reverse=True)) + r")(?!\w)", re.I)
    out = {}
    for m in every.finditer(text):
        i, s = owner[m[1].lower()]
        sure = s.lower() not in M.ORDINARY and len(s) > 4
        near = text[max(0, m.start() - 120) : m.end() + 120]
        if i and (sure or (m[1] == s and re.search(M.CUE, near, re.I))):
            out.setdefault(i, [0, m.start(), m[1], sure])[0] += 1
    return out


def companies(spark):
    return spark.createDataFrame(COMPANIES, "id long, name string, aliases array<string>")


@pytest.mark.parametrize("broadcast", [M.BROADCAST, 2])
def test_against_plain_search(spark, broadcast):
    rng = random.Random(5)
    parts = ["Razorpay", "razorpay", "Zomato", "ETERNAL", "Blinkit", "Ola", "OLA", "Ola Electric", "Open", "open", "Meta", "meta", "Sarvam", "Sarvam AI", "Twin Co", "X", "Node.js", "raised", "hiring", "$5", "résumé", "的", ".", ",", "-", "_", "\n", "x" * 60]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "", "."]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, "")], "doc_id long, text string")
    got = {}
    for r in M.find_mentions(docs, companies(spark), broadcast).collect():
        got.setdefault(r.doc_id, {})[r.company_id] = [r.mentions, r.first_position, r.matched, r.distinctive]
    assert got == {i: want for i, t in enumerate(texts) if (want := plain(t))}
    assert any(len(v) > 2 for v in got.values())


def test_rank_and_empty(spark):
    docs = spark.createDataFrame([(1, "Zomato acquires Blinkit"), (2, "open source"), (3, "Open raised a round; Razorpay did not")], "doc_id long, text string")
    got = {(r.doc_id, r.rank): r.company_id for r in M.find_mentions(docs, companies(spark)).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (3, 1): 1, (3, 2): 6}
    assert not M.find_mentions(docs.limit(0), companies(spark)).collect() and not M.find_mentions(docs, companies(spark).limit(0)).collect()


def test_routing(spark):
    rows = [(1, "Razorpay hires a CTO", "seen on Zomato", None), (2, "SkyAI recruiting", "as Zomato posted", None), (3, "Opens an office", None, 77), (4, None, "Zomato", None)]
    events = spark.createDataFrame(rows, "event_id long, title string, context string, company_id long")
    assert {r.event_id: r.company_id for r in M.route_events(events, companies(spark)).collect()} == {1: 1, 3: 77}
