"""Tracked companies named in prose, and the company an event is about."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LEAST_NAME, SHORT_NAME, CUE_WINDOW = 3, 4, 120
# Names that are ordinary words, and the cues that mark such a word as a company.
ORDINARY = ("cred", "digit", "element", "emergent", "glance", "hike", "linear", "locus", "meta", "middleware", "notion", "open", "porter", "raise", "ramp", "slice", "snap", "turing", "zeta", "zone")
CUE = (
    r"\b(?:raise[ds]?|raising|funding|funded|round|series\s+[a-e]|seed|valuation|investors?|invests?|invested|backed|acquir\w+|merger|ipo|startup|start-up|company|firm|platform|unicorn|founders?|"
    r"co-founder|ceo|cto|cfo|coo|hir(?:ing|es|ed)|headcount|employees|engineers?|engineering|recruit\w*|onboard\w*|team|staff|announced|launches|launched|expands?|expansion|appoints?|appointed|"
    r"exits?|departs?|departure|resign\w*|steps\s+down|joins?|joined|promoted|elevated|named|leaves|leaving|crore|lakh|million|billion)\b|[$₹]\s?\d"
)
#: Up to so many spellings (a few MB) travel to every task, and texts are read once, without a shuffle.
BROADCAST = 20_000
MENTION = "doc_id long, company_id long, name string, matched string, mentions long, first_position long, distinctive boolean, rank long"


def _places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where a name may start, and for each position whether one may end there."""
    ends = np.ones(len(text) + 1, bool)
    for m in re.finditer(r"\w+", text):
        ends[m.start() : m.end()] = False
    return np.array([m.start() for m in re.finditer(r"(?<![\w.])(?=\S)", text)], np.int64), ends


def _anchors(text: str, starts: list[int]) -> set[str]:
    """What an index of names is entered by at each start: the text through its first word, and through its second; a sign also alone."""
    ends, out, at = [(m.start(), m.end()) for m in re.finditer(r"\w+", text)], set(), 0
    for s in starts:
        while at < len(ends) and ends[at][0] < s:
            at += 1
        out.update(text[s : e].lower() for _, e in ends[at : at + 2])
        if at == len(ends) or ends[at][0] > s:
            out.add(text[s].lower())
    return out


def _anchor(key: str) -> str:
    """The entry of a spelling: through its second word, or its first if it has one, or its first sign."""
    ends = [m.end() for m in re.finditer(r"\w+", key)][:2]
    return key[: ends[-1]] if ends else key[0]


def _inner(c: str) -> bool:
    """Whether a character is part of a word."""
    return c.isalnum() or c == "_"


def _first_word(key: str) -> str:
    """The first word in lower case, with one form of the letter that has another at a word's end; empty if there are signs alone."""
    m = re.search(r"\w+", key)
    return m[0].lower().replace("ς", "σ") if m else ""


@F.pandas_udf(StringType())
def _anchor_of(key: pd.Series) -> pd.Series:
    return key.map(_anchor)


def spellings(companies: DataFrame) -> DataFrame:
    """key, company_id, name, spelling: a row for each lower-case name or alias of three characters or more. One that two companies claim names neither (null company_id)."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.expr("CAST(array() AS array<string>)")))
    rows = companies.select(F.col("id").cast("long").alias("id"), "name", F.posexplode(every).alias("pos", "raw")).select("id", "name", "pos", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "").alias("spelling"))
    rows = rows.filter(F.length("spelling") >= LEAST_NAME).withColumn("key", F.lower("spelling"))
    one = rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max_by(F.struct("name", "spelling"), "pos").alias("s"))
    return one.select("key", F.when(F.col("a") == F.col("b"), F.col("a")).alias("company_id"), "s.name", "s.spelling")


def _mentions(text: str, entries: list[dict]) -> list[tuple]:
    """Left to right, the longest spelling at each place; an ordinary or short name needs its own casing and a cue near it."""
    known = {e["key"]: e for e in entries}
    sizes, at, found = {}, 0, {}  # lengths of the spellings, the longest first, by their first word; of those led by a sign under ""
    for k in sorted(known, key=len, reverse=True):
        sizes.setdefault(_first_word(k) if _inner(k[0]) else "", {})[len(k)] = None
    for m in re.finditer(r"\w+|[^\w\s]" if "" in sizes else r"\w+", text):
        s = m.start()
        fit = sizes.get(_first_word(m[0]))
        if not fit or s < at or (s and (text[s - 1] == "." or _inner(text[s - 1]))):
            continue
        hit = next((text[s : s + n] for n in fit if s + n <= len(text) and not (s + n < len(text) and _inner(text[s + n])) and text[s : s + n].lower() in known), None)
        if hit is None:
            continue
        at, e = s + len(hit), known[hit.lower()]
        if e["company_id"] is None or pd.isna(e["company_id"]):
            continue
        plain = e["key"] not in ORDINARY and len(e["key"]) > SHORT_NAME
        if not plain and (hit != e["spelling"] or not re.search(CUE, text[max(0, s - CUE_WINDOW) : at + CUE_WINDOW], re.IGNORECASE)):
            continue
        found.setdefault(e["company_id"], [int(e["company_id"]), e["name"], hit, 0, s, plain])[3] += 1
    return sorted(map(tuple, found.values()), key=lambda m: (not m[5], -m[3], m[4], -len(m[2])))


def find_mentions(docs: DataFrame, companies: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """A row for each document (unique doc_id, text) and company (id, name, aliases) named in it; rank 1 is the likeliest subject.

    Spellings are entered by their first two words; a text is searched only for those entered by words at places where a name may start. Up to ``broadcast``
    spellings, by their first word, are sent to every task and each text is read once. Of more, none travels to every task: documents' distinct one and two words meet them in
    an equi-join, and texts with a hit are joined with the few spellings they may hold. Null or empty texts and names give no rows.
    """
    index = spellings(companies).withColumn("anchor", _anchor_of("key"))
    few, held = index.limit(broadcast + 1).collect(), {}
    for r in few:
        held.setdefault(_first_word(r["key"]), []).append(r.asDict())

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                entries = [e for w in {"", *map(_first_word, set(re.findall(r"\w+", text)))} for e in held.get(w, ())]
                out += [(i, *m, r + 1) for r, m in enumerate(_mentions(text, entries))] if entries else []
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MENTION.split(", ")])

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                held = _anchors(text, _places(text)[0].tolist())
                yield pd.DataFrame({"doc_id": i, "anchor": list(held)}, columns=["doc_id", "anchor"]).astype({"doc_id": "int64", "anchor": object})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *m, r + 1) for i, text, entries in zip(pdf["doc_id"], pdf["text"], pdf["entries"], strict=True) for r, m in enumerate(_mentions(text, entries))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MENTION.split(", ")])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") >= LEAST_NAME)
    if len(few) <= broadcast:
        return texts.mapInPandas(whole, MENTION)
    hits = texts.mapInPandas(runs, "doc_id long, anchor string").join(index, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("key", "company_id", "name", "spelling")).alias("entries"))
    return texts.join(hits, "doc_id").mapInPandas(scan, MENTION)


def route_events(events: DataFrame, companies: DataFrame) -> DataFrame:
    """Events (event_id, title, context, company_id) with the company they are about: the attached one, else the best mention that starts within the title.

    The context supplies cues and counts but never the subject. Events about no tracked company go.
    """
    title = F.coalesce("title", F.lit(""))
    loose = events.filter(F.col("company_id").isNull()).select(F.col("event_id").alias("doc_id"), F.concat(title, F.lit("\n"), F.coalesce("context", F.lit(""))).alias("text"))
    size = events.select(F.col("event_id").alias("doc_id"), F.length(title).alias("size"))
    named = find_mentions(loose, companies).join(size, "doc_id").filter(F.col("first_position") < F.col("size"))
    subject = named.groupBy("doc_id").agg(F.min_by("company_id", "rank").alias("__tm_subject"))
    rows = events.join(subject, events["event_id"] == subject["doc_id"], "left").withColumn("company_id", F.coalesce("company_id", "__tm_subject"))
    return rows.filter(F.col("company_id").isNotNull()).select(*events.columns)
