"""Quality rules under weak supervision.

Rules read a document's counts and vote good (+1), bad (-1) or abstain (0). The corpus is summarised as the number of
documents with each vote vector (at most 3 ** rules rows, whatever its size); expectation-maximisation on that table
estimates each rule's accuracy and the share of good documents, and a document's verdict is the posterior probability of
good given its votes. Documents that fail the base rules are never kept.

Defined results: null or blank text has no words and fails; a document on which every rule abstains gets the estimated share of
good documents as its posterior; repeated rows count and are judged each; an empty table gives an empty table; extra columns are
ignored (``apply`` returns them unchanged).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialise

SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: A rule is never taken to be right less often than this when it votes; it names the classes good and bad.
LEAST = 0.55
#: A document is kept from this posterior on.
KEEP = 0.5
#: Words of a stretch in which distinct words are counted, so that the share of distinct words doesn't fall with a text's length.
STRETCH = 1000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_alpha", "n_digits", "n_ended")


def repeat_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    if len(words) <= size:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    windows, k = ids[: len(ids) - size + 1].copy(), len(number) + 1
    for i in range(1, size):  # renumbered at each step, so that products stay small
        windows = np.unique(windows * k + ids[i : len(ids) - size + 1 + i], return_inverse=True)[1]
    twice = (np.bincount(windows)[windows] > 1).astype(np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(twice)] += twice
    edge[size : size + len(twice)] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def counts(text: str) -> tuple[int, ...]:
    """COUNTS of one text."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    digits = sum(raw.count(c) for c in (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))
    punctuation = sum(raw.count(c) for c in (b".", b",", b"!", b"?", b"-", b"_", b"(", b")", b"[", b"]", b"{", b"}", b"=", b'"', b"'", b":", b";", b"/", b"@", b"+"))
    ended = sum(x.rstrip().endswith((b".", b"!", b"?", b'"')) for x in lines)
    chars = len(text) - blanks
    distinct = sum(len(set(words[i : i + STRETCH])) for i in range(0, len(words), STRETCH))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines), distinct, chars - symbols - digits - punctuation, digits, ended


def features(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and COUNTS, on disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts(t.as_py()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["th"], *(pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(COUNTS)))], ["doc_id", "th", *COUNTS])

    schema = "doc_id long, th long, " + ", ".join(f"{c} long" for c in COUNTS)
    return materialise(id_and_text(docs).withColumn("th", F.xxhash64("text")).mapInArrow(run, schema), "quality")


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """A vote for each rule, from COUNTS; without words all abstain."""
    symbols, letters, digits = _share("n_symbols", "word_chars"), _share("n_alpha", "word_chars"), _share("n_digits", "word_chars")
    dup, repeat, ended = _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words"), _share("n_ended", "n_lines")
    variety, length, n = _share("n_distinct", "n_words"), _share("word_chars", "n_words"), F.col("n_words")
    no = F.lit(False)
    prose = (symbols <= 0.01) & (letters >= 0.85) & (ended >= 0.6) & (repeat <= 0.35)
    varied = (variety >= 0.3) & (repeat <= 0.3) & (dup <= 0.05) & (symbols <= 0.04)
    votes = {
        "symbols": _vote(no, symbols > 0.04),
        "letters": _vote(no, letters < 0.85),
        "digits": _vote(no, digits > 0.3),
        "dup_lines": _vote(no, dup > 0.35),
        "repeats": _vote(no, repeat > 0.4),
        "variety": _vote(no, variety < 0.15),
        "word_length": _vote(no, (length < 2.5) | (length > 11)),
        "line_ends": _vote(no, ended < 0.4),
        "prose": _vote(prose, ~prose),
        "varied": _vote(varied, ~varied),
    }
    return {k: F.when(n > 0, v).otherwise(0) for k, v in votes.items()}


def em(votes: np.ndarray, weight: np.ndarray, rounds: int = 500, prior: float = 4.0) -> tuple[float, np.ndarray]:
    """Share of good documents, and each rule's accuracy: the chance that it is right when it votes.

    votes: distinct vectors of -1, 0, 1; weight: documents with each. ``prior`` pseudo-votes hold each accuracy near 0.8.
    """
    share, right = 0.8, np.full(votes.shape[1], 0.8)
    good, bad = votes == 1, votes == -1
    for _ in range(rounds):
        p = posterior(votes, share, right)
        new = (weight @ p + 0.8 * prior) / (weight.sum() + prior)
        right = ((weight * p) @ good + (weight * (1 - p)) @ bad + 0.8 * prior) / (weight @ (good | bad) + prior)
        right = np.maximum(right, LEAST)
        if abs(new - share) < 1e-10:
            break
        share = new
    return float(share), right


def posterior(votes: np.ndarray, share: float, right: np.ndarray) -> np.ndarray:
    """Probability of good for each vote vector."""
    right = np.clip(right, 1e-6, 1 - 1e-6)
    odds = np.log(share / (1 - share)) + votes @ np.log(right / (1 - right))
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def verdicts(rows: DataFrame, keep: float = KEEP) -> DataFrame:
    """``features`` rows with base_failed, quality (posterior) and kept."""
    names = list(rules())
    rows = rows.select("*", F.array(*[v for v in rules().values()]).alias("__tm_votes"))
    table = rows.groupBy("__tm_votes").count().collect()  # at most 3 ** rules rows
    votes = np.array([r[0] for r in table], float).reshape(-1, len(names))
    weight = np.array([r[1] for r in table], float)
    p = posterior(votes, *em(votes, weight)) if len(table) else np.empty(0)
    flat = list(itertools.chain.from_iterable((F.lit("".join(str(int(x) + 1) for x in v)), F.lit(float(q))) for v, q in zip(votes, p, strict=True)))
    code = F.concat(*[(F.col("__tm_votes")[i] + 1).cast("string") for i in range(len(names))])
    quality = F.try_element_at(F.create_map(*flat), code) if flat else F.lit(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("quality", quality)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep)).drop("__tm_votes")


def judge(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, th, COUNTS, base_failed, quality, kept: a row for each document."""
    return verdicts(features(docs), keep)


def apply(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents that are kept, with their own columns."""
    kept = judge(docs, keep).filter("kept").select(F.col("doc_id").alias("__tm_id"), F.col("th").alias("__tm_th")).distinct()
    th = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    # keys grow with the documents, so they are shuffled at every size
    return docs.join(kept.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(kept["__tm_id"]) & (th == kept["__tm_th"]), "left_semi")
