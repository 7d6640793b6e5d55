"""Packing documents into training sequences, balanced by attention cost.

A task tokenizes its documents and cuts them: whole sequences of ``size`` tokens stand alone; what is left is cut at a
multiple of ``GRAIN`` so that large pieces share few lengths and small ones fill gaps. Pieces are dealt by a content hash to
groups of some thousands. Within a group, in descending length, each piece goes to the sequence of least estimated cost
(tokens + tokens * piece length / QUADRATIC, summed) with room for it; a new sequence opens where none has room. Only piece
descriptions are shuffled; ids never are.

Defined results: null or empty text is the end id alone; repeated rows are packed each on their own (those of one task in different groups); an empty table gives an
empty table; extra columns are ignored. A sequence longer than ``size`` never occurs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .tokens import encoded, encoder

TOKENIZER = "byte_bpe_50k.json"
SIZE = 2048
GRAIN = 256
#: Documents in a group, about.
GROUP = 4096
#: Tokens of context at which attention costs as much as everything linear.
QUADRATIC = 4096.0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: nth tells equal documents of one task apart, so that the rows of a document that is repeated many times are dealt to many groups.
_DEALT = PIECES + ", __tm_nth long"
PACKED = PIECES + ", sequence_id long, offset long"


def cuts(n: int, size: int = SIZE, grain: int = GRAIN) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    whole, rest = n // size, n % size
    lengths = [size] * whole + [x for x in (rest - rest % grain, rest % grain) if x]
    return list(zip(np.cumsum([0, *lengths[:-1]]).tolist(), lengths, strict=True)) if lengths else []


def cost(lengths: np.ndarray, quadratic: float = QUADRATIC) -> np.ndarray:
    """Estimated cost of attention within each piece and of all that is linear in it."""
    x = np.asarray(lengths, float)
    return x + x * x / quadratic


def assign(lengths: np.ndarray, size: int = SIZE, quadratic: float = QUADRATIC) -> np.ndarray:
    """Sequence of each piece; lengths descend and are at most size."""
    lengths = np.asarray(lengths, np.int64)
    n = max(1, -(-int(lengths.sum()) // size))
    room, spent = np.full(len(lengths) + n, size), np.zeros(len(lengths) + n)
    out, price = np.empty(len(lengths), np.int64), cost(lengths, quadratic)
    for i, x in enumerate(lengths):
        at = int(np.argmin(np.where(room[:n] >= x, spent[:n], np.inf)))
        if room[at] < x:
            at, n = n, n + 1
        room[at] -= x
        spent[at] += price[i]
        out[i] = at
    return out


def _pieces(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SIZE, grain: int = GRAIN) -> DataFrame:
    """A row for each piece of each document, the end id included, and which of its equals in its task it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(tokenizer), {}
        for b in batches:
            rows = []
            for doc, ids in zip(b["doc_id"].to_pylist(), encoded(enc, b["text"]), strict=True):
                nth = seen[doc, len(ids)] = seen.get((doc, len(ids)), -1) + 1
                rows += [(doc, s, n, zlib.crc32(ids[s : s + n]), len(ids), nth) for s, n in cuts(len(ids), size, grain)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)], [c.split()[0] for c in _DEALT.split(", ")])

    return id_and_text(docs).mapInArrow(run, _DEALT)


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SIZE, grain: int = GRAIN) -> DataFrame:
    """A row for each piece of each document, the end id included."""
    return _pieces(docs, tokenizer, size, grain).drop("__tm_nth")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SIZE, grain: int = GRAIN, group: int = GROUP, quadratic: float = QUADRATIC) -> DataFrame:
    """The pieces with sequence_id and offset in the sequence."""
    groups = max(1, -(-docs.count() // group))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = int(pdf["__tm_group"].iloc[0])
        pdf = pdf.drop(columns=["__tm_group", "__tm_nth"]).sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        n = pdf["length"].to_numpy()
        full = int((n == size).sum())
        pdf["sequence_id"] = (key << 31) + np.concatenate([np.arange(full), full + assign(n[full:], size, quadratic)]).astype(np.int64)
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf

    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "__tm_nth"), F.lit(groups))
    return _pieces(docs, tokenizer, size, grain).withColumn("__tm_group", key).groupBy("__tm_group").applyInPandas(run, PACKED)
