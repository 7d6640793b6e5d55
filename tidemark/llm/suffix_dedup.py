"""Removal of repeated substrings by anchors and buckets of equal bytes; exact, but not bucket-pointer refinement: no suffixes are sorted.

A window is ``LENGTH`` bytes. Each has one anchor, the place of its least q-gram hash, so equal windows have equal anchors in
equal places and only anchors (about one byte in 80) are put in buckets. Neighbouring windows with one anchor are a run. The
initial bucket of a run is its anchor's q-gram. Buckets with one run are done: its windows occur once. In the others runs of wholly
equal bytes are one class, and a class of two or more is done: all its windows repeat. Where classes meet in one bucket (near the ends
of repeated passages), one run of each brings its bytes, and its windows are compared in the bucket. A bucket of more than
``BUCKET`` classes is refined instead: each run is cut into cells by the windows' offset from the anchor, and goes on in buckets named by
its bucket and the bytes all windows of the cell share, at half the cell width each time; at width 1 a bucket is one window. No
bucket is capped. Texts travel compressed, and only to meet their own runs.

Defined results: null or empty text keeps nothing and loses nothing (0 bytes); repeated rows are documents of their own, so all
bytes of two equal texts of LENGTH bytes or more go from both; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, lookup, materialise, parts

LENGTH = 200
GRAM = 40
BUCKET = 2000
#: Bytes of text looked at in one go; longer texts are looked at piece by piece.
CHUNK = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWER: dict[str, np.ndarray] = {}
RUN = "doc_id long, th long, at long, rep long, kh long, sh long"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if "up" not in _POWER or len(_POWER["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.ones(1, np.uint64)
            while len(p) < n:
                p = np.concatenate([p, p * (p[-1:] * np.uint64(base))])
            _POWER[name] = p
    return _POWER["up"][:n], _POWER["down"][:n]


def gram_order(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A pseudo-random number for the q-gram at each place; it only orders places, equality is never read from it."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of each run in the joined texts; starts: where each text begins, and the end."""
    w, n = length - gram + 1, len(data) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    low = np.uint64((1 << 24) - 1)
    h = (gram_order(data, gram) & ~low) | np.arange(len(data) - gram + 1, dtype=np.uint64)  # the leftmost of equals
    padded = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & low).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    ok = np.diff(starts) >= length
    np.add.at(inside, starts[:-1][ok], 1)
    np.add.at(inside, starts[1:][ok] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    ends = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    return first, ends, anchor[first]


def _hash(x: bytes, seed: int = 0) -> int:
    h = xxhash.xxh3_64_intdigest(x, seed)
    return h - (1 << 64) if h >> 63 else h


def _pack(first: int, n: int, back: int) -> int:
    """Place of a run: first window, number of windows, how far its anchor lies behind the first window."""
    return first << 16 | (n - 1) << 8 | back


def _unpack(at: int) -> tuple[int, int, int]:
    return at >> 16, (at >> 8 & 255) + 1, at & 255


def anchored(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """RUN rows of all documents: kh names the bucket, sh the bytes of the run's windows (and where the anchor lies in them), rep how many equal runs follow each other."""

    def some(held: list[tuple]) -> Iterator[tuple]:
        joined = b"".join(x[3] for x in held)
        starts = np.cumsum([0, *(len(x[3]) for x in held)])
        first_, last_, anchor = runs(np.frombuffer(joined, np.uint8), starts, length, gram)
        text = np.searchsorted(starts, first_, side="right") - 1
        same, row = None, None  # runs of equal bytes that follow each other, as in periodic text, are one row
        for first, last, a, k in zip(first_.tolist(), last_.tolist(), anchor.tolist(), text.tolist(), strict=True):
            sh = _hash(joined[first : last + length], a - first)
            if same == (k, sh, last - first, first):
                row[3] += 1
            else:
                if row:
                    yield tuple(row)
                doc, th, shift, _ = held[k]
                row = [doc, th, _pack(first - int(starts[k]) + shift, last - first + 1, a - first), 1, _hash(joined[a : a + gram]), sh]
            same = k, sh, last - first, last + 1
        if row:
            yield tuple(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for doc, th, t in zip(b["doc_id"].to_pylist(), b["th"].to_pylist(), b["text"].cast(pa.binary()), strict=True):
                raw = t.as_py()
                for s in range(0, max(1, len(raw) - length + 1), CHUNK):
                    held.append((doc, th, s, raw[s : s + CHUNK + length - 1]))
                    size += len(held[-1][3])
                    if size >= CHUNK:
                        yield _batch(some(held))
                        held, size = [], 0
            if held:
                yield _batch(some(held))

    def _batch(rows: Iterator[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "th", "at", "rep", "kh", "sh"])

    return id_and_text(docs).withColumn("th", F.xxhash64("text")).mapInArrow(run, RUN)


def compressed(docs: DataFrame) -> DataFrame:
    """doc_id, th, z: UTF-8 text, compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["th"], pa.array([pack.compress(t.as_buffer().to_pybytes()) for t in b["text"].cast(pa.binary())], pa.binary())], ["doc_id", "th", "z"])

    return id_and_text(docs).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, z binary")


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows kh, sh, need, ...: classes (kh, sh) with two or more members; and of buckets still open one row of each class.

    A row that needs no answer stands for a class that has one. A bucket is open if a class of one needs an answer and another class is there.
    """
    who = F.struct(*[c for c in rows.columns if c not in ("kh", "sh", "need", "rep")])
    c = rows.groupBy("kh", "sh").agg(F.sum("rep").alias("n"), F.count("*").alias("rows"), F.min(who).alias("who"), F.min("need").alias("need"))
    c = materialise(c.withColumn("need", F.col("need") & (F.col("n") == 1)), "classes")
    open_ = c.groupBy("kh").agg(F.count("*").alias("classes"), F.count("*").alias("n"), F.max("need").alias("any")).filter("classes > 1 and any")
    return c.filter("n > 1").select("kh", "sh", "rows"), lookup(c.drop("n"), open_, ["kh"], "n", c.count()).select("kh", "sh", "need", "classes", "who.*")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """doc_id, th, start, end (bytes): spans, overlapping or not, that together cover the windows which occur more than once."""
    spark, n_parts = docs.sparkSession, parts(docs.sparkSession)
    windows = (F.shiftright("at", 8).bitwiseAND(255) + 1) * F.col("rep")
    span = lambda df: df.select("doc_id", "th", F.shiftright("at", 16).alias("start"), (F.shiftright("at", 16) + windows - 1 + length).alias("end"))
    all_runs = materialise(anchored(docs, length, gram), "anchors")
    shared = all_runs.groupBy("kh").agg(F.count("*").alias("n"), F.sum("rep").alias("of")).filter("of > 1").select("kh", "n")
    rows = materialise(lookup(all_runs, shared, ["kh"], "n", all_runs.count()), "runs")
    done, open_ = _classes(rows.withColumn("need", F.lit(True)))
    found = [span(lookup(rows, done, ["kh", "sh"], "rows", rows.count(), "left_semi"))]

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for doc, th, z, members in zip(*(b[c].to_pylist() for c in ("doc_id", "th", "z", "members")), strict=True):
                text = unpack.decompress(z)
                for m in members:
                    first, n, _ = _unpack(m["at"])
                    out.append((m["kh"], m["sh"], m["need"], m["classes"], doc, th, m["at"], text[first : first + n - 1 + length]))
                    if len(out) >= 20_000:
                        yield _member_batch(out)
                        out = []
            yield _member_batch(out)

    members = open_.groupBy("doc_id", "th").agg(F.collect_list(F.struct("kh", "sh", "need", "classes", "at")).alias("members"))
    z = compressed(docs)
    cond = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    brought = z.join(members, cond(z, members)).select(z["doc_id"], z["th"], "z", "members").mapInArrow(bring, MEMBER)
    width, rows = 256, materialise(brought, "members")
    while True:
        small = rows.filter(F.col("classes") <= bucket)
        dealt = small.repartition(n_parts, "kh").sortWithinPartitions("kh")
        found.append(dealt.mapInArrow(lambda b, length=length: _compare(b, length), SPAN))
        big = rows.filter(F.col("classes") > bucket)
        if big.isEmpty():
            break
        width //= 2
        cells = materialise(big.mapInArrow(lambda b, length=length, width=width: _cells(b, length, width), MEMBER).drop("classes").withColumn("rep", F.lit(1).cast("long")), "cells")
        done, rows = _classes(cells)
        found.append(span(lookup(cells.filter("need"), done, ["kh", "sh"], "rows", cells.count(), "left_semi")))
        rows = materialise(rows.select("kh", "sh", "need", "classes", "doc_id", "th", "at", "bytes"), "members")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


MEMBER = "kh long, sh long, need boolean, classes long, doc_id long, th long, at long, bytes binary"
SPAN = "doc_id long, th long, start long, end long"
_MEMBER_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_MEMBER_NAMES = [x.split()[0] for x in MEMBER.split(", ")]


def _member_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _MEMBER_TYPES, strict=True)], _MEMBER_NAMES)


def _cells(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Cuts runs by the offset of windows from the anchor into cells of ``width`` offsets, with the bytes a whole cell shares in the bucket's name."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            first, n, back = _unpack(r["at"])  # windows first .. first + n - 1 have offsets back .. back - n + 1
            for cell in range((back - n + 1) // width, back // width + 1):
                high, low = min(back, cell * width + width - 1), max(back - n + 1, cell * width)
                s = back - high  # first window of the cell, from the run's first
                part = r["bytes"][s : s + high - low + length]
                # all windows of the cell share what lies from its least offset's window start to its greatest offset's window end
                shared = r["bytes"][back - cell * width : max(0, back - (cell * width + width - 1) + length)]
                key = _hash(b"%d %d " % (r["kh"], cell) + shared)
                out.append((key, _hash(part, high), r["need"], 0, r["doc_id"], r["th"], _pack(first + s, high - low + 1, high), part))
        yield _member_batch(out)


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of the windows that occur in two classes of one bucket, for the runs that need an answer; rows come bucket by bucket."""

    def bucket(members: list[dict]) -> Iterator[tuple]:
        distinct = {m["sh"]: m for m in members}.values()  # a repeated row may have brought its class twice
        seen: dict[int, int] = {}
        digest = xxhash.xxh3_64_intdigest
        hashes = []
        for m in distinct:
            x = m["bytes"]
            hashes.append([digest(x[i : i + length]) for i in range(len(x) - length + 1)])
            for h in hashes[-1]:
                seen[h] = seen.get(h, 0) + 1
        for m, own in zip(distinct, hashes, strict=True):
            if m["need"]:
                first = _unpack(m["at"])[0]
                start = None
                for i, h in enumerate([*own, None]):
                    twice = h is not None and seen[h] > 1
                    if twice and start is None:
                        start = i
                    elif not twice and start is not None:
                        yield m["doc_id"], m["th"], first + start, first + i - 1 + length
                        start = None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "th", "start", "end"])

    members: list[dict] = []
    for b in batches:
        out = []
        for r in b.to_pylist():
            if members and r["kh"] != members[0]["kh"]:
                out += bucket(members)
                members = []
            members.append(r)
        yield batch(out)
    if members:
        yield batch(list(bucket(members)))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end in bytes: the maximal removed runs), kept (binary: the other bytes joined)."""
    spans = repeated_spans(docs, length, gram, bucket).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # a set: repeated rows have equal spans
    z = compressed(docs)
    both = z.join(spans, z["doc_id"].eqNullSafe(spans["doc_id"]) & (z["th"] == spans["th"]), "left").select(z["doc_id"], "z", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            n, cut, kept = [], [], []
            for z_, found in zip(b["z"].to_pylist(), b["spans"].to_pylist(), strict=True):
                text = unpack.decompress(z_)
                gone = merged([(x["start"], x["end"]) for x in found or ()])
                n.append(len(text))
                cut.append([{"start": s, "end": e} for s, e in gone])
                kept.append(b"".join(text[s:e] for s, e in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(text)], strict=True)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
