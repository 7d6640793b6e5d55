"""Product codes of vectors by ball k-means.

Vectors are cut into equal parts; each part position has a codebook of integer entries. An entry with the parts assigned to
it is a ball. After a round the entry's new place and its ball's radius (largest distance of the round, plus the entry's own
shift) tell its neighbours: the only entries that can lie nearer to one of its parts, at most two radii away. A part stays
without any work if neither its entry nor one of its neighbours moved, and without a search if it lies in the stable core (closer
to its entry than half the way to the nearest neighbour). Others lie in annular rings: with neighbours in order of distance,
a part at distance d is compared only with those at most 2 d away. All of that is decided in exact integers, equality
included, so codes equal those of a full search, ties to the lower index.

A round is two passes over a table of integer parts with their codes and distances: one assigns, one adds up each task's sums, counts
and largest distances. Only the codebooks (parts x entries x width numbers) and their sums reach the driver.

Defined results: rows whose vector is null or holds a null or a non-finite component go; null ids stay and are ordered last;
repeated ids and rows stay, ordered by id, then by bytes of their integers, where the first entries are chosen;
vectors shorter than the longest (or than a multiple of the number of parts) are padded with zeros; integers are held within a bound
at which squares fit 64 bits (2^28 for parts of 16); fewer rows than entries give a smaller codebook;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, write_step

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that are assigned at once.
CHUNK = 1 << 15
_STATE = "vec_id long, label string, v binary, code binary, dist binary"


def dense(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat components in double precision (null: NaN), the length of each row, and which rows are whole: not null, all finite."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    there = col.is_valid().to_numpy(zero_copy_only=False)
    size = np.where(there, pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.bincount(np.repeat(np.arange(len(size)), size), ~np.isfinite(flat), minlength=len(size)) > 0
    return flat, size, there & ~bad


def integer_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label (as a string), v (floor(scale * x) as little-endian 32-bit integers) of the rows whose vector is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, size, whole = dense(b["embedding"])
            with np.errstate(invalid="ignore", over="ignore"):
                ints = np.clip(np.nan_to_num(np.floor(flat * scale)), -(2**31), 2**31 - 1).astype("<i4")
            ends = np.cumsum(size)
            v = [ints[e - n : e].tobytes() for e, n, w in zip(ends, size, whole, strict=True) if w]
            keep = pa.array(whole)
            yield pa.RecordBatch.from_arrays([b["vec_id"].filter(keep), b["label"].filter(keep), pa.array(v, pa.binary())], ["vec_id", "label", "v"])

    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return rows.mapInArrow(run, "vec_id long, label string, v binary")


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries: by a product of doubles where every term is an exact integer, else by 64-bit integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * max(x.shape[1], 1) * most * most < 2**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in c], 1)


class Balls:
    """A part position's codebook and, from the last round, each entry's neighbours in order of distance."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None, far: np.ndarray | None = None):
        """far: largest squared distance of a part to its entry in the last round, -1 for an unused entry."""
        self.entries, self.first = entries, before is None
        if self.first:
            return
        shift = ((entries - before) ** 2).sum(1)
        self.moved = shift > 0
        apart = squares(entries, entries)
        self.near, self.gap, self.still = [], [], np.zeros(len(entries), bool)
        for i in range(len(entries)):
            radius = math.isqrt(int(far[i])) + math.isqrt(int(shift[i])) + 2 if far[i] >= 0 else -1
            order = np.argsort(apart[i], kind="stable")
            order = order[(order != i) & (apart[i][order] <= 4 * radius * radius if radius >= 0 else False)]
            self.near.append(order)
            self.gap.append(apart[i][order])
            self.still[i] = not self.moved[i] and not self.moved[order].any()
        self.core = np.array([g[0] if len(g) else np.iinfo(np.int64).max for g in self.gap], np.int64)

    def assign(self, x: np.ndarray, code: np.ndarray | None, dist: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each row and the squared distance; code and dist are those of the last round."""
        if self.first:
            all_ = squares(x, self.entries)
            code = all_.argmin(1)
            return code, all_[np.arange(len(x)), code]
        code, dist = code.copy(), dist.copy()
        gone = self.moved[code]
        dist[gone] = ((x[gone] - self.entries[code[gone]]) ** 2).sum(1)
        rest = np.flatnonzero(~self.still[code] & (4 * dist >= self.core[code]))
        rest = rest[np.argsort(code[rest], kind="stable")]
        own = code[rest]
        cuts = np.flatnonzero(np.diff(own)) + 1
        for rows in np.split(rest, cuts) if len(rest) else ():
            self._ring(x, code, dist, rows, int(code[rows[0]]))
        return code, dist

    def _ring(self, x: np.ndarray, code: np.ndarray, dist: np.ndarray, rows: np.ndarray, i: int) -> None:
        """The rows of entry i against the neighbours within twice their distance, rings of like size together."""
        ring = np.searchsorted(self.gap[i], 4 * dist[rows], side="right")
        least = 0
        while len(rows) and least < ring.max():
            most = max(8, 2 * least)
            now = (ring > least) & (ring <= most)
            if now.any():
                r, k = rows[now], ring[now]
                near = self.near[i][: k.max()]
                by_index = np.argsort(np.append(near, i))
                entry, rank = np.append(near, i)[by_index], np.append(np.arange(len(near)), -1)[by_index]
                d = squares(x[r], self.entries[entry])
                d[rank[None, :] >= k[:, None]] = np.iinfo(np.int64).max
                best = d.argmin(1)
                code[r], dist[r] = entry[best], d[np.arange(len(r)), best]
            least = most


class Coder:
    """Reads integer parts and assigns them, a chunk at a time."""

    def __init__(self, width: int, parts: int, balls: list[Balls]):
        self.width, self.parts, self.balls = width, parts, balls
        self.bound = math.isqrt(2**60 // max(width // parts, 1))

    def matrix(self, v: pa.Array) -> np.ndarray:
        """Integers of the rows, padded with zeros."""
        out = np.zeros((len(v), self.width), np.int64)
        raw = [np.frombuffer(x.as_buffer(), "<i4") if x.is_valid else np.empty(0, "<i4") for x in v]
        size = np.array([len(r) for r in raw], np.int64)
        if len(raw):
            row = np.repeat(np.arange(len(raw)), size)
            out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.concatenate(raw)
        return np.clip(out, -self.bound, self.bound)

    def codes(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        n = len(b)
        return tuple(np.frombuffer(b"".join(b[c].to_pylist()), t).reshape(n, self.parts) for c, t in (("code", np.uint8), ("dist", "<i8")))

    def assigned(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x, d = self.matrix(b["v"]), self.width // self.parts
        before = self.codes(b) if "code" in b.schema.names else None
        pairs = [ball.assign(x[:, p * d : (p + 1) * d], *((before[0][:, p].astype(np.int64), before[1][:, p]) if before else (None, None))) for p, ball in enumerate(self.balls)]
        return np.stack([c for c, _ in pairs], 1).astype(np.uint8), np.stack([e for _, e in pairs], 1).astype("<i8")

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """part, entry, n, far, at, s: a task's counts, largest distances and sums of each component."""
        d, entries = self.width // self.parts, len(self.balls[0].entries)
        n, far, s = np.zeros((self.parts, entries), np.int64), np.full((self.parts, entries), -1), np.zeros((self.parts, entries, max(d, 1)), np.int64)
        for b in batches:
            if not len(b):
                continue
            x, (code, dist) = self.matrix(b["v"]), self.codes(b)
            for p in range(self.parts):
                c = code[:, p].astype(np.int64)
                n[p] += np.bincount(c, minlength=entries)
                np.maximum.at(far[p], c, dist[:, p])
                np.add.at(s[p], c, x[:, p * d : (p + 1) * d] if d else 0)
        p, e = np.nonzero(n)
        rows = [np.repeat(p, s.shape[2]), np.repeat(e, s.shape[2]), np.repeat(n[p, e], s.shape[2]), np.repeat(far[p, e], s.shape[2]), np.tile(np.arange(s.shape[2]), len(p)), s[p, e].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)) for r in rows], ["part", "entry", "n", "far", "at", "s"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Larger batches: an entry's ring is one product for all its rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _assign(rows: DataFrame, coder: Coder) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            code, dist = coder.assigned(b)
            made = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (code, dist)]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["v"], *made], ["vec_id", "label", "v", "code", "dist"])

    return rows.mapInArrow(run, _STATE)


def _moved(state: DataFrame, coder: Coder) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """New entries, floor(sum / count), and each ball's largest squared distance; unused entries stay."""
    each = state.select("v", "code", "dist").mapInArrow(coder.sums, "part long, entry long, n long, far long, at long, s long")
    got = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    entries, far = [b.entries.copy() for b in coder.balls], [np.full(len(b.entries), -1) for b in coder.balls]
    for r in got.collect():  # parts x entries x width rows
        far[r.part][r.entry] = r.far
        if r.at < entries[r.part].shape[1]:
            entries[r.part][r.entry, r.at] = int(r.s) // r.n
    return entries, far


def fit_and_encode(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (a byte for each part), error (squared distances summed over parts) of every whole vector; and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: at most 256 entries")
    spark = table.sparkSession
    rows, path = write_step(integer_vectors(table, scale), "integers")
    width = -(-((rows.agg(F.max(F.length("v"))).first()[0] or 0) // 4) // parts) * parts
    coder = Coder(width, parts, [])
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start, d = coder.matrix(pa.array([bytes(r.v) for r in first], pa.binary())), width // parts
    balls = [Balls(start[:, p * d : (p + 1) * d]) for p in range(parts)]
    for _ in range(rounds if first else 0):
        state, now = write_step(_assign(rows, Coder(width, parts, balls)), "codes")
        discard(spark, path)
        rows, path = state, now
        moved, far = _moved(rows, Coder(width, parts, balls))
        balls = [Balls(e, b.entries, f) for e, b, f in zip(moved, balls, far, strict=True)]
    coder = Coder(width, parts, balls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            code, dist = coder.assigned(b)
            made = [pa.array([r.tobytes() for r in code], pa.binary()), pa.array(dist.sum(1))]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], *made], ["vec_id", "label", "code", "error"])

    out, _ = write_step(rows.mapInArrow(run, "vec_id long, label string, code binary, error long"), "coded")
    discard(spark, path)
    return out, np.stack([b.entries for b in balls])


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error (errors summed over equal labels, nulls together), codebooks_sha256."""
    out, books = fit_and_encode(table, parts, entries, rounds, scale)
    keyed = out.withColumns({"__tm_none": F.col("label").isNull(), "__tm_label": F.coalesce("label", F.lit(""))})
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long")
    sums = keyed.groupBy("__tm_none", "__tm_label").agg(F.count("*").alias("__tm_n"), total.alias("label_error"))
    both = lookup(keyed, sums, ["__tm_none", "__tm_label"], "__tm_n", out.count())
    return both.select("vec_id", "label", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
