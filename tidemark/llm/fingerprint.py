"""Document fingerprints from prefix polynomial hashes.

``Prefix`` holds, for one text, the hashes of all its prefixes modulo two primes as numpy arrays: any span's hash is a
difference of two entries scaled by a power, so equality of any two spans takes constant time and the longest common
extension from any two places a binary search. A fingerprint keeps the whole text's hash and, at up to ``GRID`` places that are
multiples of a power of two, the hashes of the prefix and of the suffix of that length. Two fingerprints share the
coarser grid, on which binary search finds how far their texts agree from the start and from the end; their likeness
is that length over the longer text's. An edited text's hashes are composed from the prefix arrays of the two texts it is made of.

Defined results: null text is empty; equal texts have equal fingerprints and likeness 1; an empty and another text have
likeness 0; repeated rows have a row each; documents of one id are ordered by their text hash; a table of one document is
followed by itself; null ids come last; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, parts

#: Two primes below 2 ** 31 and a base for each. Fingerprints that are kept depend on them.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
GRID = 32
#: Code points taken at a time; arrays of a whole text have four bytes a code point.
CHUNK = 1 << 20
#: A bucket of neighbouring documents has about so many code points, where that makes more buckets than four a partition.
BUCKET_CHARS = 32 << 20
#: Buckets whose edges the driver holds (a few MB); with so many, buckets of larger tables have more documents, which a task reads as a stream.
BUCKETS = 1 << 17
_POWERS = [np.ones(1, np.uint32) for _ in PRIMES]


def powers(n: int, k: int) -> np.ndarray:
    """BASES[k] ** i modulo PRIMES[k] for i up to n, grown by doubling; up to CHUNK are kept from text to text."""
    p, m = _POWERS[k], np.uint64(PRIMES[k])
    while len(p) <= n:
        p = np.concatenate([p, (p * (np.uint64(p[-1]) * np.uint64(BASES[k]) % m) % m).astype(np.uint32)])
        if len(p) <= CHUNK:
            _POWERS[k] = p
    return p


class Prefix:
    """Prefix arrays of one text: at[k][i] = sum of (code point j + 1) * base ** j for j < i, modulo prime k."""

    def __init__(self, text: str):
        self.n, self.at = len(text), []
        for k, prime in enumerate(PRIMES):
            p, power, sums = np.uint64(prime), powers(self.n, k), np.zeros(self.n + 1, np.uint32)
            for i in range(0, self.n, CHUNK):
                codes = np.frombuffer(text[i : i + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
                end = i + len(codes)
                sums[i + 1 : end + 1] = (np.cumsum(codes * power[i:end] % p) + np.uint64(sums[i])) % p
            self.at.append(sums)

    def spans(self, start: np.ndarray, end: np.ndarray, shift: int) -> list[np.ndarray]:
        """Hashes of spans, each times base ** (shift - start), so that spans of equal texts agree for one shift."""
        out = []
        for k, prime in enumerate(PRIMES):
            p = np.uint64(prime)
            out.append((self.at[k][end] + p - self.at[k][start]) % p * powers(shift, k)[shift - start] % p)  # p makes them 64 bits wide
        return out

    def span_equal(self, i: int, other: Prefix, j: int, length: int) -> bool:
        shift = max(i, j)
        a, b = self.spans(np.array([i]), np.array([i + length]), shift), other.spans(np.array([j]), np.array([j + length]), shift)
        return all(x[0] == y[0] for x, y in zip(a, b, strict=True))

    def extension(self, i: int, other: Prefix, j: int) -> int:
        """Longest common extension forward from i here and j there."""
        most = min(self.n - i, other.n - j)
        return bisect.bisect_left(range(1, most + 1), True, key=lambda m: not self.span_equal(i, other, j, m))

    def extension_back(self, i: int, other: Prefix, j: int) -> int:
        """Longest common extension backward from just before i here and j there."""
        return bisect.bisect_left(range(1, min(i, j) + 1), True, key=lambda m: not self.span_equal(i - m, other, j - m, m))


def edited(a: Prefix, b: Prefix) -> Prefix:
    """Prefix arrays of text a with its last third replaced by as many (or all) of b's first code points; no text is built."""
    out, cut = Prefix.__new__(Prefix), a.n - a.n // 3
    take = min(a.n // 3, b.n)
    out.n = cut + take
    out.at = []
    for k, prime in enumerate(PRIMES):
        p = np.uint64(prime)
        out.at.append(np.concatenate([a.at[k][: cut + 1], ((a.at[k][cut] + b.at[k][1 : take + 1] * np.uint64(powers(cut, k)[cut]) % p) % p).astype(np.uint32)]))
    return out


def step(n: int) -> int:
    """Distance of the grid's places: the least power of two that needs at most GRID of them."""
    return 1 << max(0, (-(-n // GRID) - 1).bit_length())


def fingerprint(x: Prefix) -> str:
    """n, hash of the whole, then prefix and suffix hashes on the grid; hexadecimal, parted by '-'."""
    at = np.arange(step(x.n), x.n + 1, step(x.n))
    whole = "".join(f"{int(x.at[k][x.n]):08x}" for k in range(2))
    heads = x.at[0][at]
    # of suffixes, as if each stood alone: equal ones agree in texts of any length
    tails = np.array([(int(x.at[0][x.n]) - int(x.at[0][s])) * pow(BASES[0], -s, PRIMES[0]) % PRIMES[0] for s in (x.n - at).tolist()], np.uint64)
    return "-".join([f"{x.n:x}", whole, heads.astype(">u4").tobytes().hex(), tails.astype(">u4").tobytes().hex()])


def likeness(a: str, b: str) -> float:
    """How much of the longer text the two agree on, as far as the fingerprints tell; 0 to 1.

    The greatest of: the leading and trailing agreement; the blocks between neighbouring places of the grid that agree, counted from the
    start; the same from the end. A block's hash is a difference of its ends' hashes, so edits spread over a text cost their blocks alone.
    """
    if a == b:
        return 1.0
    (na, _, ha, ta), (nb, _, hb, tb) = (x.split("-") for x in (a, b))
    na, nb = int(na, 16), int(nb, 16)
    if not min(na, nb):
        return 0.0
    wide = max(step(na), step(nb))
    most, p, blocks, total = min(na, nb) // wide, PRIMES[0], [], 0
    shift = pow(BASES[0], wide, p)
    for x, y, back in ((ha, hb, False), (ta, tb, True)):
        u, v = ([0, *(int(z[8 * k - 8 : 8 * k], 16) for k in range(wide // step(n), len(z) // 8 + 1, wide // step(n)))][: most + 1] for z, n in ((x, na), (y, nb)))
        total += bisect.bisect_left(range(1, most + 1), True, key=lambda m: u[m] != v[m])  # noqa: B023
        blocks.append(sum((a - (c * shift if back else c) - b + (d * shift if back else d)) % p == 0 for c, a, d, b in zip(u, u[1:], v, v[1:], strict=False)))
    return max(min(total, most), *blocks) * wide / max(na, nb)


def _at_least(cut: list[int], x: Column) -> Column:
    """How many of the descending numbers are x or more: found among every so manieth first, then in the stretch behind it."""
    wide = max(1, math.isqrt(len(cut)))
    array = lambda c: F.split(F.lit(",".join(map(str, c))), ",").cast("array<long>") if c else F.expr("cast(array() as array<long>)")
    count = lambda a: F.size(F.filter(a, lambda c: c >= x))
    stretch = F.greatest(count(array(cut[::wide])) - 1, F.lit(0)) * wide
    return stretch + count(F.slice(array(cut), stretch + 1, wide))


def followed(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents dealt to buckets that descend by id; the first document of each later bucket also ends the one before it.

    Columns doc_id, text, th, bucket, own (false for the guest that ends a bucket). Only ids and hashes are gathered to
    find the buckets' edges: a few for each bucket, however many documents there are.
    """
    spark, base = docs.sparkSession, id_and_text(docs).withColumn("th", F.xxhash64("text"))
    size = base.agg(F.sum(F.length("text"))).first()[0] or 0
    most = max(4 * parts(spark), min(size // BUCKET_CHARS, BUCKETS))
    places = F.split(F.lit(",".join(repr(i / most) for i in range(1, most))), ",").cast("array<double>")
    cut = base.filter("doc_id is not null").agg(F.percentile_approx("doc_id", places, 4 * most)).first()[0] or []
    cut = sorted(set(cut), reverse=True)
    # bucket 0 holds the largest ids; null ids lie behind all others, dealt by their text's hash
    bucket = F.when(F.col("doc_id").isNull(), len(cut) + 1 + F.pmod(F.shiftright("th", 58), F.lit(64))).otherwise(_at_least(cut, F.col("doc_id")))
    base = base.withColumn("bucket", bucket.cast("long")).withColumn("own", F.lit(True))
    edges = base.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id"), -F.col("th").cast("decimal(20,0)"))).alias("e")).select("bucket", "e.doc_id", F.expr("cast(-e.col2 as long)").alias("th")).orderBy("bucket").collect()
    if not edges:
        return base, 0
    before = {e["bucket"]: edges[i - 1]["bucket"] for i, e in enumerate(edges)}  # the first bucket's guest closes the last
    guests = spark.createDataFrame([(e["doc_id"], e["th"], before[e["bucket"]]) for e in edges], "e_id long, e_th long, to long")
    lent = base.join(F.broadcast(guests), base["doc_id"].eqNullSafe(F.col("e_id")) & (F.col("th") == F.col("e_th"))).dropDuplicates(["doc_id", "th"])
    lent = lent.select("doc_id", "text", "th", F.col("to").alias("bucket"), F.lit(False).alias("own"))
    return base.unionByName(lent), len(edges)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_edited, common_next.

    The last two: exact lengths of the longest common prefix with the edited and with the next text.
    """
    rows, _ = followed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for bucket, doc, text, own in zip(*(b[c] for c in ("bucket", "doc_id", "text", "own")), strict=True):
                bucket, doc, text, own = bucket.as_py(), doc.as_py(), text.as_py(), own.as_py()
                x = Prefix(text)
                now = (bucket, doc, text, x, fingerprint(x))
                if last and last[0] == bucket:
                    _, d, t, p, fp = last
                    e = edited(p, x)
                    ef = fingerprint(e)
                    made = t[: p.n - p.n // 3] + text[: p.n // 3]
                    out.append((d, p.n, hashlib.sha256(made.encode()).hexdigest(), fp, ef, likeness(fp, ef), likeness(fp, now[4]), p.extension(0, e, 0), p.extension(0, x, 0)))
                last = now if own else None
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited", "common_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"
    dealt = rows.repartition(parts(docs.sparkSession), "bucket").sortWithinPartitions("bucket", F.desc("own"), F.desc_nulls_last("doc_id"), "th")
    return dealt.select("bucket", "doc_id", "text", "own").mapInArrow(run, schema)
