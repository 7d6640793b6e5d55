"""SimHash near-duplicates with a Gray-order hierarchical index.

``fingerprints`` makes 64-bit fingerprints; ``link`` finds all pairs at ``max_bits`` or fewer differing bits among the
*distinct* fingerprints; ``components`` joins links into classes. Two fingerprints that differ in at most 2 bits agree
wholly in one of three bit segments, so each fingerprint is dealt to three buckets (segment, value). A bucket is a small
table sorted by Gray rank, under which upper nodes hold the bits their members share; a query that differs from those
in more than ``max_bits`` bits skips the whole node. Buckets over ``BUCKET`` members are dealt anew by three segments
of the bits still free (the same argument holds), until none is larger: no bucket is capped or sampled.

Defined results: null or blank text has fingerprint 0 and is linked like any other; null doc_ids get a class but
never name one (component_id is null if a class has no id); repeated rows stay, each with its class; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, lookup, materialise, parts

SHINGLE = 3
MAX_BITS = 2
#: Members that one bucket may have before it is dealt anew.
BUCKET = 4096
FANOUT = 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_ALL = (1 << 64) - 1


def simhash(text: bytes, size: int = SHINGLE, seed: int = 42) -> int:
    """Fingerprint of a UTF-8 text; unsigned."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, seed) for s in shingles), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are 1 in over half of 64-bit hashes."""
    h = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(h[:, j], minlength=256) @ _BITS for j in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text), fp (signed long holding the 64 bits); one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t.as_buffer().to_pybytes(), size) for t in b["text"].cast(pa.binary())), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["th"], pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    return id_and_text(docs).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the binary reflected Gray order."""
    r = x.astype(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def gray_index(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the leaves up, each (mask of the bits all members share, those bits); codes are in Gray order."""
    levels, mask, bits = [], np.full(len(codes), _ALL, np.uint64), codes
    while True:
        levels.append((mask, bits))
        if len(mask) <= FANOUT:
            return levels
        starts = np.arange(0, len(mask), FANOUT)
        both = np.bitwise_and.reduceat(mask, starts)
        first = np.repeat(bits[starts], np.diff(np.append(starts, len(mask))))
        mask = both & ~np.bitwise_or.reduceat(bits ^ first, starts)
        bits = bits[starts] & mask


def gray_pairs(codes: np.ndarray, levels: list, queries: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(query index, code index) of all codes within max_bits of each query, by descent with pruning of whole nodes."""
    mask, bits = levels[-1]
    q, node = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), np.arange(len(mask)), indexing="ij"))
    for depth in range(len(levels) - 1, -1, -1):
        mask, bits = levels[depth]
        near = np.bitwise_count((queries[q] ^ bits[node]) & mask[node]) <= max_bits
        q, node = q[near], node[near]
        if depth:
            below = len(levels[depth - 1][0])
            child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            q = np.repeat(q, FANOUT)[child < below]
            node = child[child < below]
    return q, node


def bucket_links(codes: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A star for each class of linked codes in a bucket (distinct, in Gray order), not all its pairs."""
    levels, label = gray_index(codes), np.arange(len(codes))
    edges = [gray_pairs(codes, levels, codes[i : i + 256], max_bits) for i in range(0, len(codes), 256)] if len(codes) <= 1024 else None
    while True:
        before = label.copy()
        for k, i in enumerate(range(0, len(codes), 256)):
            q, j = edges[k] if edges else gray_pairs(codes, levels, codes[i : i + 256], max_bits)
            low = np.minimum(label[q + i], label[j])
            np.minimum.at(label, q + i, low)
            np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            other = np.flatnonzero(label != np.arange(len(codes)))
            return codes[other], codes[label[other]]


def _segments(free: int) -> list[int]:
    """Three masks that share out the free bits."""
    at = [i for i in range(64) if free >> i & 1]
    cut = [len(at) * k // 3 for k in range(4)]
    return [sum(1 << i for i in at[cut[k] : cut[k + 1]]) for k in range(3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(rows: DataFrame, free: list[int]) -> tuple[DataFrame, list[int]]:
    """Deals (key, path, fp) to three buckets each; path tells which bits are free."""
    masks = [m for f in free for m in _segments(f)]
    lits = F.array(*[F.lit(_signed(m)) for m in masks])
    at = F.explode(F.sequence(F.col("path") * 3, F.col("path") * 3 + 2))
    out = rows.select("key", "fp", at.alias("path"))
    key = F.xxhash64("key", "path", F.col("fp").bitwiseAND(F.get(lits, F.col("path"))))
    return out.select(key.alias("key"), "path", "fp"), [f & ~m for f in free for m in _segments(f)]


def link(codes: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links a, b (fingerprints) that span the classes of the distinct fingerprints in ``codes.fp``; max_bits of 0 to 2."""
    if not 0 <= max_bits <= 2:
        raise ValueError("three segments find at most 2 differing bits")
    spark = codes.sparkSession

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64)]

        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            out, starts = [], np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
            for s, e in zip(starts, np.append(starts[1:], len(key)), strict=True):
                if e - s > 1:
                    x = fp[s:e].view(np.uint64)
                    out.append(bucket_links(x[np.argsort(gray_rank(x))], max_bits))
            a, b = (np.concatenate([o[i] for o in out] or [np.empty(0, np.uint64)]).view(np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            key, fp = (np.concatenate([r, b[c].to_numpy(zero_copy_only=False)]) for r, c in zip(rest, ("key", "fp"), strict=True))
            if len(key):
                cut = int(np.flatnonzero(key != key[-1])[-1] + 1) if (key != key[-1]).any() else 0
                rest = [key[cut:], fp[cut:]]
                if cut:
                    yield links(key[:cut], fp[:cut])
        if len(rest[0]):
            yield links(*rest)

    rows, free, found = codes.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("path"), "fp").distinct(), [_ALL], []
    while True:
        rows, free = _deal(rows, free)
        sizes = rows.groupBy("key").count().filter("count > 1")
        rows = materialise(rows.join(sizes, "key"), "buckets")
        small = rows.filter(F.col("count") <= bucket).select("key", "fp")
        found.append(small.repartition(parts(spark), "key").sortWithinPartitions("key").mapInArrow(search, "a long, b long"))
        rows = rows.filter(F.col("count") > bucket)
        if rows.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) of every node in the edges a, b; by alternating large and small stars until nothing changes.

    A hub's edges stay spread: hubs are looked up as ``lookup`` does.
    """
    pairs = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, both: bool, n: int) -> DataFrame:
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else e
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        hung = lookup(around, least, ["u"], "n", n).filter("v > u" if both else "v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        keep = least.select("u", F.col("m").alias("v"))
        return materialise(hung.unionByName(keep).filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")

    before = state(pairs)
    while before[0]:
        pairs = star(star(pairs, True, 2 * before[0]), False, before[0])
        now = state(pairs)
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, th, fp, root (least fingerprint of the class): a row for each document, on disk."""
    fps = materialise(fingerprints(docs, size), "fingerprints")
    return materialise(of_class(fps, components(link(fps, max_bits)), "fp").select("doc_id", "th", "fp", "root"), "classes")


def of_class(rows: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """rows (on disk) with the root of their node; a node without links is its own. Copies share a node and are looked up as ``lookup`` does."""
    each = rows.groupBy(node).agg(F.count("*").alias("n")).join(roots.withColumnRenamed("node", node), node, "left").select(node, "n", F.coalesce("root", node).alias("root"))
    return lookup(rows, each, [node], "n", rows.count())


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id: a row for each document."""
    fps = materialise(fingerprints(docs, size), "fingerprints")
    total, roots = fps.count(), components(link(fps, max_bits))
    each = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))  # classes are named over distinct fingerprints
    each = materialise(each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "named")
    least = each.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))
    named = materialise(lookup(each, least, ["root"], "fps", each.count()).select("fp", "n", "component_id"), "names")
    return lookup(fps, named, ["fp"], "n", total).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents' own columns; of each class one row stays, as ``keep_first`` says."""
    return keep_first(docs, classes(docs, size, max_bits))


def keep_first(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each class in ``rows`` (doc_id, th, root) one document stays: the least doc_id (nulls last), of equal ids the least text hash."""
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th"))
    same = rows.groupBy("root", "doc_id", "th").count()
    first = materialise(same.groupBy("root").agg(F.min_by(F.struct("doc_id", "th", "count"), order).alias("r")).select("r.*"), "firsts")
    keys = first.select(F.col("doc_id").alias("__tm_id"), F.col("th").alias("__tm_th"))
    text = F.coalesce(docs["text"], F.lit(""))
    # keys grow with the documents, so they are shuffled at every size
    kept = docs.join(keys.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(keys["__tm_id"]) & (F.xxhash64(text) == keys["__tm_th"]), "left_semi")
    if first.filter("count > 1").isEmpty():
        return kept
    return kept.withColumn("__tm_th", F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "__tm_th"]).drop("__tm_th")
