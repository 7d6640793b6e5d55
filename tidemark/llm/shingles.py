"""Near copies by five-word shingles: similarity (Jaccard, of the sets of shingles) of ``SIMILARITY`` or more.

Each text has the SimHash fingerprint of its set of shingles. ``simhash.link`` (three bit segments, Gray-order index, 2 bits) makes classes of
fingerprints, and each class is a bucket. Texts at 0.8 differ in 10 bits on average, for which segments of 64 bits are too short to deal by, so texts are also dealt by
MinHash: ``BANDS`` bands of ``ROWS`` minima each; two texts at 0.8 share a band with a chance of 0.9998. In every bucket the Gray-order index finds the texts within
``RADIUS`` bits of a text; only these are compared by their signatures and proposed. A bucket of up to ``PAIRS`` texts proposes all its pairs; in larger ones, leaders are set against every member, and a member
whose signature agrees with a leader's in ``COVER`` of 64 places leads no more. A bucket over ``BUCKET`` texts is passed in
chunks, and the chunks' leaders are dealt anew to ``DEALS`` sub-bands of four other places, until none is larger. Pairs that span
a bucket's proposals are confirmed by exact similarity first, so a large group of near copies costs as many comparisons as it has members. Only
where one of those fails are all of a bucket's pairs compared by wide signatures, without the pairs that are joined already, and those near 0.8
or above confirmed. Only texts that share a bucket are cut into shingles again, once.

Defined results: words are separated by ASCII white space, with A-Z lower-cased; a text under five words is one shingle, so
blank and null texts are copies of each other; equal texts are one node; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import id_and_text, lookup, materialise, parts

SIZE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
HASHES = BANDS * ROWS
#: Places of 64 that must agree for a pair to be proposed (at 0.8: 51 on average, 3.2 deviation), and for a member to lead no more.
PROPOSE, COVER = 39, 56
PAIRS, BUCKET, DEALS = 16, 4096, 12
#: Wide signatures, and how many of their places must agree (at 0.8: 410 on average, 3.2 deviation).
WIDE, LIKELY = 512, 381
#: Differing bits of two fingerprints that the index searches for (at 0.8: 9.7 on average, 5 deviations; of sets of 4 and 5 shingles: 12, 4 deviations).
RADIUS = 24
_RNG = np.random.default_rng(11)
_MUL = _RNG.integers(1, 1 << 63, WIDE, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, WIDE, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of the five-word shingles."""
    w = text.lower().split()
    cut = map(b" ".join, zip(*(w[i:] for i in range(SIZE)), strict=False)) if len(w) >= SIZE else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut), np.uint64))


def minima(h: np.ndarray, n: int = HASHES) -> np.ndarray:
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        np.minimum(out, (h[None, i : i + 1024] * _MUL[:n, None] + _ADD[:n, None]).min(1), out=out)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), fp (SimHash of the set of shingles), sig (a byte for each minimum), keys (one for each band): a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, keys, fps = [], np.empty((len(b), BANDS), np.uint64), np.empty(len(b), np.uint64)
            for i, t in enumerate(b["text"].cast(pa.binary())):
                h = shingles(t.as_buffer().to_pybytes())
                m, fps[i] = minima(h), simhash.majority(h)
                sigs.append(((m * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes())
                raw = m.astype("<u8").tobytes()
                keys[i] = [xxhash.xxh64_intdigest(raw[k * 8 * ROWS : (k + 1) * 8 * ROWS], k) for k in range(BANDS)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["th"], pa.array(fps.view(np.int64)), pa.array(sigs, pa.binary()), lists], ["doc_id", "th", "fp", "sig", "keys"])

    return id_and_text(docs).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, fp long, sig binary, keys array<long>")


def searcher(fp: np.ndarray, radius: int = RADIUS) -> Callable[[int], np.ndarray]:
    """A search of a bucket's fingerprints by the Gray-order index: the places of those within ``radius`` bits of the one at a place, in order."""
    order = np.argsort(simhash.gray_rank(fp), kind="stable")
    codes = fp[order].view(np.uint64)
    levels = simhash.gray_index(codes)
    own = fp.view(np.uint64)
    return lambda i: np.sort(order[simhash.gray_pairs(codes, levels, own[i : i + 1], radius)[1]])


def spanning(th: np.ndarray, fp: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs that ``propose`` has, some that join all that they join, fewer than the members, the surest first; and which members lead."""
    order = np.argsort(th)
    sig, near, open_, lead, label, a, b = sig[order], searcher(fp[order]), np.ones(len(th), bool), np.zeros(len(th), bool), np.arange(len(th)), [], []

    def unite(i: int, same: np.ndarray, least: int) -> None:
        at = np.flatnonzero((same >= least) & (label != label[i]))
        if len(at):
            at = at[np.argsort(-same[at].astype(int), kind="stable")]
            trees, first = np.unique(label[at], return_index=True)  # the likest member of each other tree
            a.append(np.full(len(first), i))
            b.append(at[first])
            label[np.isin(label, trees)] = label[i]

    held = []
    for i in range(len(th)):
        if len(th) > PAIRS and not open_[i]:
            continue
        same, at = np.zeros(len(th), np.uint8), near(i)
        same[at] = (sig[at] == sig[i]).sum(1, dtype=np.uint8)
        lead[i] = open_[i]
        open_ &= same < COVER
        held.append((i, same))
        unite(i, same, COVER)
    for i, same in held:
        unite(i, same, PROPOSE)
    leads = np.zeros(len(th), bool)
    leads[order] = lead
    ia, ib = (np.concatenate(x).astype(int) if x else np.empty(0, int) for x in (a, b))
    return th[order][ia], th[order][ib], leads


def crossing(th: np.ndarray, fp: np.ndarray, sig: np.ndarray, root: np.ndarray, own: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of all pairs of a bucket in different classes so far that the index finds and whose wide signatures agree in ``LIKELY`` places; no member leads.

    own: for each text the sorted keys of its buckets, this one's first. A pair comes from the least key that both have.
    """
    a, b, near = [np.empty(0, int)], [np.empty(0, int)], searcher(fp)
    for i in range(len(th) - 1):
        at = near(i)
        at = at[(at > i) & (root[at] != root[i])]
        at = at[np.count_nonzero(sig[at] == sig[i], axis=1) >= LIKELY]
        key, mine = own[i][0], set(own[i][1:])
        at = np.array([j for j in at if not any(k < key and k in mine for k in own[j][1:])], int)
        a.append(np.full(len(at), i))
        b.append(at)
    return th[np.concatenate(a)], th[np.concatenate(b)], np.zeros(len(th), bool)


def _passes(rows: DataFrame, pairs_of: Callable) -> DataFrame:
    """Of rows key, th, fp, sig (and root, own for ``crossing``): a, b, key of proposed pairs, and a row a = b with sig and key for each leader."""
    more = [c for c in ("root", "own") if c in rows.columns]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(t: pa.Table) -> pa.RecordBatch:
            key, th, fp = (t[c].to_numpy() for c in ("key", "th", "fp"))
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(key), -1)
            beside = [np.array(t["root"]), t["own"].to_pylist()] if more else []
            got: list[tuple] = [(np.empty(0, np.int64),) * 3]
            leads, starts = np.zeros(len(key), bool), np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for s, e in zip(starts, np.append(starts[1:], len(key)), strict=True):
                x, y, leads[s:e] = pairs_of(th[s:e], fp[s:e], sig[s:e], *(c[s:e] for c in beside))
                got.append((x, y, np.full(len(x), key[s])))
            a, b, of = (np.concatenate([g[i] for g in got]) for i in (0, 1, 2))
            at, n = np.flatnonzero(leads), len(a)
            cols = [np.append(a, th[at]), np.append(b, th[at])]
            return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([sig[i].tobytes() for i in at], pa.binary())]), pa.array(np.append(of, key[at]))], ["a", "b", "sig", "key"])

        for b in batches:
            if not len(b):
                continue
            held.append(b)
            key = b["key"].to_numpy()
            new = np.flatnonzero(key != key[-1])
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut or held[0]["key"][0].as_py() != key[-1]:
                done = pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
                held = [b.slice(cut)]
                yield out(done)
        if held:
            yield out(pa.Table.from_batches(held))

    return rows.select("key", "th", "fp", "sig", *more).repartition(parts(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(search, "a long, b long, sig binary, key long")


def _ordered(pairs: DataFrame, *more: str) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *more).filter("a != b").distinct()


def candidates(sigs: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs a, b (hashes of texts, a < b), key that span what each bucket of the distinct texts in ``sigs`` proposes; and the buckets (key, th, fp, sig) of every level."""
    levels, texts = [], materialise(sigs.groupBy("th").agg(*[F.first(c).alias(c) for c in ("fp", "sig", "keys")]), "texts")
    near = simhash.of_class(texts.select("th", "fp", "keys"), simhash.components(simhash.link(texts.select("fp"))), "fp")
    keys = F.concat("keys", F.array(F.xxhash64(F.lit(BANDS), "root")))  # a text's bands, and its class of fingerprints
    at, found, rng = materialise(near.select("th", F.explode(keys).alias("key")), "bands"), [], np.random.default_rng(5)
    rows = None
    while True:
        these = at if rows is None else materialise(rows, "leaders")
        sizes = these.groupBy("key").agg(F.count("*").alias("n"), F.count("*").alias("count")).filter("count > 1")
        shared = lookup(these, sizes, ["key"], "n", these.count())
        shared = shared.join(texts.select("th", "fp", "sig"), "th") if rows is None else shared
        shared = materialise(shared.select("key", "th", "fp", "sig", "count"), "buckets")
        small = shared.filter(F.col("count") <= bucket).select("key", "th", "fp", "sig")
        levels.append(small)
        found.append(_passes(small, spanning).filter("sig is null").select("a", "b", "key"))
        large = shared.filter(F.col("count") > bucket)
        if large.isEmpty():
            break
        chunk = F.pmod(F.xxhash64("th", F.lit(len(found))), F.ceil(F.col("count") / bucket))
        chunks = large.select(F.xxhash64("key", chunk).alias("key"), "th", "fp", "sig")
        levels.append(chunks)
        passed = materialise(_passes(chunks, spanning), "chunks")
        found.append(passed.filter("sig is null").select("a", "b", "key"))
        # leaders meet again under the bucket they came from, in sub-bands of other places
        leaders = large.join(passed.filter("sig is not null").select(F.col("a").alias("th"), F.col("key").alias("own")), "th").filter(F.col("own") == F.xxhash64("key", chunk))
        deals = [[int(p) + 1 for p in rng.choice(HASHES, ROWS, replace=False)] for _ in range(DEALS)]
        keys = F.array(*[F.xxhash64(F.col("key"), F.lit(k), *[F.substring("sig", p, 1) for p in deal]) for k, deal in enumerate(deals)])
        rows = leaders.select("th", "fp", "sig", F.explode(keys).alias("key"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return _ordered(out, "key"), levels


def links(docs: DataFrame, sigs: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """Confirmed pairs a, b that join all texts which any proposed and confirmed pair joins.

    A bucket's spanning pairs are confirmed first. Where all hold, they join whatever the bucket proposes, and its other pairs can add nothing. In a
    bucket with one that does not hold, all pairs that the confirmed ones have not joined yet are set side by side by wide signatures; those that
    agree enough are confirmed too.
    """
    pairs, levels = candidates(sigs, bucket)
    pairs = materialise(pairs, "pairs")
    members = reduce(DataFrame.unionByName, levels)
    sets = materialise(shingle_sets(docs, members.select("th").distinct()), "shingles")
    proposed = pairs.select("a", "b").distinct()
    first = materialise(confirm(sets, proposed, similarity), "confirmed")
    failed = pairs.join(first, ["a", "b"], "left_anti").groupBy("key").agg(F.count("*").alias("n"))
    rows = materialise(members.select("key", "th", "fp").join(failed, "key", "left_semi"), "failed")
    own = rows.groupBy("th").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # at most a key for each band and deal
    joined = materialise(simhash.components(first), "joined")
    wide = wide_signatures(sets.join(own, "th")).join(joined.withColumnRenamed("node", "th"), "th", "left")
    wide = materialise(wide.select("th", "sig", "keys", F.coalesce("root", "th").alias("root")), "wide")
    rows = rows.join(wide, "th").select("key", "th", "fp", "sig", "root", F.concat(F.array("key"), "keys").alias("own"))
    again = materialise(_ordered(_passes(rows, crossing)).join(proposed, ["a", "b"], "left_anti"), "crossing")
    tied = joined.filter("node != root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    return tied.unionByName(confirm(sets, again, similarity))


def wide_signatures(sets: DataFrame) -> DataFrame:
    """th, keys, sig (a byte for each of ``WIDE`` minima) of th, s, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [((minima(s.values.to_numpy().view(np.uint64), WIDE) * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes() for s in b["s"]]
            yield pa.RecordBatch.from_arrays([b["th"], b["keys"], pa.array(found, pa.binary())], ["th", "keys", "sig"])

    return sets.select("th", "s", "keys").mapInArrow(run, "th long, keys array<long>, sig binary")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """th, s (array of the distinct shingles' hashes) of the texts whose hash is in ``nodes.th``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_buffer().to_pybytes()).view(np.int64) for t in b["text"].cast(pa.binary())]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b["th"], pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *sets])))], ["th", "s"])

    texts = id_and_text(docs).select(F.xxhash64("text").alias("th"), "text")
    # the texts are shuffled at every size, as nodes grow with them; copies are one row a task before that
    texts = texts.dropDuplicates(["th"]).join(nodes.select("th").distinct().hint("merge"), "th")
    return texts.select("th", "text").mapInArrow(run, "th long, s array<long>")


def confirm(sets: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs a, b whose exact similarity is high enough."""
    of = lambda c: sets.select(F.col("th").alias(c), F.col("s").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(of("b"), "b").join(of("a"), "a").filter(both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def classes(docs: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """doc_id, th, root (least text hash of the class): a row for each document, on disk."""
    sigs = materialise(signatures(docs), "signatures")
    return materialise(simhash.of_class(sigs.select("doc_id", "th"), simhash.components(links(docs, sigs, similarity, bucket)), "th").select("doc_id", "th", "root"), "classes")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """The documents' own columns; of each class one row stays, as ``simhash.keep_first`` says."""
    return simhash.keep_first(docs, classes(docs, similarity, bucket))
