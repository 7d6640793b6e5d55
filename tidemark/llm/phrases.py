"""Collocations of two to four words by dynamic itemset counting.

The texts are tokenised once, into blocks of word numbers that are dealt to ``SHARDS`` shards. The shards are scanned in turn, again
and again. Words are counted in the first cycle. After each scan the phrases that have reached the threshold so far are noted in
an activation table, and a longer phrase becomes active as soon as both phrases it is made of (without its last and without its first word) are
noted; it is counted from the next scan on, for exactly one cycle, whatever shard that starts at. So lengths are counted
side by side, and the search ends when each active phrase has completed its cycle.

The activation table has a fixed number of slots a length and holds for each slot the first scan after which a phrase of that hash was noted.
A phrase's start is read from the slots of its two parts. Two phrases that share slots only make a phrase active early or in vain:
starts never change once set, so each counted phrase is counted over one whole cycle and its count is exact. The table
is the only thing that is sent to all tasks (three times ``SLOTS`` bytes), and no list of phrases reaches the driver.

Counts are combined for a block of up to two million words of a language at a time, then added up by (lang, phrase) with the open counts of earlier
scans. Complete phrases leave that table, the frequent ones into a table of their own, from which candidates get their cuts, scores and ranks by joins on (lang, phrase).

Defined results: null text is an empty text, null lang is ``und``; repeated rows count as documents of their own; texts of any length are cut at
piece ends into slices; ties are ranked by phrase in UTF-8 byte order; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, new_path, write_step

MAX_WORDS, MIN_COUNT, TOP = 4, 30, 2000
#: A candidate goes if a longer phrase around it has at least this share (of 100) of its count.
COVERED = 80
SHARDS = 2
#: Slots of the activation table for each length; a fixed size, so a larger corpus only lets more phrases through.
SLOTS = 1 << 22
NEVER = 255
#: Words of a block, and of all blocks that a task has open; bytes of a text that are cut at once.
BLOCK, OPEN, SLICE = 1 << 21, 1 << 23, 1 << 22
END, NONE = 0, 1
_FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_COUNTS = "lang string, k int, start int, phrase string, n long"


class Words(dict):
    """Numbers words as they come; the end of a piece is 0, what stands between two blanks is 1."""

    def __init__(self) -> None:
        super().__init__({b"\n": END, b"": NONE})

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self)
        return n

    def of(self, folded: bytes) -> np.ndarray:
        w = folded.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, w), np.int32, len(w))
        return ids[ids != NONE]


def slices(text: bytes) -> Iterator[bytes]:
    """The folded text, cut at ends of pieces."""
    text, at = text.translate(_FOLD) + b"\n", 0
    while at < len(text):
        end = text.find(b"\n", at + SLICE) + 1 or len(text)
        yield text[at:end]
        at = end


def blocks(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """shard, lang, n_words, vocab (in byte order, from 1), ids: word numbers of whole pieces of a language, 0 between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[Words, list[np.ndarray]]] = {}
        size: dict[str, int] = {}
        made = TaskContext.get().partitionId()

        def close(lang: str) -> pa.RecordBatch:
            nonlocal made
            (known, ids), _ = open_.pop(lang), size.pop(lang)
            made += 1
            words, ids = list(known), np.concatenate(ids)
            order = sorted(range(2, len(words)), key=words.__getitem__)  # in byte order, so that what is sent compresses
            place = np.zeros(len(words), "<i4")
            place[order] = np.arange(1, len(words) - 1)
            ids, words = place[ids], [words[i] for i in order]
            cols = [pa.array([made % shards], pa.int32()), pa.array([lang]), pa.array([int(np.count_nonzero(ids))]), pa.array([[b"", *words]], pa.list_(pa.binary())), pa.array([ids.tobytes()])]
            return pa.RecordBatch.from_arrays(cols, ["shard", "lang", "n_words", "vocab", "ids"])

        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].cast(pa.binary()), strict=True):
                for s in slices(text.as_buffer().to_pybytes()):
                    known, ids = open_.setdefault(lang, (Words(), []))
                    ids.append(known.of(s))
                    size[lang] = size.get(lang, 0) + len(ids[-1])
                    if size[lang] >= BLOCK:
                        yield close(lang)
            while sum(size.values()) >= OPEN or len(size) > 4096:  # many languages
                yield close(max(size, key=size.get))
        for lang in list(open_):
            yield close(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "shard int, lang string, n_words long, vocab array<binary>, ids binary")


def word_hash(lang: str, w: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\n" + w)


_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def longer_hash(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of all but its last word and the hash of that word."""
    x = (h ^ (h >> np.uint64(29))) * _MULTIPLY + last
    return x ^ (x >> np.uint64(32))


def two_slots(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(slots - 1)
    return (h & mask).astype(np.int64), ((h * _MULTIPLY >> np.uint64(24)) & mask).astype(np.int64)


def started(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """First scan after which both slots of a hash were noted."""
    a, b = two_slots(h, len(table))
    return np.maximum(table[a], table[b])


class Scan:
    """Counts of one scan: words in the first cycle, and the phrases that are active in it."""

    def __init__(self, step: int, shards: int, tables, max_words: int):
        self.step, self.shards, self.tables, self.max_words = step, shards, tables, max_words

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, vocab, ids in zip(b["lang"].to_pylist(), b["vocab"], b["ids"], strict=True):
                words = vocab.as_py()[1:]
                h = np.array([0, *(word_hash(lang, w) for w in words)], np.uint64)
                yield from self.counted(lang, vocab.values, h, np.frombuffer(ids.as_buffer(), "<i4").astype(np.int64))

    def counted(self, lang: str, vocab: pa.Array, h: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        tables = self.tables.value
        if self.step < self.shards:
            n = np.bincount(ids, minlength=len(h))[1:]
            yield from self.rows(lang, -np.ones(len(n), np.int64), vocab, [np.arange(1, len(h))], n)
        start = started(tables[0], h)
        start[0] = NEVER
        of_word = start.astype(np.int64)
        at, grams = np.arange(len(ids)), h[ids]  # places where a noted phrase of k - 1 words starts, and its hash
        start = start[ids]
        at, grams, start = (x[start < NEVER] for x in (at, grams, start))
        last = h[ids]
        for k in range(2, self.max_words + 1):
            pair = np.flatnonzero(np.diff(at) == 1)  # a phrase of k words: one of k - 1 starts here and one at the next word
            first = np.maximum(start[pair], start[pair + 1]).astype(np.int64)
            here, grams = at[pair], longer_hash(grams[pair], last[at[pair] + k - 1])
            active = (first < self.step) & (self.step <= first + self.shards)
            if active.any():
                yield from self.rows(lang, *self.combined(ids, here[active], of_word if k == 2 else first[active], k, len(h), vocab))
            if k == self.max_words or not len(here):
                return
            start = started(tables[k - 1], grams)
            at, grams, start = (x[start < NEVER] for x in (here, grams, start))

    @staticmethod
    def combined(ids: np.ndarray, here: np.ndarray, first: np.ndarray, k: int, n_words: int, vocab: pa.Array) -> tuple:
        """Distinct phrases with their counts, told apart by their words and not by hashes; first: scan before the first, of each word or place."""
        if k == 2:
            key, n = np.unique(ids[here] * n_words + ids[here + 1], return_counts=True)
            pair = np.divmod(key, n_words)
            return np.maximum(first[pair[0]], first[pair[1]]), vocab, [*pair], n
        key = ids[here] * n_words + ids[here + 1]
        for j in range(2, k):
            _, key = np.unique(key, return_inverse=True)
            key = key * n_words + ids[here + j]
        _, where, n = np.unique(key, return_index=True, return_counts=True)
        return first[where], vocab, [ids[here[where] + j] for j in range(k)], n

    @staticmethod
    def rows(lang: str, start: np.ndarray, vocab: pa.Array, ids: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(n), 1 << 16):
            s = slice(i, i + (1 << 16))
            parts = [vocab.take(pa.array(x[s])) for x in ids]
            phrase = (pc.binary_join_element_wise(*parts, b" ") if len(parts) > 1 else parts[0]).cast(pa.string())
            size = len(phrase)
            cols = [pa.array([lang] * size), pa.array(np.full(size, len(ids), np.int32)), pa.array(start[s].astype(np.int32)), phrase, pa.array(n[s].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "k", "start", "phrase", "n"])


def noted_slots(frequent: DataFrame, slots: int = SLOTS) -> DataFrame:
    """k, word, bits: the slots of the phrases, 64 to a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[tuple[str, bytes], int] = {}
        for b in batches:
            if len(hashes) > 1 << 20:
                hashes.clear()
            lists = [(k, []) for k in range(1, MAX_WORDS + 1)]
            for lang, k, phrase in zip(*(b[c].to_pylist() for c in ("lang", "k", "phrase")), strict=True):
                row = []
                for w in phrase.encode().split(b" "):
                    if (lang, w) not in hashes:
                        hashes[lang, w] = word_hash(lang, w)
                    row.append(hashes[lang, w])
                lists[k - 1][1].append(row)
            for k, rows in lists:
                if rows:
                    each = np.array(rows, np.uint64)
                    h = each[:, 0]
                    for j in range(1, k):
                        h = longer_hash(h, each[:, j])
                    at = np.unique(np.concatenate(two_slots(h, slots)))
                    word, bit = at // 64, np.left_shift(np.uint64(1), (at % 64).astype(np.uint64))
                    starts = np.flatnonzero(np.diff(word, prepend=-1))
                    bits = np.bitwise_or.reduceat(bit, starts).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), k, np.int32)), pa.array(word[starts]), pa.array(bits)], ["k", "word", "bits"])

    made = frequent.select("lang", "k", "phrase").mapInArrow(run, "k int, word long, bits long")
    return made.groupBy("k", "word").agg(F.bit_or("bits").alias("bits"))


def note(tables: np.ndarray, frequent: DataFrame, step: int) -> None:
    """Slots that are new get this step; at most one row a 64 slots of a table is collected."""
    got = noted_slots(frequent, tables.shape[1]).toArrow()
    k, word, bits = (got[c].to_numpy() for c in ("k", "word", "bits"))
    on = np.unpackbits(bits.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 64)
    row, bit = np.nonzero(on)
    at = k[row] - 1, word[row] * 64 + bit
    tables[at] = np.minimum(tables[at], step)


def counted_phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, n of all phrases of up to max_words words with at least min_count occurrences; lang, n of all words)."""
    spark = docs.sparkSession
    at = new_path(spark, "blocks")
    cut = blocks(docs, shards)
    cut.write.option("compression", "zstd").partitionBy("shard").parquet(at)
    cut = spark.read.schema(cut.schema).parquet(at)
    tables = np.full((max(max_words - 1, 1), slots), NEVER, np.uint8)
    step, done, open_, open_at = 0, None, None, None
    while step < shards or (tables[tables < NEVER] > step - 1 - shards).any():
        sent = spark.sparkContext.broadcast(tables)
        new = cut.filter(F.col("shard") == step % shards).select("lang", "vocab", "ids").mapInArrow(Scan(step, shards, sent, max_words), _COUNTS)
        rows = new if open_ is None else new.unionByName(open_)
        # blocks are combined already, so rows are added up once, where they meet; k and start follow from the phrase
        each = rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.max("k").alias("k"), F.max("start").alias("start"), F.sum("n").alias("n"))
        left = (F.col("start") + shards > step) | (F.col("n") >= min_count)
        now = new_path(spark, "counts")
        # phrases hardly repeat, so dictionaries don't pay
        each.filter(left).select("lang", "k", "start", "phrase", "n").write.options(**{"compression": "zstd", "parquet.enable.dictionary": "false"}).parquet(now)
        counts = spark.read.schema(_COUNTS).parquet(now)
        sent.unpersist()
        if open_at:
            discard(spark, open_at)
        frequent = counts.filter(F.col("n") >= min_count)
        if max_words > 1:
            note(tables, frequent.filter(F.col("k") < max_words), step)
        if step >= shards - 1:
            whole, _ = write_step(frequent.filter(F.col("start") + shards == step).select("lang", "k", "phrase", "n"), "phrases")
            done = whole if done is None else done.unionByName(whole)
        open_, open_at = counts.filter(F.col("start") + shards > step), now
        step += 1
    words, _ = write_step(cut.groupBy("lang").agg(F.sum("n_words").alias("n")), "words")
    discard(spark, open_at, at)
    return done, words


def scored(phrases: DataFrame) -> DataFrame:
    """lang, k, phrase, a, l, r, score of each phrase of two words or more, by its lowest-scoring cut."""
    words, big = F.split("phrase", " "), "decimal(38,0)"
    cut = phrases.filter("k >= 2").select("lang", "k", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.withColumns({"first": F.array_join(F.slice(words, 1, F.col("cut")), " "), "rest": F.array_join(F.slice(words, F.col("cut") + 1, F.col("k")), " ")})
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr(f"(cast(2000000 as {big}) * cast(a as decimal(20,0))) div (cast(l as {big}) + cast(r as {big}))").cast("long")
    best = both.withColumn("score", score).groupBy("lang", "k", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    return best.select("lang", "k", "phrase", "a", "b.l", "b.r", "b.score")


def uncovered(candidates: DataFrame, phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """The candidates that no longer phrase around them covers."""
    size, words = F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"), F.split("phrase", " ")
    inner = phrases.filter("k >= 3").select("k", "lang", "phrase", "n", size).select("lang", "phrase", "n", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", "n", F.array_join(F.slice(words, F.col("at"), F.col("size")), " ").alias("phrase"))
    longest = inner.groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    both = candidates.join(longest, ["lang", "phrase"], "left")
    hundred = lambda c, k: F.col(c).cast("decimal(20,0)") * F.lit(k)
    return both.filter(F.col("around").isNull() | (hundred("around", 100) < hundred("a", covered))).drop("around")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` by score, count, phrase."""
    phrases, words = counted_phrases(docs, max_words, min_count)
    kept, _ = write_step(uncovered(scored(phrases), phrases, covered), "candidates")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within shares of a language, so that no task sorts a language's whole list
    near = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
