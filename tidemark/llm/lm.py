"""Language-model scoring with a log-bilinear neural model trained by noise-contrastive estimation.

The corpus is counted whole by Spark: each training word, and each pair of neighbouring classes, where the ``VOCAB`` most frequent
words are classes of their own, all others fall into ``SUFFIXES`` classes by their last three bytes, and the end is a class. Pair counts
are a table of at most K * K cells; each task trains on a share of ``SHARE`` of them in numpy, drawn by their counts, and
the parameters are averaged after each round. The score of a class after another is (R[context] @ C) @ Q[class] + b[class]; matrix
products over all classes normalise it. A rare word's probability is its class's, times its smoothed count within the class.
Counts of rare words reach the texts by a shuffled join; only tables bounded by VOCAB, SUFFIXES and K are broadcast.

Defined results: null or blank text is the end alone; a null doc_id hashes as the empty text; repeated rows are counted and
scored each; without training rows N is 0 and the model is uniform over classes; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, lower_ascii, materialise

VOCAB = 2048
SUFFIXES = 256
K = VOCAB + SUFFIXES + 1
END = K - 1
SMOOTH = 0.1
#: A learner has about SHARE distinct pairs, so learners grow with what the corpus holds; in each round it draws BATCH pairs STEPS times, or its share 1.2 times.
SHARE, ROUNDS, STEPS, BATCH, NOISE, WIDTH, RATE = 400_000, 3, 240, 2048, 512, 32, 0.1
Params = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def held_out(col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def exploded(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.explode(F.split(lower_ascii(F.col("text")), r"[\x20\x09-\x0D]+")).alias("w")).filter("w != ''")


def suffix_class(col: Column) -> Column:
    """Number of a rare word's class, from 0."""
    return F.pmod(F.crc32(F.substring(col.cast("binary"), -3, 3)), F.lit(SUFFIXES))


class Classes(dict):
    """Word (bytes) to class."""

    def __init__(self, frequent: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(frequent))
        self.suffix: dict[bytes, int] = {}

    def __missing__(self, w: bytes) -> int:
        s = w[-3:]
        if s not in self.suffix:
            self.suffix[s] = VOCAB + zlib.crc32(s) % SUFFIXES
        return self.suffix[s]

    def of(self, text: str) -> np.ndarray:
        w = text.encode().lower().split()
        return np.fromiter(map(self.__getitem__, w), np.int32, len(w))


def nce(pairs: np.ndarray, n: np.ndarray, start: Params, noise: np.ndarray, steps: int, rng: np.random.Generator) -> Params:
    """AdaGrad steps on the noise-contrastive objective; pairs are context * K + class, drawn by their counts n."""
    r, c, q, b = (x.copy() for x in start)
    sums = [np.full_like(x, 1e-9) for x in (r, c, q, b)]
    draw, log_kp = np.cumsum(n, dtype=float), np.log(NOISE * np.maximum(noise, 1e-12)).astype(np.float32)
    cum_noise = np.cumsum(noise)

    def update(k: int, x: np.ndarray, grad: np.ndarray, at: np.ndarray | None = None) -> None:
        if at is None:
            sums[k] += grad * grad
            x += RATE * grad / np.sqrt(sums[k])
        else:
            rows, inverse = np.unique(at, return_inverse=True)
            g = np.zeros((len(rows), *x.shape[1:]), np.float32)
            np.add.at(g, inverse, grad)
            sums[k][rows] += g * g
            x[rows] += RATE * g / np.sqrt(sums[k][rows])

    for _ in range(steps):
        code = pairs[np.minimum(np.searchsorted(draw, rng.random(BATCH) * draw[-1], side="right"), len(pairs) - 1)]
        ctx, w = code // K, code % K
        x = np.minimum(np.searchsorted(cum_noise, rng.random(NOISE) * cum_noise[-1], side="right"), K - 1)
        h = r[ctx] @ c
        real = 1 / (1 + np.exp(-np.clip((h * q[w]).sum(1) + b[w] - log_kp[w], -30, 30)))
        fake = 1 / (1 + np.exp(-np.clip(h @ q[x].T + b[x] - log_kp[x], -30, 30)))
        gr, gf = ((1 - real) / BATCH).astype(np.float32), (-fake / BATCH).astype(np.float32)
        dh = gr[:, None] * q[w] + gf @ q[x]
        grads = (r[ctx].T @ dh, np.concatenate([gr[:, None] * h, gf.T @ h]), np.concatenate([gr, gf.sum(0)]), dh @ c.T)
        update(1, c, grads[0])
        update(2, q, grads[1], np.concatenate([w, x]))
        update(3, b, grads[2], np.concatenate([w, x]))
        update(0, r, grads[3], ctx)
    return r, c, q, b


def log_table(p: Params) -> np.ndarray:
    """log10 probability of each class (column) after each class (row): batched matrix products, normalised."""
    r, c, q, b = p
    s = (r @ c) @ q.T + b
    s -= s.max(1, keepdims=True)
    return ((s - np.log(np.exp(s, dtype=np.float64).sum(1, keepdims=True))) / np.log(10)).astype(np.float32)


class Model:
    """What scoring needs: bounded tables, and the counts of all words as a DataFrame (w, c)."""

    def __init__(self, counts: DataFrame, frequent: list[bytes], frequent_counts: np.ndarray, n_ends: int, class_tokens: np.ndarray, class_types: np.ndarray, params: Params):
        self.counts, self.frequent, self.frequent_counts, self.n_ends = counts, frequent, frequent_counts, n_ends
        self.class_tokens, self.class_types, self.params = class_tokens, class_types, params
        self.tokens = int(frequent_counts.sum() + class_tokens.sum()) + n_ends
        self.types = len(frequent) + int(class_types.sum()) + (n_ends > 0)


def fit(docs: DataFrame, seed: int = 7) -> Model:
    """Learns from the rows that aren't held out."""
    spark, train = docs.sparkSession, id_and_text(docs).filter(~held_out(F.col("doc_id")))
    counts = materialise(exploded(train).groupBy("w").agg(F.count("*").alias("c")), "counts")
    top = counts.orderBy(F.desc("c"), "w").limit(VOCAB).collect()
    frequent, c = [r["w"].encode() for r in top], np.array([r["c"] for r in top], np.int64)
    per = counts.groupBy(suffix_class(F.col("w")).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    tokens, types = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64)
    for r in per:
        tokens[r["k"]], types[r["k"]] = r["c"], r["n"]
    for w, n in zip(frequent, c, strict=True):
        tokens[zlib.crc32(w[-3:]) % SUFFIXES] -= n
        types[zlib.crc32(w[-3:]) % SUFFIXES] -= 1
    n_ends = train.count()

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, cells = Classes(frequent), np.zeros(K * K, np.int64)
        for b in batches:
            held, size = [], 0
            for t in b["text"]:
                w = classes.of(t.as_py()).astype(np.int64)
                held.append(np.append(END, w) * K + np.append(w, END))
                size += len(w)
                if size > 2_000_000:
                    cells += np.bincount(np.concatenate(held), minlength=K * K)
                    held, size = [], 0
            if held:
                cells += np.bincount(np.concatenate(held), minlength=K * K)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["pair", "n"])

    pairs = materialise(train.select("text").mapInArrow(pairs_of, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    noise = np.concatenate([c, np.zeros(VOCAB - len(c)), tokens, [n_ends]]).astype(float) + SMOOTH
    noise /= noise.sum()
    rng = np.random.default_rng(seed)
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    params: Params = (small(K, WIDTH), np.eye(WIDTH, dtype=np.float32), small(K, WIDTH), np.log(noise).astype(np.float32))
    def learner(start: Params, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pair")
            own = np.random.default_rng([seed, k, int(pdf["learner"].iloc[0])])
            out = nce(pdf["pair"].to_numpy(), pdf["n"].to_numpy(), start, noise, STEPS, own)
            return pd.DataFrame({"n": [int(pdf["n"].sum())], "p": [b"".join(x.astype("<f4").tobytes() for x in out)]})

        return learn

    learners = max(1, -(-pairs.count() // SHARE))
    dealt = pairs.withColumn("learner", F.pmod(F.xxhash64("pair"), F.lit(learners))).repartition(2 * learners, "learner")
    for k in range(ROUNDS if n_ends else 0):
        rows = dealt.groupBy("learner").applyInPandas(learner(params, k), "n long, p binary").collect()  # a row for each learner: K * K / SHARE at most
        total = sum(r["n"] for r in rows)
        flat = sum(np.frombuffer(r["p"], "<f4").astype(float) * (r["n"] / total) for r in rows)
        cut = np.cumsum([0, *(x.size for x in params)])
        params = tuple(flat[cut[i] : cut[i + 1]].reshape(x.shape).astype(np.float32) for i, x in enumerate(params))
    return Model(counts, frequent, c, n_ends, tokens, types, params)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each document."""
    spark, rows = docs.sparkSession, id_and_text(docs).withColumn("th", F.xxhash64("text"))
    frequent, c, n_ends, params = model.frequent, model.frequent_counts, model.n_ends, model.params
    within = -np.log10(model.class_tokens + SMOOTH * (model.class_types + 1))
    plain = np.concatenate([np.log10(c + SMOOTH), np.zeros(VOCAB - len(c)), np.zeros(SUFFIXES), [np.log10(n_ends + SMOOTH)]])
    total = float(np.log10(model.tokens + SMOOTH * (model.types + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, table = Classes(frequent), log_table(params)
        extra = np.concatenate([np.zeros(VOCAB), within, [0.0]])
        for b in batches:
            out = []
            for t in b["text"]:
                w = np.append(classes.of(t.as_py()), END)
                rare = int(((w >= VOCAB) & (w < END)).sum())
                lm = float(table[np.append(END, w[:-1]), w].sum(dtype=np.float64) + extra[w].sum())
                out.append((len(w), rare, float(plain[w].sum()), lm))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["th"], *(pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))], ["doc_id", "th", "n_tokens", "n_rare", "plain", "lm"])

    own = rows.mapInArrow(run, "doc_id long, th long, n_tokens long, n_rare long, plain double, lm double")
    known = spark.createDataFrame([(w.decode(),) for w in frequent], "w string")  # VOCAB rows
    rare = exploded(rows, "doc_id", "th").join(F.broadcast(known), "w", "left_anti").join(model.counts, "w", "left")
    c_ = F.coalesce(F.col("c"), F.lit(0))
    rare = rare.groupBy(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th")).agg(F.count("*").alias("r_n"), F.sum(F.log10(c_ + SMOOTH)).alias("r_sum"), F.count_if(c_ > 0).alias("r_known"))
    both = own.join(rare, own["doc_id"].eqNullSafe(rare["r_id"]) & (own["th"] == rare["r_th"]), "left")
    part = F.when(F.col("n_rare") > 0, F.col("n_rare") / F.col("r_n")).otherwise(0.0)  # repeated rows have met in one sum
    r_sum, r_known = F.coalesce(F.col("r_sum") * part, F.lit(0.0)), F.coalesce(F.round(F.col("r_known") * part), F.lit(0.0)).cast("long")
    return both.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_tokens") - F.col("n_rare") - F.lit(0 if n_ends else 1) + r_known).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("plain") + r_sum - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("lm") + r_sum).alias("score"),
    )


def fit_and_score(docs: DataFrame) -> DataFrame:
    return score(docs, fit(docs))
