"""Pruned vector search: sign codes of random hyperplanes choose the candidates, full vectors decide."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.matching import paired_blocks

#: Hyperplanes of a code, a multiple of 64.
BITS = 1024
#: Candidates differ from the query by at most so many standard deviations of a code's noise more than its k-th nearest code.
MARGIN = 3.0


@lru_cache(8)
def _planes(dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, bits))


def sign_codes(df: DataFrame, vector: str, bits: int = BITS, seed: int = 1) -> DataFrame:
    """The table with ``code`` (binary): on which side of each of ``bits`` random hyperplanes the vector lies. Null for vectors that are null, empty, zero, or hold null or non-finite components.

    The planes follow from seed and dimension alone, so a stored table of codes serves later searches and grows by appended rows.
    """

    @F.pandas_udf("binary")
    def code(vs: pd.Series) -> pd.Series:
        return vs.map(lambda v: None if v is None else np.packbits(np.asarray(v, float) @ _planes(len(v), bits, seed) > 0).tobytes())

    usable = (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < math.inf, F.lit(False))) & F.exists(vector, lambda x: x != 0)
    return df.withColumn("code", code(F.when(usable, F.col(vector))))


def _cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def topk_candidates(queries: DataFrame, items: DataFrame, k: int, bits: int = BITS, margin: float = MARGIN) -> DataFrame:
    """query_id, label, item_id: items whose code differs from the query's by no more than its k-th nearest code does and a margin.

    queries: query_id, label, code; items: item_id, label, code. The margin is in standard deviations of a code's differences, at most sqrt(bits) / 2, and does not depend on how
    many rows there are; a query with many items close to its k-th keeps them all. Only codes are sent to the pairs of blocks.
    """
    reach = margin * math.sqrt(bits) / 2
    q, i = paired_blocks(queries.filter("code is not null").select("query_id", "label", "code"), items.filter("code is not null").select("item_id", "label", F.col("code").alias("i_code")))

    def near(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(vs):
            return pd.DataFrame({"query_id": [], "label": [], "item_id": [], "apart": []})
        words = lambda s: np.frombuffer(b"".join(s), np.uint64).reshape(len(s), -1)
        a, b, ids, out = words(qs["code"]), words(vs["i_code"]), vs["item_id"].to_numpy(), []
        for row, x, label in zip(a, qs["query_id"], qs["label"], strict=True):
            apart = np.bitwise_count(row ^ b).sum(axis=1, dtype=np.int64)
            hit = apart <= (np.partition(apart, k - 1)[k - 1] + reach if k <= len(apart) else bits)
            out.append(pd.DataFrame({"query_id": x, "label": label, "item_id": ids[hit], "apart": apart[hit]}))
        return pd.concat(out)

    kind = queries.schema["label"].dataType.simpleString()
    rows = q.cogroup(i).applyInPandas(near, f"query_id long, label {kind}, item_id long, apart long")
    so_far = Window.partitionBy("query_id").orderBy("apart", "item_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("kth", F.nth_value("apart", k).over(so_far)).filter(F.col("kth").isNull() | (F.col("apart") <= F.col("kth") + reach))
    return rows.select("query_id", "label", "item_id").distinct()


def vector_topk_pruned(queries: DataFrame, items: DataFrame, k: int, min_similarity: float | None = 0.55, bits: int = BITS, margin: float = MARGIN, seed: int = 1) -> DataFrame:
    """query_id, item_id, similarity, place, as ``vector_topk`` has them, from candidates that the codes chose; similarities are exact, and ``topk_recall`` tells what is missed.

    queries: query_id (unique), q, label; items: item_id, v, label. Every item is indexed; of repeated items each row counts. Null labels match nothing, vectors of another dimension than the
    query's neither, nor those without a code. Ties go to the lesser item_id. Full vectors are read again and meet candidates by id; a hot item's candidates are split by the adaptive skew join.
    """
    sized = lambda df, v: df.filter("label is not null").withColumn("label", F.concat_ws(":", F.size(v), "label"))
    asked, stock = sized(queries, "q"), sized(items, "v")
    found = topk_candidates(sign_codes(asked, "q", bits, seed), sign_codes(stock, "v", bits, seed), k, bits, margin)
    full = stock.select("item_id", "label", "v").join(found, ["item_id", "label"]).join(asked.select("query_id", "label", "q"), ["query_id", "label"])
    rows = full.select("query_id", "item_id", _cosine("q", "v").alias("similarity")).filter("similarity is not null and not isnan(similarity)")
    rows = rows.filter(F.col("similarity") >= min_similarity) if min_similarity is not None and min_similarity > 0 else rows
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def topk_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: pairs (of the exact search), hits (those that ``found`` has) and recall; 1 where there is nothing to find."""
    got = found.select("query_id", "item_id").distinct().withColumn("hit", F.lit(1))
    rows = exact.select("query_id", "item_id").distinct().join(got, ["query_id", "item_id"], "left")
    rows = rows.agg(F.count("*").alias("pairs"), F.count("hit").alias("hits"))
    return rows.withColumn("recall", F.when(F.col("pairs") > 0, F.col("hits") / F.col("pairs")).otherwise(1.0))
