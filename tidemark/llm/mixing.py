"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

Each source has a mean repetition rate: its target share of the budget over what it has. A document's count is the
inverse of the Poisson distribution function with that mean at a uniform number seeded by a hash of its id (for rates over
``PART`` a sum of such draws), so a rerun or a recomputed task gives the same copies. The documents are exploded by their counts and dealt over the cluster in order of
a second hash of (id, copy), which is uniform, so a copy's place is a share of that number's range and nothing is sampled. The table of sources is
written once, by one pass over the documents; a second one draws.

Defined results: null source is a source of its own; weights may be given for any sources, others default to a share by
``alpha``; a source of weight 0 or of no characters is repeated 0 times; null text has size 0 but is still drawn at its source's rate;
repeated rows (one doc_id) get equal counts; an empty table gives an empty table; extra columns are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lookup, materialise, parts

SEED = "mix-1"
#: Target shares follow size ** ALPHA: below 1, small sources are raised and hot ones lowered.
ALPHA = 0.5
#: Greatest mean that is inverted in one go: a table then has at most 488 numbers. A greater rate is drawn in parts of this mean and a rest, whose sum has that law too.
PART = 256.0
#: Tables of at most so many sources (16 MB) are broadcast whole; of more, those of the largest sources are, and the others are joined by a shuffle.
BROADCAST_ROWS = 4_000


def uniform(*cols: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) of 52 bits, from the MD5 of the columns joined by ':'."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, alpha: float = ALPHA, budget: float = 1.0, weights: DataFrame | None = None) -> DataFrame:
    """source, rate, n: mean copies of each source's documents, so that the expected total is budget times the characters there are; how many documents it has."""
    size = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("size"), F.count("*").alias("n"))
    if weights is None:
        size = size.withColumn("weight", F.pow("size", F.lit(alpha)))
    else:
        w = weights.groupBy(F.col("source").alias("__s")).agg(F.max("weight").cast("double").alias("weight"))
        size = size.join(w, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").fillna(0.0, ["weight"])
    total = size.agg(F.sum("size").alias("sizes"), F.sum("weight").alias("weights"))
    rate = F.when((F.col("size") > 0) & (F.col("weights") > 0), F.lit(float(budget)) * F.col("sizes") * F.col("weight") / F.col("weights") / F.col("size")).otherwise(0.0)
    return size.join(F.broadcast(total)).select("source", rate.alias("rate"), "n")


def part_table() -> list[float]:
    """The distribution function of mean PART, as ``poisson_tables`` has it."""
    total, log_fact, out = 0.0, 0.0, []
    for k in range(math.ceil(PART + 12 * math.sqrt(PART) + 40) + 1):
        log_fact += math.log(k) if k else 0.0
        total += math.exp(k * math.log(PART) - PART - log_fact)
        out.append(total)
    return out


def poisson_tables(rate: DataFrame) -> DataFrame:
    """source, n, parts (whole PARTs in its rate), cdf: ascending distribution function of the rest's Poisson law, as far as a double can tell it from 1."""
    whole = F.floor(F.col("rate") / PART)
    rate = rate.filter("rate > 0").select("source", "n", whole.alias("parts"), (F.col("rate") - whole * PART).alias("rate"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("long")
    k = rate.select("source", "n", "parts", "rate", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    run = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_fact = F.sum(F.when(F.col("k") > 0, F.ln("k")).otherwise(0.0)).over(run)
    pmf = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("log_fact"))).otherwise((F.col("k") == 0).cast("double"))
    cdf = k.withColumn("log_fact", log_fact).withColumn("pmf", pmf).withColumn("cdf", F.sum("pmf").over(run))
    return cdf.groupBy("source", "n", "parts").agg(F.sort_array(F.collect_list("cdf")).alias("cdf"))


def _mixed(docs: DataFrame, alpha: float, budget: float, weights: DataFrame | None, seed: str) -> DataFrame:
    name = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit(""))  # noqa: E731  a key that is never null
    table = materialise(poisson_tables(rates(docs, alpha, budget, weights)), "rates")
    table = table.select(name(F.col("source")).alias("__tm_s"), F.col("n").alias("__tm_size"), F.col("parts").alias("__tm_parts"), F.col("cdf").alias("__tm_cdf"))
    rows, (sources, total) = docs.withColumn("__tm_s", name(docs["source"])), table.agg(F.count("*"), F.sum("__tm_size")).first()
    if sources <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(table.drop("__tm_size")), "__tm_s")
    else:
        joined = lookup(rows, table, ["__tm_s"], "__tm_size", total, hot=BROADCAST_ROWS)
    below = lambda cdf, u: F.size(F.filter(cdf, lambda c: c <= u))
    whole = F.split(F.lit(",".join(map(repr, part_table()))), ",").cast("array<double>")
    draws = F.transform(F.sequence(F.lit(1).cast("long"), "__tm_parts"), lambda j: below(whole, uniform(F.col("doc_id"), j, seed=f"{seed}:p")))
    more = F.when(F.col("__tm_parts") > 0, F.aggregate(draws, F.lit(0), lambda a, x: a + x)).otherwise(0)
    joined = joined.withColumn("__tm_u", uniform(F.col("doc_id"), seed=f"{seed}:n"))
    rows = joined.withColumn("__tm_n", below("__tm_cdf", F.col("__tm_u")) + more).filter("__tm_n > 0")
    rows = rows.select(*docs.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__tm_n").cast("long") - 1)).alias("__tm_copy"))
    rows = rows.withColumn("__tm_key", uniform(F.col("doc_id"), F.col("__tm_copy"), seed=f"{seed}:o"))
    n = parts(docs.sparkSession)
    return rows.repartitionById(n, F.floor(F.col("__tm_key") * n).cast("int")).sortWithinPartitions("__tm_key")


def mix(docs: DataFrame, alpha: float = ALPHA, budget: float = 1.0, weights: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """The documents' columns with ``copy_no`` (from 0) and ``mix_key`` (which replace columns of those names); rows lie in the order of mix_key."""
    own = [c for c in docs.columns if c not in ("copy_no", "mix_key")]
    return _mixed(docs, alpha, budget, weights, seed).select(*own, F.col("__tm_copy").alias("copy_no"), F.col("__tm_key").alias("mix_key"))


def apply(docs: DataFrame, alpha: float = ALPHA, budget: float = 1.0, seed: str = SEED) -> DataFrame:
    """The documents' own columns, repeated and in mixed order."""
    return _mixed(docs, alpha, budget, None, seed).select(*docs.columns)
