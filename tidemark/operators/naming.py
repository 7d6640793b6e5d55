"""Slugs that are unique within a batch and against those stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T
from tidemark.sources.steps import discard, settle

#: Ids of one stretch are ranked together; a name that a third of all rows have is as many groups as it has stretches.
STRETCH = 1 << 16


def ranked(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with ``place``: from 1 by ``order`` (a long, unique) within a key; ranks of stretches, plus the sizes of the stretches before."""
    part = rows.withColumn("__tm_s", F.floor(F.col(order) / STRETCH))
    sizes = part.groupBy(key, "__tm_s").agg(F.count("*").alias("__tm_n"))
    before = F.sum("__tm_n").over(Window.partitionBy(key).orderBy("__tm_s").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("__tm_before", F.coalesce(before, F.lit(0))).drop("__tm_n")
    near = part.withColumn("__tm_r", F.row_number().over(Window.partitionBy(key, "__tm_s").orderBy(order)))
    return near.join(offsets, [key, "__tm_s"]).withColumn("place", F.col("__tm_r") + F.col("__tm_before")).drop("__tm_s", "__tm_r", "__tm_before")


def _numbered(base: Column, n: Column) -> Column:
    return F.when(n == 1, base).otherwise(F.concat(base, F.lit("-"), n.cast("string")))


def unique_slugs(rows: DataFrame, stored: DataFrame | None = None, id: str = "id", name: str = "name", fold: bool = True) -> DataFrame:
    """id, slug: names in the order of their ids take the base slug, or the first of base-2, base-3, ... that is neither stored nor taken by an earlier id.

    Rows of a base take its free numbers in order at first. Where two bases make one slug, the earlier id keeps it; the later one and the rows that follow
    it without a gap move up by one, round by round until no two rows have one slug. As a slug only ever passes to an earlier id, whoever was refused once need not
    ask again, so the rounds end with the names that one row after the other would get; there are as many as names of different bases collide in a chain. stored: slug.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(id).cast("long").alias("id"), T.slugify(F.coalesce(F.col(name), F.lit("")), fold=fold).alias("base"))
    taken = (stored.select("slug") if stored is not None else spark.createDataFrame([], "slug string")).distinct()
    tail = r"^(.+)-([1-9]\d{0,8})$"
    number = F.regexp_extract("slug", tail, 2).try_cast("long")
    cut = F.array(F.struct(F.col("slug").alias("base"), F.lit(1).cast("long").alias("n")), F.struct(F.regexp_extract("slug", tail, 1).alias("base"), F.when(number >= 2, number).alias("n")))
    closed = taken.select(F.explode(cut).alias("c")).select("c.*").filter("n IS NOT NULL")
    closed = closed.groupBy("base").agg(F.sort_array(F.collect_set("n")).alias("closed"))
    free = F.aggregate(F.coalesce("closed", F.expr("CAST(array() AS array<bigint>)")), F.col("place").cast("long"), lambda n, c: n + F.when(c <= n, 1).otherwise(0))
    made, at = settle(ranked(named, "base", "id").join(closed, "base", "left").select("id", "base", "place", free.alias("number")), "slugs")
    while True:
        slug = _numbered(F.col("base"), F.col("number")).alias("slug")
        claims = made.select(slug, F.struct(F.col("id").alias("at"), "base", "place", "number").alias("by"))
        none = F.lit(None).cast("string").alias("base"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("number")
        claims = claims.unionByName(taken.select("slug", F.struct(F.lit(-(2**63)).alias("at"), *none).alias("by")))
        # one row of each base at most claims a slug, so a list is as short as the slug's spelling allows
        lost = claims.groupBy("slug").agg(F.sort_array(F.collect_list("by")).alias("by")).filter(F.size("by") > 1)
        lost = lost.select(F.explode(F.slice("by", 2, 1 << 30)).alias("l")).select("l.base", (F.col("l.number") - F.col("l.place")).alias("run"), F.col("l.place").alias("first"))
        lost, lost_at = settle(lost.groupBy("base", "run").agg(F.min("first").alias("first")), "lost")
        if lost.isEmpty():
            return made.select("id", _numbered(F.col("base"), F.col("number")).alias("slug"))
        moved = made.withColumn("run", F.col("number") - F.col("place")).join(lost, ["base", "run"], "left")
        up = F.when(F.col("place") >= F.col("first"), 1).otherwise(0)
        made, now = settle(moved.select("id", "base", "place", (F.col("number") + up).alias("number")), "slugs")
        discard(spark, at, lost_at)
        at = now
