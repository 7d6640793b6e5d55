"""Queries op12_ and op13_ over ``embeddings``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, vector_codes


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op12_tile_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(embeddings(spark, sf_dir))


def op13_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_codes.encode(embeddings(spark, sf_dir))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op12_tile_dedup, op13_ball_codes)}


def _op13_sql() -> str:
    """The rounds one after another: nearest entries by full search, then floors of means in integers."""
    best = """a{k} AS MATERIALIZED (SELECT x.r, x.p, arg_min(c.e, struct_pack(d := list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := c.e)) AS e,
           min(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
    FROM x JOIN c{k} c ON x.p = c.p GROUP BY x.r, x.p)"""
    move = """s{k} AS (SELECT p, e, i, sum(n)::HUGEINT AS s, count(*) AS n FROM (SELECT x.p, a.e, unnest(x.v) AS n, unnest(range(1, len(x.v) + 1)) AS i FROM x JOIN a{k} a ON a.r = x.r AND a.p = x.p) GROUP BY p, e, i),
    m{k} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{k} GROUP BY p, e),
    c{n} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.e = c.e)"""
    rounds = ",\n    ".join(f"{best.format(k=k)},\n    {move.format(k=k, n=k + 1)}" for k in range(vector_codes.ROUNDS))
    last = vector_codes.ROUNDS
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda y: floor({vector_codes.SCALE} * y::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
    x AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {vector_codes.PARTS}) + 1 : (p + 1) * (len(v) // {vector_codes.PARTS})] AS v FROM t, range({vector_codes.PARTS}) g(p)),
    c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= {vector_codes.ENTRIES}),
    {rounds},
    {best.format(k=last)},
    h AS (SELECT sha256(string_agg(n::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(v) AS n, unnest(range(1, len(v) + 1)) AS i FROM c{last})),
    o AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY r)
SELECT t.vec_id, o.code, o.error, (sum(o.error) OVER (PARTITION BY t.label))::BIGINT AS label_error, h.h AS codebooks_sha256 FROM o JOIN t ON t.r = o.r CROSS JOIN h
"""


OP12_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda y: y::DOUBLE) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
      AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
    n AS MATERIALIZED (SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS norm FROM v),
    e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= {embedding_dedup.THRESHOLD}),
    reach AS (SELECT DISTINCT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), links AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT t.vec_id, coalesce(links.n, 0) AS n_links, least(t.vec_id, coalesce(least.b, t.vec_id)) AS component_id, t.vec_id = least(t.vec_id, coalesce(least.b, t.vec_id)) AS kept
FROM embeddings t LEFT JOIN links ON links.a = t.vec_id LEFT JOIN least ON least.a = t.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_tile_dedup": OP12_SQL, "op13_ball_codes": _op13_sql()}
