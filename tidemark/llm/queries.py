"""Queries op1_ to op11_ over ``documents``, with those of ``vector_queries``, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, line_dedup, lm, mixing, packing, phrases, quality, simhash, suffix_dedup, surrogates, token_files, vector_queries


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op2_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "source", "copy_no", "mix_key", "text")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = surrogates.replace(documents(spark, sf_dir), surrogates.application_key(spark))
    return rows.select("doc_id", "text", "n_entities", F.array_join("entity_kinds", ",").alias("entity_kinds"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedup(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_lbl_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.fit_and_score(documents(spark, sf_dir))


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op8_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files.round_trip(documents(spark, sf_dir))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(documents(spark, sf_dir))
    return rows.select("doc_id", F.col("__tm_lines").alias("n_lines"), F.col("__tm_dropped").alias("n_dropped"), F.sha2("__tm_kept", 256).alias("kept_sha256"))


def op11_dynamic_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_prefix_fingerprints, op2_cost_packing, op3_poisson_mixing, op4_pii_surrogates, op5_suffix_dedup, op6_lbl_scores, op7_weak_quality, op8_gray_simhash, op9_token_files, op10_line_dedup, op11_dynamic_phrases)
    return {f.__name__: f for f in every} | vector_queries.queries()


OP3_SQL = f"""
WITH size AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
rate AS (SELECT source, CASE WHEN size > 0 THEN (SELECT sum(size) FROM size) * pow(size, {mixing.ALPHA}) / (SELECT sum(pow(size, {mixing.ALPHA})) FROM size) / size ELSE 0 END AS rate FROM size),
rest AS (SELECT source, CAST(floor(rate / {mixing.PART}) AS BIGINT) AS parts, rate - floor(rate / {mixing.PART}) * {mixing.PART} AS rate FROM rate WHERE rate > 0),
k AS (SELECT source, parts, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM rest),
f AS (SELECT source, parts, rate, k, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS lf FROM k),
c AS (SELECT source, parts, k, sum(CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lf) WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS cdf FROM f),
t AS (SELECT source, any_value(parts) AS parts, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
n AS (SELECT d.doc_id, d.source, d.text, CAST(coalesce(list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter({mixing.part_table()}, lambda x: x <= CAST(CAST('0x' || substr(md5('{mixing.SEED}:p:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(j AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)))), 0) AS BIGINT) + len(list_filter(t.cdf, lambda x: x <= CAST(CAST('0x' || substr(md5('{mixing.SEED}:n:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)) AS n
      FROM documents d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, source, text, unnest(range(0, n)) AS copy_no FROM n WHERE n > 0)
SELECT doc_id, source, copy_no, CAST(CAST('0x' || substr(md5('{mixing.SEED}:o:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy_no AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS mix_key, text FROM e
"""

OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT r, doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {line_dedup.MIN_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM f)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM f)), '')) AS kept_sha256
FROM k GROUP BY r
"""


OP11_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, range(1, {phrases.MAX_WORDS} + 1) t(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND n >= {phrases.MIN_COUNT}),
cut AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT cut.lang, cut.phrase, cut.a, cut.cut, x.n AS l, y.n AS r, (2000000::HUGEINT * cut.a // (x.n::HUGEINT + y.n))::BIGINT AS score FROM cut
    JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.ws[1 : cut.cut], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.ws[cut.cut + 1 : cut.k], ' ')),
b AS (SELECT lang, phrase, a, arg_min(struct_pack(score := score, l := l, r := r), struct_pack(score := score, cut := cut)) AS b FROM s GROUP BY lang, phrase, a),
i AS (SELECT lang, a, k, ws, unnest(range(2, k)) AS size FROM c WHERE k >= 3),
j AS (SELECT lang, a, unnest(list_transform(range(1, k - size + 2), lambda m: array_to_string(ws[m : m + size - 1], ' '))) AS phrase FROM i),
o AS (SELECT lang, phrase, max(a) AS around FROM j GROUP BY lang, phrase),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
e AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.b.l AS l, b.b.r AS r, b.b.score AS score
    FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.around IS NULL OR 100 * o.around::HUGEINT < {phrases.COVERED} * b.a::HUGEINT)
SELECT e.lang, rank, e.phrase, a, l, r, t.n, score FROM e JOIN t ON t.lang = e.lang WHERE rank <= {phrases.TOP}
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_poisson_mixing": OP3_SQL, "op10_line_dedup": OP10_SQL, "op11_dynamic_phrases": OP11_SQL} | vector_queries.oracle_sql()
