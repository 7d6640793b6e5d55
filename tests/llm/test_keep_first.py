from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_first_copy_keeps_its_lines(spark):
    poem = "Roses are red\nand again\nand again\nviolets are blue"
    rows = [(i, poem if i % 2 else f"\n own {i}\nMENU \nmenu\nend {i}", "en", "s", 0) for i in range(24)] + [(None, poem, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert out.pop(1) == "Roses are red\nand again\nviolets are blue"
    assert out.pop(0) == "\n own 0\nMENU \nend 0"
    assert all(t == ("" if i is None or i % 2 else f"\n own {i}\nend {i}") for i, t in out.items()) and len(out) == 23
    kept = corpus_pipeline.near_copies(spark, corpus_pipeline.drop_repeated_lines(spark, docs, ""), "").collect()
    assert any(r.text and "Roses are red" in r.text for r in kept)
    assert line_dedup.line_dedup(docs).filter("doc_id = 1").first()["__tm_kept"] == ""


def test_hashes_are_independent(spark):
    rows = spark.range(500).select(*line_dedup._hashed(F.col("id").cast("string")))
    assert rows.filter(F.xxhash64(F.lit(1)) == F.col("h2")).count() == 0
    chained = spark.range(500).select(F.xxhash64(F.col("id").cast("string"), F.lit(1)).alias("x"), line_dedup._hashed(F.col("id").cast("string"))[1])
    assert chained.filter("x = h2").count() == 0 and rows.select("h2").distinct().count() == 500


def test_a_key_over_many_ranges(spark):
    """One line in every document, more rows of it than of all others: it fills several ranges and is still settled."""
    rows = [(i, "\n".join(["hot"] * (1 + i % 3) + [f"own {i}"]), "en", "s", 0) for i in range(400)]
    docs = spark.createDataFrame([*rows, *rows[:5]], SCHEMA).repartition(4)
    dealt = line_dedup.dealt_lines(docs)
    found = line_dedup.frequent_keys(dealt).collect()
    assert len({r.part for r in found}) > 1 and {r.n_docs for r in found} == {405} and {(r.first.doc_id, r.first.pos) for r in found} == {(0, 0)}
    out = line_dedup.line_dedup(docs).collect()
    assert all(r["__tm_kept"] == f"own {r.doc_id}" and r["__tm_dropped"] == 1 + r.doc_id % 3 for r in out) and len(out) == 405
    assert sum(r["__tm_dropped"] for r in line_dedup.line_dedup(docs, keep_first=True).collect()) == sum(r["__tm_dropped"] for r in out) - 2
    assert line_dedup.line_dedup(docs, min_docs=406).agg(F.sum("__tm_dropped")).first()[0] == 0
