"""Each stage on its predecessor's rows against brute force, and all of them on odd and empty tables."""

import collections
import itertools
import re

import corpus_pipeline
from pyspark.sql import functions as F
from tidemark.llm import common, quality, shingles

SF = "/root/testdata/sf0.001"


def key(line):
    return re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", line).translate(str.maketrans(common.UPPER, common.LOWER))


def first_lines_stay(docs):
    """doc_id -> text, of doc_id, text with unique ids."""
    n = collections.Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    seen, out = set(), {}
    for i, t in sorted(docs):
        kept = []
        for line in (t or "").split("\n"):
            k = key(line)
            if n[k] < 10 or k not in seen:
                kept.append(line)
            seen.add(k)
        out[i] = "\n".join(kept)
    return out


def one_of_each(docs, similarity=0.8):
    """Ids that stay: the least of each class of texts linked at the similarity of their five-word shingles."""
    sets = {i: set(shingles.shingles((t or "").encode()).tolist()) for i, t in docs}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n >= similarity * (len(sets[a]) + len(sets[b]) - n) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return set(root.values())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "mixing", "packing"]
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    lines = corpus_pipeline.drop_repeated_lines(spark, kept, SF)
    assert {r.doc_id: r.text for r in lines.collect()} == first_lines_stay([(r.doc_id, r.text) for r in kept.collect()])
    one = corpus_pipeline.near_copies(spark, lines, SF)
    assert {r.doc_id for r in one.collect()} == one_of_each([(r.doc_id, r.text) for r in lines.collect()])
    mixed = corpus_pipeline.mix_sources(spark, one, SF)
    assert all(x.columns == docs.columns for x in (kept, lines, one, mixed))
    packed = corpus_pipeline.pack_sequences(spark, mixed, SF).collect()
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert collections.Counter(r.doc_id for r in packed if r.start == 0) == copies
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(packed)


def test_odd_rows(spark):
    """Nulls, blanks, repeated rows and columns whose names clash with the operators' own pass every stage; an empty table stays empty."""
    prose = "The river runs by the old mill and the people walk there. They talk of rain and of the harvest, and then go home. "
    texts = [None, "", " \n", prose * 2 + "One more line.", prose * 2 + "One more line.", "x"] + [prose + " ".join(f"w{i}x{j}" for j in range(60)) + "." for i in range(12)]
    rows = [(i, t, "en", None if i % 2 else "s", 0, 1.0, "r", "k", 3) for i, t in enumerate(texts)]
    rows += [rows[3], (None, prose * 3, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality double, root string, th string, n long"
    for docs in (spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame([], schema)):
        columns, now = docs.columns, docs
        for name, stage in corpus_pipeline.STAGES:
            now = common.materialise(stage(spark, now, ""), name)
            if name == "quality" and now.isEmpty():  # so few documents may all be rejected: the other stages get them as they are
                now = docs
            assert name == "packing" or now.columns == columns
        assert (now.count() > 0) == (docs.count() > 0) and now.filter(F.col("length") > 2048).count() == 0
