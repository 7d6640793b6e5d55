"""The pruned vector search against the exact one: recall, exact similarities, copies, odd vectors, several blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import matching as M
from tidemark.operators import vectors as V


def _sides(spark, n, dim, labels, seed=5):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    v[1::7] = v[0::7][: len(v[1::7])] + 0.3 * rng.standard_normal((len(v[1::7]), dim))  # near copies
    v[2::50] = v[0]  # exact copies
    rows = [(i, x.tolist(), f"l{i % labels}" if i % 3 else "hot") for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label string")
    return df.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "label"), df.select(F.col("id").alias("item_id"), "v", "label")


@pytest.mark.parametrize("block", [2048, 60])
def test_recall(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    q, i = _sides(spark, 1500, 48, 4)
    exact, found = M.vector_topk(q, i, 5, None), V.vector_topk_pruned(q, i, 5, None)
    r = V.topk_recall(found, exact).first()
    assert r.pairs == 75 * 5 and r.recall >= 0.95
    want = {(x.query_id, x.item_id): x.similarity for x in exact.collect()}
    got = found.collect()
    assert len(got) == 75 * 5 and all(abs(want[(x.query_id, x.item_id)] - x.similarity) < 1e-9 for x in got if (x.query_id, x.item_id) in want)


def test_candidates_are_few_and_hold_the_nearest(spark):
    q, i = _sides(spark, 1500, 48, 1)
    c = V.topk_candidates(V.sign_codes(q, "q"), V.sign_codes(i, "v"), 1)
    pairs = q.join(i, "label").count()
    assert c.count() < pairs / 4 and c.filter("query_id = item_id").count() == q.count()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    q = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 0.0], "a"), (3, None, "a"), (4, [1.0, 0.0], "none"), (5, [1.0, 0.0], None), (6, [1.0, 0.0, 0.0], "a")], "query_id long, q array<double>, label string")
    rows = [(5, [1.0, 0.0], "a"), (4, [2.0, 0.0], "a"), (6, [0.0, 0.0], "a"), (7, None, "a"), (8, [-1.0, 0.0], "a"), (9, [nan, 1.0], "a"), (10, [inf, 1.0], "a"), (11, [None, 1.0], "a"), (12, [], "a"), (13, [1.0, 0.0], None), (4, [2.0, 0.0], "a")]
    i = spark.createDataFrame(rows, "item_id long, v array<double>, label string")
    got = [(r.query_id, r.item_id) for r in V.vector_topk_pruned(q, i, 9, None).orderBy("place").collect()]
    assert got == [(1, 4), (1, 4), (1, 5), (1, 8)]
    assert [(r.item_id) for r in V.vector_topk_pruned(q, i, 9).orderBy("place").collect()] == [4, 4, 5]
    assert V.vector_topk_pruned(q.limit(0), i, 3).count() == 0 and V.vector_topk_pruned(q, i.limit(0), 3).count() == 0
    assert V.topk_recall(V.vector_topk_pruned(q, i.limit(0), 3), M.vector_topk(q, i.limit(0), 3)).first().recall == 1.0


def test_jobs_by_codes(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((400, 32)).tolist()
    jobs = spark.createDataFrame([(j, f"f{j % 5}", x, True) for j, x in enumerate(v)], "id long, role_family string, embedding array<double>, is_active boolean")
    resumes = spark.createDataFrame([(r, ["f1", "f2"] if r % 2 else None, v[r * 7]) for r in range(20)], "id long, parsed_role_families array<string>, embedding array<double>")
    exact, found = (M.match_jobs(resumes, jobs, 4, 0.1, search=s).select(F.col("resume_id").alias("query_id"), F.col("job_id").alias("item_id")) for s in (M.vector_topk, V.vector_topk_pruned))
    assert V.topk_recall(found, exact).first().recall >= 0.9
