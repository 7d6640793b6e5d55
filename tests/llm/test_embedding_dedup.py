"""Links, counts and classes of vectors against brute force."""

import numpy as np
import pytest

from tidemark.llm import embedding_dedup as ed

SCHEMA = "vec_id long, label int, embedding array<double>, node string, links string"


def brute(rows, threshold=ed.THRESHOLD):
    """Union-find over all pairs of usable vectors with equal label and length."""
    parent, links, groups = list(range(len(rows))), [0] * len(rows), {}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (_, label, v) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            groups.setdefault((label, len(v)), []).append(k)
    for at in groups.values():
        x = np.array([rows[k][2] for k in at], float)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= threshold
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            links[at[i]] += 1
            links[at[j]] += 1
            parent[find(at[i])] = find(at[j])
    least = {}
    for k, row in enumerate(rows):
        if row[0] is not None:
            least[find(k)] = min(least.get(find(k), row[0]), row[0])
    return sorted(((r[0], links[k], least.get(find(k)), r[0] is not None and r[0] == least[find(k)]) for k, r in enumerate(rows)), key=repr)


def made(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in ed.near_duplicates(df, **how).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def clusters(rng, n, dim, spread):
    """Vectors around few centres, so that many cosines lie near the threshold, and chains of links are long."""
    centre = rng.normal(size=(5, dim))
    return centre[rng.integers(5, size=n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize(("seed", "spread"), [(1, 0.2), (2, 0.27), (3, 0.32)])
def test_links_and_classes(spark, seed, spread):
    rng = np.random.default_rng(seed)
    x = clusters(rng, 260, 24, spread)
    rows = [(i * 3, int(rng.integers(3)) if i % 40 else None, list(map(float, v))) for i, v in enumerate(x)]
    rows += [(7000 + i, 1, rows[5][2]) for i in range(60)]  # copies
    assert any(r[1] for r in brute(rows))
    assert made(spark, rows, block=16) == brute(rows)


def test_odd_rows(spark):
    one = [1.0, 0.0, 0.5]
    rows = [(1, 0, one), (1, 0, one), (None, 0, one), (2, 0, None), (3, 0, []), (4, 0, [0.0, 0.0, 0.0]), (5, 0, [1.0, None, 0.5]), (6, 0, [float("nan"), 0.0, 0.5])]
    rows += [(7, 0, [float("inf"), 0.0, 0.5]), (8, None, one), (9, 1, one), (10, 0, [1.0, 0.0, 0.5, 0.0]), (11, 0, [2e300, 0.0, 1e300]), (12, 0, [-1.0, 0.0, -0.5])]
    rows += [(None, 5, [1.0, 2.0]), (None, 5, [1.0, 2.0]), (13, 0, [5e-324, 0.0, 0.0]), (14, 0, [1.0, -0.0, 0.5])]
    assert made(spark, rows) == brute(rows)


def test_empty(spark):
    assert made(spark, []) == []
    assert made(spark, [(1, 0, None)]) == [(1, 0, 1, True)]


def test_bounds_are_rigorous():
    rng = np.random.default_rng(7)
    x = ed.unit(clusters(rng, 300, 64, 0.3))
    side = ed.Side(*ed.quantised(x))
    true = x @ x.T
    for threshold in (0.5, 0.9, 0.93, 0.99):
        sure, open_ = side.verdicts(side, slice(None), threshold)
        assert not (sure & (true < threshold)).any() and not (~sure & ~open_ & (true >= threshold)).any()
        assert open_.mean() < 0.2


def test_classes_of_one_block():
    """A class that is joined only through a row that is a left and a right side."""
    links = np.zeros((4, 4), bool)
    for i, j in ((2, 3), (0, 3), (1, 2)):
        links[i, j] = links[j, i] = True
    node = np.arange(10, 14)
    assert [list(r) for r in ed.local_roots(links, node, node)] == [[10] * 4] * 2
