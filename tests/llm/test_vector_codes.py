"""Codes, errors and codebooks against a full search in plain integers."""

import hashlib

import numpy as np
import pytest

from tidemark.llm import vector_codes as vc

SCHEMA = "vec_id long, label int, embedding array<double>, code string, error string"


def brute(rows, parts, entries, rounds, scale=1024):
    kept = [r for r in rows if r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.floor(np.array(r[2], float) * scale).astype("<i4").tobytes()))
    width = -(-max((len(r[2]) for r in kept), default=0) // parts) * parts
    x = np.zeros((len(kept), width), np.int64)
    for i, r in enumerate(kept):
        x[i, : len(r[2])] = np.floor(np.array(r[2], float) * scale)
    d, codes, dist, books = width // parts, [], [], []
    for p in range(parts):
        part = x[:, p * d : (p + 1) * d]
        book = part[:entries].copy()
        for k in range(rounds + 1):
            far = ((part[:, None] - book[None]) ** 2).sum(2)
            code = far.argmin(1) if len(part) else np.empty(0, int)
            if k < rounds:
                for e in set(code.tolist()):
                    rows_ = part[code == e]
                    book[e] = [int(s) // len(rows_) for s in rows_.sum(0)]
        codes.append(code)
        dist.append(far[np.arange(len(part)), code])
        books.append(book)
    error = sum(dist)
    total = {}
    for r, e in zip(kept, error, strict=True):
        total[r[1]] = total.get(r[1], 0) + int(e)
    sha = hashlib.sha256(",".join(str(int(n)) for b in books for e in b for n in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{codes[p][i]:02x}" for p in range(parts)), int(error[i]), total[r[1]], sha) for i, r in enumerate(kept)), key=repr)


def made(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA).repartition(3)
    return sorted(((r.vec_id, bytes(r.code).hex(), r.error, r.label_error, r.codebooks_sha256) for r in vc.encode(df, **how).collect()), key=repr)


@pytest.mark.parametrize(("seed", "dim", "values"), [(1, 8, "normal"), (2, 16, "few"), (3, 12, "clusters")])
def test_codes(spark, monkeypatch, seed, dim, values):
    """Ties abound with few values; balls are small and still with clusters."""
    rng = np.random.default_rng(seed)
    if values == "few":
        x = rng.integers(-2, 3, size=(600, dim)) / 512
    elif values == "clusters":
        x = rng.normal(size=(30, dim))[rng.integers(30, size=600)] + 0.01 * rng.normal(size=(600, dim))
    else:
        x = rng.normal(size=(600, dim))
    monkeypatch.setattr(vc, "CHUNK", 100)
    rows = [(int(i), int(rng.integers(4)) if i % 9 else None, list(map(float, v))) for i, v in enumerate(x)]
    assert made(spark, rows, entries=40, rounds=4) == brute(rows, 4, 40, 4)


def test_balls_skip_and_agree():
    """Rounds by balls equal a full search, and still balls skip work."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(20, 6))[rng.integers(20, size=4000)] * 1000 + rng.normal(size=(4000, 6)) * 5).astype(np.int64)
    ball, code, dist, still = vc.Balls(x[:50].copy()), None, None, 0
    for _ in range(6):
        code, dist = ball.assign(x, code, dist)
        full = vc.squares(x, ball.entries)
        assert (code == full.argmin(1)).all() and (dist == full.min(1)).all()
        new, far = ball.entries.copy(), np.full(50, -1)
        for e in set(code.tolist()):
            new[e] = x[code == e].sum(0) // (code == e).sum()
            far[e] = dist[code == e].max()
        ball = vc.Balls(new, ball.entries, far)
        still += ball.still.sum()
    assert still > 0


def test_squares_are_exact():
    big = np.array([[2**28, -(2**28), 3], [5, 6, 7]], np.int64)
    assert vc.squares(big, big[::-1]).tolist() == [[int(sum((a - b) ** 2 for a, b in zip(r, c, strict=True))) for c in big[::-1].tolist()] for r in big.tolist()]


def test_odd_rows(spark):
    rows = [(5, 1, [0.5, -0.5, 0.25, 0.1]), (5, 1, [0.5, -0.5, 0.25, 0.1]), (None, None, [0.1, 0.2, 0.3, 0.4]), (1, 1, None), (2, 1, [0.1, None, 0.2, 0.3]), (3, 2, [float("nan")] * 4)]
    rows += [(4, 2, [float("inf"), 0.0, 0.0, 0.0]), (6, None, [0.1, 0.2, 0.3]), (7, 1, []), (8, 3, [-0.0001] * 5), (9, 2, [-3.0, 2.9, 0.0, 1.0])]
    assert made(spark, rows) == brute(rows, 4, 256, 4)
    assert len(made(spark, [(1, 1, [1e300, -1e300, 0.0, 0.0])])) == 1


def test_empty(spark):
    assert made(spark, []) == [] and made(spark, [(1, 1, None)]) == []
