"""Exact and approximate search on large components, many blocks and empty tables."""

import numpy as np
import pytest

from fragmill.llm import ann, blocks, topk

VECTORS = "vec_id long, embedding array<double>, score int"


def whole(x):
    """256 x as a whole number; beyond a double's range, its largest."""
    most = np.finfo(float).max
    with np.errstate(over="ignore"):
        return int(np.clip(np.floor(np.float64(256) * x), -most, most))


def exact_top(rows, k, every):
    want = {}
    for i, e in rows:
        if i % every == 0:
            scores = []
            for j, f in rows:
                if j != i and len(f) == len(e):
                    s = sum(whole(x) * whole(y) for x, y in zip(e, f, strict=True))
                    scores.append((-min(max(s, -(1 << 63)), (1 << 63) - 1), j))
            want[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return {i: v for i, v in want.items() if v}


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e6, 3e7, 1e9, 1e20, 1e306])
def test_scores_of_any_size_are_exact(spark, monkeypatch, scale):
    monkeypatch.setattr(blocks, "ROWS", 32)
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in scale * rng.standard_normal(8)]) for k in range(90)] + [(200, [0.5] * 8), (250, [scale, 0.0])]
    rows[7] = (7, rows[6][1])
    vectors = spark.createDataFrame([(*r, 1) for r in rows], VECTORS)
    got = {}
    for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == exact_top(rows, 5, 50)


def test_recall_over_blocks(spark, monkeypatch):
    """Against brute force on vectors without clusters, in several blocks; scores are the original vectors' products."""
    monkeypatch.setattr(blocks, "ROWS", 256)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 32)) * np.exp(rng.standard_normal((2000, 1)))
    x[10] = x[11]
    vectors = spark.createDataFrame([(k, [float(c) for c in v], 1) for k, v in enumerate(x)], VECTORS)
    got = {}
    for r in ann.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    found = 0
    for q in range(0, 2000, 20):
        s = np.cumsum(x * x[q], axis=1)[:, -1]
        s[q] = -np.inf
        want = set(np.lexsort((np.arange(2000), -s))[:20].tolist())
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(v == s[j] for _, j, v in mine)
        assert [(-v, j) for _, j, v in mine] == sorted((-v, j) for _, j, v in mine)
        found += len(want & {j for _, j, _ in mine})
    assert found >= 0.98 * 2000


def test_empty_tables_and_few_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert ann.nearest(none, none).count() == 0 and topk.top_k(none, none).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (20, [3.0, -1.0], 1), (0, [1.0, 2.0], 1), (None, [1.0, 1.0], 1), (40, None, 1), (60, [0.0, 0.0], 1), (80, [], 1)], VECTORS)
    got = sorted(map(tuple, ann.nearest(few, few.where("vec_id % 20 = 0")).collect()))
    assert got == [(0, 1, 20, 1.0), (0, 2, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 0, 1.0)]
