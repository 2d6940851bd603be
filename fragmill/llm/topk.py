"""Exact top-k search by integer inner product.

Exhaustive term-at-a-time accumulation. A candidate block is turned into postings, for each term
(component) the rows that have it and their weights. A query is its terms that aren't zero; each
scatters its weighted postings into the query's dense array of scores over the block. A partition
selection takes the block's best, and the blocks' best are merged.

Cases: null vectors, null ids and vectors with a null or non-finite component take no part. Vectors of different
length aren't compared. Equal scores go to the smaller vec_id. Rows of a query's own vec_id aren't
candidates of it; a vec_id in several rows is one query (its rows' pairs are merged) and a candidate for each
row. Fewer than k candidates give fewer rows; an empty table gives none. Scores are exact for components of any size: where
64 bits might not hold a block's sums, they are added as whole numbers of any length. A score beyond 64 bits
becomes the nearest 64-bit number and is ranked as that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import every, finite, search
from .common import table

K, SCALE, QUERY_EVERY = 5, 256, 50


def postings(x: np.ndarray) -> list[tuple[slice | np.ndarray, np.ndarray]]:
    """For each term: its rows and their weights. A term that most rows have keeps a dense list."""
    out = []
    for weights in np.ascontiguousarray(x.T):
        rows = np.flatnonzero(weights)
        if 2 * len(rows) > len(weights):
            out.append((slice(None), weights))
        else:
            out.append((rows, weights[rows]))
    return out


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller position."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


#: What a sum in 64 bits may reach, by an estimate that is a little too low at most.
SAFE = 2.0**62
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers that are doubles, as 64-bit integers or, where one is too large, as Python's."""
    if not x.size or np.abs(x).max() < SAFE:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def long_scores(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers of any length, then the nearest 64-bit ones."""
    sums = (whole(x).astype(object) * whole(query).astype(object)).sum(axis=1)
    return np.array([min(max(int(s), _LOW), _HIGH) for s in sums], np.int64)


def best(dim: int, ids: np.ndarray, data: bytes, q_ids: np.ndarray, q_data: bytes, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    x = np.frombuffer(data, np.float64).reshape(len(ids), dim)
    queries = np.frombuffer(q_data, np.float64).reshape(len(q_ids), dim)
    most = np.abs(x).max(axis=0, initial=0.0)
    lists = postings(whole(x)) if most.max(initial=0.0) < SAFE else None
    scores, part = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    for position, query in enumerate(queries):
        if lists is None or np.abs(query) @ most >= SAFE or np.abs(query).max(initial=0.0) >= SAFE:
            scores = long_scores(x, query)
        else:
            scores[:] = 0
            query = whole(query)
            for term in np.flatnonzero(query):
                rows, weights = lists[term]
                got = np.multiply(weights, query[term], out=part[: len(weights)])
                if isinstance(rows, slice):
                    np.add(scores, got, out=scores)
                else:
                    scores[rows] += got
        own = slice(np.searchsorted(ids, q_ids[position], "left"), np.searchsorted(ids, q_ids[position], "right"))
        left = np.delete(np.arange(len(ids)), own) if own.stop > own.start else None
        found = select(scores, k) if left is None else left[select(scores[left], k)]
        yield position, ids[found], scores[found]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """vec_id, embedding against vec_id, embedding: query_id long, rank int, vec_id long, score long."""

    def quantise(x: np.ndarray) -> bytes:
        """Whole numbers as doubles; one too large for a double's range is its largest."""
        with np.errstate(over="ignore"):
            return np.clip(np.floor(scale * x), -np.finfo(float).max, np.finfo(float).max).tobytes()

    candidates = finite(vectors)
    return search(candidates, finite(queries), candidates.count(), k, quantise, quantise, best, pa.int64())


def op4_exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(every("vec_id", QUERY_EVERY)))


OP4_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
