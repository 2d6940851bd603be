"""Approximate nearest neighbours by inner product, from randomly rotated one-bit codes.

A unit vector is padded, turned by a random rotation and kept as the signs of its components, in
packed bits, with two scalars: the vector's length and the code's agreement with what it codes. A
query is turned too and quantised to a few bits, so that its product with a code is a sum of bit
counts. The product divided by the agreement estimates the inner product without bias, and the
agreement bounds the error. The exact products of the vectors with the best estimates give a k-th best; whatever could
reach it by its upper bound is ranked again by the original vectors in double precision.

The index needs no training; every row is indexed. Cases: null vectors, null ids, zero vectors and vectors with a
null or non-finite component take no part. Vectors of different length aren't compared. Equal scores go to the
smaller vec_id. Rows of a query's own vec_id aren't candidates of it; a vec_id in several rows is one query and a
candidate for each row. Fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import every, finite, search
from .common import table

K, QUERY_EVERY, SEED = 20, 20, 20260
#: Bits of a code for each component; bits of a query's component; width of the error bound in standard deviations.
EXPANSION, QUERY_BITS, EPSILON = 4, 4, 3.0
#: Vectors of the best estimates, for each of the k, whose exact products give the k-th best to reach.
AHEAD = 3


@lru_cache(maxsize=8)
def rotation(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """dim rows of a random rotation of `bits` dimensions: all that vectors padded with zeros meet."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, bits]).standard_normal((bits, dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def code_bits(dim: int) -> int:
    return -(-dim * EXPANSION // 64) * 64


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs (words by vectors), lengths, agreements of the rows of x."""
    bits = code_bits(x.shape[1])
    norms = np.sqrt((x * x).sum(axis=1))
    turned = (x / norms[:, None]) @ rotation(x.shape[1], bits)
    words = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    return np.ascontiguousarray(words.T), norms, np.abs(turned).sum(axis=1) / np.sqrt(bits)


def encode(x: np.ndarray) -> bytes:
    words, norms, agreement = codes(x)
    return b"".join(a.tobytes() for a in (words, norms, agreement, x))


#: Rounding errors of products, of the vectors' lengths.
SLACK = 1e-12


def exact(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, added up from the first component to the last."""
    return np.cumsum(x * query, axis=1)[:, -1]


def best(dim: int, ids: np.ndarray, data: bytes, q_ids: np.ndarray, q_data: bytes, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    n, bits = len(ids), code_bits(dim)
    whole = np.frombuffer(data, np.uint64)
    n_words = bits // 64
    words = whole[: n_words * n].reshape(n_words, n)
    norms, agreement = whole[n_words * n : (n_words + 2) * n].view(np.float64).reshape(2, n)
    x = whole[(n_words + 2) * n :].view(np.float64).reshape(n, dim)
    queries = np.frombuffer(q_data, np.float64).reshape(len(q_ids), dim)
    ones = np.bitwise_count(words).sum(axis=0, dtype=np.int64)
    spread = np.sqrt(np.maximum(0, 1 - agreement**2)) / agreement / np.sqrt(bits - 1) * EPSILON
    for position, query in enumerate(queries):
        length = np.sqrt((query * query).sum())
        turned = (query / length) @ rotation(dim, bits)
        low = turned.min()
        step = (turned.max() - low) / ((1 << QUERY_BITS) - 1) or 1.0
        levels = np.rint((turned - low) / step).astype(np.uint8)
        count = np.zeros(n, np.int64)
        for b in range(QUERY_BITS):
            plane = np.packbits(levels >> b & 1, bitorder="little").view(np.uint64)
            part = np.bitwise_count(words[0] & plane[0]).astype(np.uint16)
            for w in range(1, n_words):
                part += np.bitwise_count(words[w] & plane[w])
            count += part.astype(np.int64) << b
        product = (2 * (low * ones + step * count) - turned.sum()) / np.sqrt(bits)
        # Rounding a query's component errs by up to half a step, in both directions alike.
        error = (spread + EPSILON * step / np.sqrt(12) / agreement) * norms
        estimate = product / agreement * norms
        own = slice(np.searchsorted(ids, q_ids[position], "left"), np.searchsorted(ids, q_ids[position], "right"))
        estimate[own] = -np.inf
        again, others = np.arange(n), n - (own.stop - own.start)
        if others > AHEAD * k:
            first = np.argpartition(estimate, n - AHEAD * k)[n - AHEAD * k :]
            least = np.partition(exact(x[first], query), (AHEAD - 1) * k)[(AHEAD - 1) * k]
            again = np.flatnonzero(estimate + error >= least - SLACK * length * np.abs(norms).max())
            again = np.union1d(again, first)
        again = again[estimate[again] > -np.inf]
        scores = exact(x[again], query)
        if len(again) > k:
            keep = np.lexsort((again, -scores))[:k]
            again, scores = again[keep], scores[keep]
        yield position, ids[again], scores


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id long, rank int, vec_id long, score double: each query's k nearest found, nearest first."""
    nonzero = F.exists("embedding", lambda e: e != 0)
    candidates = finite(vectors).where(nonzero)
    return search(candidates, finite(queries).where(nonzero), candidates.count(), k, encode, lambda x: x.tobytes(), best, pa.float64())


def op10_one_bit_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(every("vec_id", QUERY_EVERY)))
