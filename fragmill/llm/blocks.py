"""A stated query set against all vectors, block by block.

Vectors are packed into block rows of a bounded number of vectors. Candidate blocks are dealt
over groups; each query block goes to every group once, and an equi-join on the group pairs them.
A task then holds few pairs of blocks at a time, whatever the tables' size, and gives each query's
best of the block, which are merged in the JVM.

Cases: finite() leaves out null ids, null vectors and vectors with a null or non-finite component; empty vectors are
vectors of dimension 0. Vectors of different dimension never meet. No candidates or no queries: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Vectors in a candidate block and in a query block.
ROWS, QUERIES = 8192, 1024
_BLOCK = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])


def finite(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part: neither is null, all components are finite."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)


def blocks(vectors: DataFrame, rows: int, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """Rows of finite() in blocks of one dimension, ascending in vec_id: dim, n, ids, data = encode(matrix)."""

    def block(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, int, bytes, bytes]:
        ids, x = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
        order = np.argsort(ids, kind="stable")
        return x.shape[1], len(ids), ids[order].tobytes(), encode(np.ascontiguousarray(x[order]))

    def out(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(block(held), _BLOCK.types, strict=True)], schema=_BLOCK)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ids, lists = np.asarray(batch.column("vec_id")), batch.column("embedding")
            sizes, flat = np.diff(np.asarray(lists.offsets)), np.asarray(lists.flatten())
            at = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                which = np.flatnonzero(sizes == dim)
                x = flat[at[which][:, None] + np.arange(dim)].reshape(len(which), int(dim))
                for k in range(0, len(which), rows):
                    mine = held.setdefault(int(dim), [])
                    mine.append((ids[which[k : k + rows]], x[k : k + rows]))
                    if sum(len(a) for a, _ in mine) >= rows:
                        yield out(mine)
                        held[int(dim)] = []
        for mine in held.values():
            if mine:
                yield out(mine)

    return vectors.mapInArrow(run, "dim int, n int, ids binary, data binary")


def search(
    candidates: DataFrame,
    queries: DataFrame,
    n: int,
    k: int,
    encode: Callable[[np.ndarray], bytes],
    encode_query: Callable[[np.ndarray], bytes],
    best: Callable[[int, np.ndarray, bytes, np.ndarray, bytes, int], Iterator[tuple[int, np.ndarray, np.ndarray]]],
    score: pa.DataType,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, ties to the smaller vec_id.

    n: the candidates' number, from which the number of groups follows. best gives, for a pair of
    blocks, each query's position with the ids and scores of its (at least k, if there are) best; score is their type.
    A batch's bytes are bounded (small_batches), so a task holds few blocks at a time.
    """
    small_batches(candidates.sparkSession)
    groups = max(1, -(-n // ROWS))
    spread = candidates.repartition(min(groups, 4096)) if groups > 1 else candidates
    number = F.monotonically_increasing_id()  # a partition's number above 33 bits, a row's below
    dealt = F.shiftright(number, 33) + number.bitwiseAND(F.lit((1 << 33) - 1))
    c = cut(blocks(spread, ROWS, encode).withColumn("g", F.pmod(dealt, F.lit(groups))))
    q = cut(blocks(queries, QUERIES, encode_query))
    q = q.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("q_g"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                out: list[list[np.ndarray]] = [[], [], []]
                for position, found, scores in best(row["dim"], ids, row["data"], q_ids, row["q_data"], k):
                    out[0].append(np.full(len(found), q_ids[position]))
                    out[1].append(found)
                    out[2].append(scores)
                if out[0]:
                    types = (pa.int64(), pa.int64(), score)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(out, types, strict=True)], names=["query_id", "vec_id", "score"])

    pairs = q.join(c, (F.col("q_g") == F.col("g")) & (F.col("q_dim") == F.col("dim")))
    found = pairs.select("dim", "ids", "data", "q_ids", "q_data").mapInArrow(run, f"query_id long, vec_id long, score {'double' if score == pa.float64() else 'long'}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def every(column: str, step: int) -> Column:
    return F.col(column) % step == 0
