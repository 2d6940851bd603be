"""Equivalence classes: fragments grouped by their set of targets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Targets whose lengths are sent to all tasks (16 bytes each).
SENT = 10_000_000


def classes(labels: DataFrame) -> DataFrame:
    """label, count. Counts are summed before the shuffle, so a common label is no hot key."""
    return labels.groupBy("label").agg(F.count("*").alias("count"))


def members(eq: DataFrame) -> DataFrame:
    """label, count, ord, tid: a row for each member, duplicates apart."""
    return eq.select("label", "count", F.posexplode("label").alias("ord", "tid"))


def _sent(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Targets in their order and one over their lengths; None if there are more than SENT, or a target twice."""
    table = lengths.select(F.col("tid").cast("long"), (1 / F.greatest(F.col("eff_length").cast("double"), F.lit(1.0))).alias("inv")).where("tid IS NOT NULL").limit(SENT + 1).toArrow()
    tids, inv = np.asarray(table.column("tid")), np.asarray(table.column("inv"))
    order = np.argsort(tids, kind="stable")
    tids, inv = tids[order], inv[order]
    return None if len(tids) > SENT or (tids[1:] == tids[:-1]).any() else (tids, inv)


def weights(eq: DataFrame, lengths: DataFrame, summed: bool = False) -> DataFrame:
    """members() with w: one over the effective length, normalised in the class. lengths: tid, eff_length.

    summed: label, tid, w instead, a class's weights of one target in one row. Up to SENT targets their lengths go to the
    tasks that have the classes, and no member is moved.
    """
    held = _sent(lengths)
    if held is None:
        w = members(eq).join(lengths.select("tid", (1 / F.greatest(F.col("eff_length"), F.lit(1.0))).alias("inv")), "tid")
        w = w.withColumn("w", F.col("inv") / F.sum("inv").over(Window.partitionBy("label"))).drop("inv")
        return w.groupBy("label", "tid").agg(F.sum("w").alias("w")) if summed else w
    shared = eq.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tids, inv = shared.value
        for batch in batches:
            label = batch.column("label")
            at = np.asarray(label.offsets)
            flat, size = np.asarray(label.flatten()), np.diff(at)
            of = np.repeat(np.arange(len(size)), size)
            rank = np.minimum(np.searchsorted(tids, flat), max(0, len(tids) - 1))
            known = np.flatnonzero(tids[rank] == flat) if len(tids) else np.zeros(0, int)
            part, of, ord_ = inv[rank[known]] if len(known) else np.zeros(0), of[known], known - (at - at[0])[of[known]]
            w, tid = part / np.bincount(of, part, len(size))[of], flat[known]
            if summed:
                order = np.lexsort((tid, of))
                of, tid, w = of[order], tid[order], w[order]
                first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (tid[1:] != tid[:-1])]) if len(of) else np.zeros(0, int)
                of, tid, w = of[first], tid[first], np.add.reduceat(w, first) if len(first) else w
                columns = {"label": label.take(pa.array(of)), "tid": pa.array(tid, label.type.value_type), "w": pa.array(w)}
            else:
                columns = {"label": label.take(pa.array(of)), "count": batch.column("count").take(pa.array(of)), "ord": pa.array(ord_, pa.int32()), "tid": pa.array(tid, label.type.value_type), "w": pa.array(w)}
            yield pa.RecordBatch.from_pydict(columns)

    kind = dict(eq.dtypes)
    tid = kind["label"][len("array<") : -1]
    schema = f"label {kind['label']}, tid {tid}, w double" if summed else f"label {kind['label']}, count {kind['count']}, ord int, tid {tid}, w double"
    return eq.select("label", "count").mapInArrow(run, schema)


def active(eq: DataFrame) -> DataFrame:
    return eq.select(F.explode("label").alias("tid")).distinct()


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """Classes of two sets of fragments together."""
    return one.unionByName(other).groupBy("label").agg(F.sum("count").alias("count"))
