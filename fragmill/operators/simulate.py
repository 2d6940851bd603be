"""Point mutations in sequences, and how many two sets of sequences differ by."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rolling

_BASES = np.frombuffer(b"ACGT", np.uint8)


def mutated(sequences: DataFrame, rate: float, seed: int = 1) -> DataFrame:
    """tid, seq with a share `rate` of the bases, drawn by seed and tid, each replaced by one of the three others. Unknown bases stay."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tid, seq in zip(batch.column("tid").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                rng, codes = np.random.default_rng([seed, tid]), rolling.digits(seq or "")
                hit = (rng.random(len(codes)) < rate) & (codes >= 0)
                letters = np.frombuffer((seq or "").encode("ascii", "replace"), np.uint8).copy()
                letters[hit] = _BASES[(codes[hit] + rng.integers(1, 4, int(hit.sum()))) % 4]
                out.append(None if seq is None else letters.tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(out, pa.string())], names=["tid", "seq"])

    return sequences.select(F.col("tid").cast("int"), "seq").mapInArrow(run, "tid int, seq string")


def differences(one: DataFrame, two: DataFrame) -> DataFrame:
    """tid, length, n: places at which two sequences (tid, seq) differ, up to the shorter one's end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                n = min(len(a), len(b))
                x, y = (np.frombuffer(s[:n].encode("ascii", "replace"), np.uint8) for s in (a, b))
                sizes.append(n)
                found.append(int((x != y).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(sizes, pa.int32()), pa.array(found, pa.int64())], names=["tid", "length", "n"])

    both = one.select(F.col("tid").cast("int"), F.col("seq").alias("a")).join(two.select(F.col("tid").cast("int"), F.col("seq").alias("b")), "tid")
    return both.where("a IS NOT NULL AND b IS NOT NULL").mapInArrow(run, "tid int, length int, n long")


def mutation_rate(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: bases compared, places that differ, their share."""
    sums = differences(one, two).agg(F.sum("length").alias("bases"), F.sum("n").alias("differing"))
    return sums.withColumn("rate", F.col("differing") / F.col("bases"))
