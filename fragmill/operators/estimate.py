"""Abundance by expectation-maximisation, plain or variational.

Classes are in an array layout, packed into blocks that are written once. Up to MAX_TARGETS targets the model is one number a
target in the driver: a Problem. Up to LOCAL_MEMBERS members of classes (collapsed, so far fewer than fragments) are then fetched
once and every step runs on them in place; beyond it the model travels with each step's tasks, which read the blocks as they are
and give back sums of the targets they saw. Beyond MAX_TARGETS the model is a table too, and a step joins it with the members:
converged_frame(). Classes of one target are summed once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kmers
from ..shared import cut, written

MIN_ALPHA, PRIOR, MIN_ITERATIONS, TOLERANCE, MAX_ITERATIONS, CHECK = 1e-8, 0.01, 50, 0.01, 10_000, 1e-2
#: Steps before which effective lengths are worked out again, where a model of bias is given.
RECOMPUTE_AT = (50, 500, 1000)
#: Targets up to which the model is held in memory: about 60 bytes a target in the driver, 16 in a task.
MAX_TARGETS = 10_000_000
#: Members of classes up to which steps run in the driver: about 50 MB.
LOCAL_MEMBERS = 4_000_000

#: From the targets' ids, their current abundances and lengths to new lengths.
Recompute = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def shares(rate: np.ndarray, tids: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A step's sum for each target over classes of members tids, at[k] the first of class k, n their counts."""
    return np.bincount(tids, members_shares(rate, tids, at, n), len(rate)) if len(n) else np.zeros(len(rate))


def _arrays(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    at = np.asarray(lists.offsets)
    return np.asarray(lists.flatten()), at - at[0]


def digamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    out = np.log(y) - 0.5 / y
    for k, c in enumerate((-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132), 1):
        out += c / y ** (2 * k)
    for k in range(6):
        out -= 1 / (x + k)
    return out


#: The columns of a block of classes: its number, the members of classes of several targets, where each class begins and their
#: end, the classes' counts, and targets that are a class of their own, with their counts. All but the first are arrays' bytes.
_BLOCK = {"tids": np.int32, "at": np.int64, "n": np.float64, "ones": np.int32, "ones_n": np.float64}
_BLOCKS = "block long, size long, total double, " + ", ".join(f"{c} binary" for c in _BLOCK)
#: Members of a block, and targets of a row of sums.
BLOCK_MEMBERS, CHUNK = 1_000_000, 1_000_000
#: Sums of targets up to which each task's go to the driver; more are added up in a shuffle first.
DRIVER_SUMS = 8_000_000

#: Adds what a block (a dictionary of its arrays) gives to sums of a row a model and a column a target.
Part = Callable[[dict[str, np.ndarray], np.ndarray], None]


def spread(total: np.ndarray, tids: np.ndarray, values: np.ndarray) -> None:
    """Adds values to their targets' sums: a block's targets lie near each other, so only their stretch is touched."""
    if len(tids):
        lo, hi = int(tids.min()), int(tids.max())
        total[lo : hi + 1] += np.bincount(tids - lo, values, hi - lo + 1)


def members_shares(rate: np.ndarray, tids: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What each member of the classes gets in a step."""
    if not len(n):
        return np.zeros(0)
    part = rate[tids]
    denominator = np.add.reduceat(part, at[:-1])
    share = np.where(denominator > 0, n / np.where(denominator > 0, denominator, 1), 0)
    return part * np.repeat(share, np.diff(at))


def block_rows(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    for k in range(batch.num_rows):
        yield {"block": batch.column("block")[k].as_py()} | {c: np.frombuffer(batch.column(c)[k].as_buffer() or b"", t) for c, t in _BLOCK.items()}


def block_row(block: int, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    total = float(arrays["n"].sum() + arrays["ones_n"].sum())
    columns = [pa.array([block]), pa.array([len(arrays["tids"])]), pa.array([total])] + [pa.array([np.ascontiguousarray(arrays[c], t).tobytes()], pa.binary()) for c, t in _BLOCK.items()]
    return pa.RecordBatch.from_arrays(columns, names=["block", "size", "total", *_BLOCK])


def sums(blocks: DataFrame, part: Part, n_targets: int, rows: int = 1) -> np.ndarray:
    """The sums of `part` over all blocks, by row and target. A task gives its sums' places and values, at most CHUNK in a row."""

    chunk = CHUNK

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, n_targets))
        for batch in batches:
            for block in block_rows(batch):
                part(block, total)
        yield from given(total)

    def given(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row in range(rows):
            for first in range(0, n_targets, chunk):
                yield from piece(row, first, total[row, first : first + chunk])

    def piece(row: int, first: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(values)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([first]), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([values[at].tobytes()], pa.binary())], names=["row", "first", "at", "m"])

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, first, at, m in arrays(batch):
                if (row, first) not in total:
                    total[row, first] = np.zeros(min(chunk, n_targets - first))
                total[row, first][at] += m
        for (row, first), values in total.items():
            yield from piece(row, first, values)

    def arrays(table: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for r, f, at, m in zip(*(table.column(c).to_pylist() for c in ("row", "first", "at", "m")), strict=True):
            yield r, f, np.frombuffer(at, np.int32), np.frombuffer(m, np.float64)

    schema = "row long, first long, at binary, m binary"
    found = blocks.mapInArrow(run, schema)
    if rows * n_targets > DRIVER_SUMS:
        found = found.repartition("row", "first").mapInArrow(added, schema)
    out = np.zeros((rows, n_targets))
    for row, first, at, m in arrays(found.toArrow()):
        out[row, first + at] += m
    return out


class Problem:
    """Classes ready for steps. lengths: tid, eff_length of every target; alpha follows the targets in the order of tid.

    local holds the members, where each class begins and their counts; beyond LOCAL_MEMBERS it is None and blocks is a table.
    """

    def __init__(self, eq: DataFrame, lengths: DataFrame):
        self.n_targets = lengths.count()
        if self.n_targets > MAX_TARGETS:
            raise ValueError(f"{self.n_targets} targets; a model of more than {MAX_TARGETS} is a table: converged_frame()")
        table = lengths.select(F.col("tid").cast("long"), F.col("eff_length").cast("double")).toArrow()
        order = np.argsort(np.asarray(table.column("tid")), kind="stable")
        self.tids = np.asarray(table.column("tid"))[order]
        self.lengths = np.maximum(1.0, np.asarray(table.column("eff_length"))[order])
        # Written, so that a block stays the same if it is lost from memory.
        self.blocks = written(self._blocks(eq.select(F.col("label").cast("array<long>").alias("label"), F.col("count").cast("double").alias("n"))), "blocks").persist(StorageLevel.MEMORY_AND_DISK)
        size, total = self.blocks.agg(F.sum("size"), F.sum("total")).first()
        self.mapped = total or 0.0
        self.local = None
        if (size or 0) <= LOCAL_MEMBERS:
            held = [b for batch in self.blocks.orderBy("block").toArrow().to_batches() for b in block_rows(batch)]
            ends = np.cumsum([0] + [len(b["tids"]) for b in held])
            flat = lambda c: np.concatenate([b[c] for b in held] or [np.zeros(0, _BLOCK[c])])
            at = np.concatenate([b["at"][:-1] + e for b, e in zip(held, ends, strict=False)] + [ends[-1:]])
            self.local = flat("tids"), at, flat("n")
            self.single = np.zeros(self.n_targets)
            np.add.at(self.single, flat("ones"), flat("ones_n"))
            self.active = self.single > 0
            self.active[self.local[0]] = True
            return

        def first(block: dict[str, np.ndarray], total: np.ndarray) -> None:
            spread(total[0], block["ones"], block["ones_n"])
            spread(total[1], block["tids"], np.ones(len(block["tids"])))

        self.single, n_classes = sums(self.blocks, first, self.n_targets, 2)
        self.active = (self.single > 0) | (n_classes > 0)

    def _blocks(self, eq: DataFrame) -> DataFrame:
        """Classes with the targets' ranks for their ids, in blocks; a target that isn't in the table is an error.

        Classes lie in the order of their labels, so that those that share targets often lie in one block.
        """
        spark = eq.sparkSession
        tids, most = spark.sparkContext.broadcast(self.tids), BLOCK_MEMBERS

        def ranked(flat: np.ndarray) -> np.ndarray:
            rank = np.searchsorted(tids.value, flat)
            if len(flat) and not (len(tids.value) and (tids.value[np.minimum(rank, len(tids.value) - 1)] == flat).all()):
                raise ValueError("a class has a target that has no length")
            return rank.astype(np.int32)

        def packed(number: int, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            flat, size, n = (np.concatenate([r[k] for r in rows]) for k in range(3))
            one, of = size == 1, np.repeat(size, size)
            arrays = {"tids": flat[of > 1], "at": np.concatenate([[0], np.cumsum(size[size > 1])]), "n": n[size > 1], "ones": flat[of == 1], "ones_n": n[one]}
            return block_row(number, arrays)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number, held, rows = TaskContext.get().partitionId() << 32, 0, []
            for batch in batches:
                flat, at = _arrays(batch.column("label"))
                rows.append((ranked(flat), np.diff(at), np.asarray(batch.column("n"))))
                held += len(flat)
                if held >= most:
                    yield packed(number, rows)
                    number, held, rows = number + 1, 0, []
            if rows:
                yield packed(number, rows)

        return eq.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "label").mapInArrow(run, _BLOCKS)

    def close(self) -> None:
        self.blocks.unpersist()

    def start(self) -> np.ndarray:
        return np.where(self.active, self.mapped / max(1, self.active.sum()), 0.0)

    def step(self, alpha: np.ndarray, variational: bool = False) -> np.ndarray:
        if variational:
            theta = np.where(alpha > 0, np.exp(digamma(np.maximum(alpha, 1e-300)) - float(digamma(np.array([alpha.sum()]))[0])), 0.0)
        else:
            theta = alpha
        rate = theta / self.lengths  # a class's normalisation of its weights cancels

        out = self.single + (PRIOR if variational else 0.0)
        if self.local:
            return out + shares(rate, *self.local)

        rates = self.blocks.sparkSession.sparkContext.broadcast(rate)

        def part(block: dict[str, np.ndarray], total: np.ndarray) -> None:
            spread(total[0], block["tids"], members_shares(rates.value, block["tids"], block["at"], block["n"]))

        try:
            return out + sums(self.blocks, part, self.n_targets)[0]
        finally:
            rates.destroy()

    def _before(self, done: int, alpha: np.ndarray, recompute: Recompute | None, at: tuple[int, ...]) -> None:
        if recompute is not None and done in at:
            self.lengths = np.maximum(1.0, recompute(self.tids, alpha, self.lengths))

    def fixed(self, steps: int, variational: bool = False, recompute: Recompute | None = None, at: tuple[int, ...] = RECOMPUTE_AT) -> np.ndarray:
        alpha = self.start()
        for done in range(steps):
            self._before(done, alpha, recompute, at)
            alpha = self.step(alpha, variational)
        return alpha

    def converged(
        self, variational: bool = False, tolerance: float = TOLERANCE, most: int = MAX_ITERATIONS, least: int = MIN_ITERATIONS, recompute: Recompute | None = None, at: tuple[int, ...] = RECOMPUTE_AT
    ) -> tuple[np.ndarray, int]:
        """Abundances and steps. recompute gives new lengths before the steps in `at`, if steps go on until there."""
        alpha, done = self.start(), 0
        while done < most:
            self._before(done, alpha, recompute, at)
            new = self.step(alpha, variational)
            done += 1
            change = max_change(alpha, new)
            alpha = new
            if done >= least and change <= tolerance:
                break
        return truncated(alpha, MIN_ALPHA + (PRIOR if variational else 0)), done


def max_change(old: np.ndarray, new: np.ndarray) -> float:
    at = new > CHECK
    return float((np.abs(old[at] - new[at]) / new[at]).max()) if at.any() else 0.0


def truncated(alpha: np.ndarray, cutoff: float = MIN_ALPHA) -> np.ndarray:
    out = np.where(alpha <= cutoff, 0.0, alpha)
    if not math.isfinite(out.sum()) or out.sum() <= 0:
        raise ValueError("no target has any abundance")
    return out


def abundances(spark: SparkSession, alpha: np.ndarray, tids: np.ndarray | None = None) -> DataFrame:
    """tid int, num_reads double."""
    ids = np.arange(len(alpha)) if tids is None else tids
    return spark.createDataFrame(pa.table({"tid": pa.array(ids, pa.int32()), "num_reads": pa.array(alpha, pa.float64())}))


def abundance(eq: DataFrame, lengths: DataFrame, variational: bool = False, steps: int | None = None, recompute: Recompute | None = None, at: tuple[int, ...] = RECOMPUTE_AT) -> DataFrame:
    """tid, num_reads of every target of lengths (tid, eff_length): after `steps` steps, or converged."""
    if lengths.count() > MAX_TARGETS:
        if recompute is not None:
            raise ValueError(f"lengths are worked out again for at most {MAX_TARGETS} targets")
        return converged_frame(eq, lengths, variational, steps=steps)
    problem = Problem(eq, lengths)
    try:
        alpha = problem.converged(variational, recompute=recompute, at=at)[0] if steps is None else problem.fixed(steps, variational, recompute, at)
    finally:
        problem.close()
    return abundances(eq.sparkSession, alpha, problem.tids)


def with_tpm(quant: DataFrame) -> DataFrame:
    """Adds tpm to tid, eff_length, num_reads."""
    rate = F.when(F.col("eff_length") > 0, F.col("num_reads") / F.col("eff_length")).otherwise(0.0)
    total = quant.agg(F.sum(rate).alias("_t"))
    return quant.join(F.broadcast(total), F.lit(True)).withColumn("tpm", 1e6 * rate / F.col("_t")).drop("_t")


def relative_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row, max_rel_diff of (tid, alpha) tables, over new values above 0.01."""
    j = old.select("tid", F.col("alpha").alias("a")).join(new.select("tid", F.col("alpha").alias("b")), "tid")
    return j.agg(F.max(F.when(F.col("b") > CHECK, F.abs(F.col("a") - F.col("b")) / F.col("b"))).alias("max_rel_diff"))


def validity(weighted: DataFrame, alpha: DataFrame) -> DataFrame:
    """label, valid of collapse.weights() rows: whether a class has any weight under alpha."""
    j = weighted.join(alpha, "tid", "left").groupBy("label").agg(F.sum(F.coalesce("alpha", F.lit(0.0)) * F.col("w")).alias("d"))
    return j.select("label", (F.col("d") > 0).alias("valid"))


def truncate(table: DataFrame, cutoff: float = MIN_ALPHA, column: str = "num_reads") -> DataFrame:
    """A table with abundances up to the cutoff set to zero."""
    return table.withColumn(column, F.when(F.col(column) <= cutoff, 0.0).otherwise(F.col(column)))


def normalise(table: DataFrame, column: str) -> DataFrame:
    """A column divided by its sum; as it is where that is not positive."""
    total = F.broadcast(table.agg(F.sum(column).alias("_total")))
    return table.join(total, F.lit(True)).withColumn(column, F.when(F.col("_total") > 0, F.col(column) / F.col("_total")).otherwise(F.col(column))).drop("_total")


def em_frame(members: DataFrame, steps: int) -> DataFrame:
    """EM as one lazy plan. members: label, tid, w, count. tid, alpha."""
    base = members.groupBy("tid").agg(F.lit(1).alias("one"))
    total = members.select("label", "count").distinct().agg(F.sum("count").alias("t"))
    n = base.agg(F.count("*").alias("k"))
    alpha = base.join(F.broadcast(total), F.lit(True)).join(F.broadcast(n), F.lit(True)).select("tid", (F.col("t") / F.col("k")).alias("alpha"))
    for _ in range(steps):
        alpha = _frame_step(members, alpha)
    return alpha


def _frame_step(members: DataFrame, rate: DataFrame) -> DataFrame:
    """tid, alpha after a step from (tid, alpha) rates. Members stay where their classes are; classes of one target keep their count."""
    part = members.join(rate, "tid").withColumn("p", F.col("alpha") * F.col("w"))
    of = Window.partitionBy("label")
    part = part.withColumn("d", F.sum("p").over(of)).withColumn("size", F.count("*").over(of))
    share = F.when(F.col("size") == 1, F.col("count")).when(F.col("d") > 0, F.col("count") * F.col("p") / F.col("d")).otherwise(0.0)
    return part.groupBy("tid").agg(F.sum(share).alias("alpha"))


def converged_frame(eq: DataFrame, lengths: DataFrame, variational: bool = False, tolerance: float = TOLERANCE, most: int = MAX_ITERATIONS, least: int = MIN_ITERATIONS, steps: int | None = None) -> DataFrame:
    """tid, num_reads as Problem gives them, for models of any size: the model is a table, written after each step. steps: that many, without a test."""
    w = eq.select("label", "count", F.posexplode("label").alias("ord", "tid")).join(lengths.select("tid", (1 / F.greatest(F.col("eff_length"), F.lit(1.0))).alias("w")), "tid")
    members = cut(w.select("label", F.col("tid"), "w", F.col("count").cast("double").alias("count")).repartition("label"))
    mapped, prior = eq.agg(F.sum("count")).first()[0] or 0, PRIOR if variational else 0.0
    used = members.select("tid").distinct()
    every = lengths.select("tid")
    alpha = cut(every.join(used.withColumn("alpha", F.lit(mapped / max(1, used.count()))), "tid", "left").select("tid", F.coalesce("alpha", F.lit(0.0)).alias("alpha")))
    done = 0
    while done < (most if steps is None else steps):
        rate = alpha
        if variational:
            # digamma of the sum cancels in a class.
            rate = alpha.select("tid", F.when(F.col("alpha") > 0, F.exp(kmers.digamma(F.col("alpha")))).otherwise(0.0).alias("alpha"))
        new = every.join(_frame_step(members, rate), "tid", "left").select("tid", (F.coalesce("alpha", F.lit(0.0)) + prior).alias("alpha"))
        before, alpha, done = alpha, cut(new), done + 1
        if steps is None and done >= least and (relative_change(before, alpha).first()[0] or 0.0) <= tolerance:
            break
    if steps is not None:
        return alpha.withColumnRenamed("alpha", "num_reads")
    return truncate(alpha.select("tid", F.col("alpha").alias("num_reads")), MIN_ALPHA + prior)
