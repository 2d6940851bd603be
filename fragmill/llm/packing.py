"""Best-fit packing of token sequences.

Bounded-space online best-fit. Documents become pieces of at most `size` tokens (only longer
documents are cut; the first piece takes the odd rest, so every later one is full). Pieces arrive
in a pseudo-random order and each goes to the open bin with the least sufficient free space. A
fixed number of bins is open at a time; free spaces that some open bin has are the set bits of one
integer, so the best fit is the lowest set bit at or above the piece's length. A bin without free
space closes at once; when too many are open, the fullest closes.

Cases: a null or empty text is the end id alone. An empty table gives no rows. Repeated rows are
separate documents. Rows of equal doc_id are packed each for itself. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoder, table, tokenizer_path

SIZE, END_ID, OPEN_BINS = 1024, 2, 2048


class BestFit:
    """Bins of `size`, at most `open_bins` of them open."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free = 0  # bit f: an open bin has f tokens of free space
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]  # open bins' numbers by free space
        self.n_open = self.n_bins = 0

    def put(self, length: int) -> tuple[int, int]:
        """The bin's number and the place in it."""
        fit = self.free >> length
        if fit:
            space = length + (fit & -fit).bit_length() - 1
            held = self.bins[space]
            number = held.pop()
            if not held:
                self.free ^= 1 << space
            self.n_open -= 1
        else:
            space, number = self.size, self.n_bins
            self.n_bins += 1
        left = space - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.n_open += 1
            if self.n_open > self.open_bins:
                fullest = (self.free & -self.free).bit_length() - 1
                self.bins[fullest].pop()
                if not self.bins[fullest]:
                    self.free ^= 1 << fullest
                self.n_open -= 1
        return number, self.size - space


def cuts(n_tokens: int, size: int) -> Iterator[tuple[int, int]]:
    """Start and length of a document's pieces."""
    start, length = 0, n_tokens % size or min(n_tokens, size)
    while start < n_tokens:
        yield start, length
        start, length = start + length, size


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document (doc_id, text). One pass in place, no shuffle."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            texts = batch.column("text").to_pylist()
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids = memoryview(ids + end)
                for k, (start, length) in enumerate(cuts(len(ids) // 4, size)):
                    for to, x in zip(rows, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, _PIECES.types, strict=True)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


_PLACED = _PIECES.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))


def pack(items: DataFrame, size: int = SIZE, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to rows of PIECES; texts and ids don't travel, only these rows.

    Items are dealt by a hash of their ids, in as many partitions as the adaptive planner finds their
    size to need, so that a partition holds many more items than bins are open at its end. Full
    pieces and partial ones are packed alike. The order in a partition is a function of its rows,
    so a task that runs again packs the same sequences.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins = BestFit(size, open_bins)
        for batch in batches:
            got = [bins.put(n) for n in batch.column("length").to_pylist()]
            placed = [pa.array([base + b for b, _ in got], pa.int64()), pa.array([at for _, at in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *placed], schema=_PLACED)

    dealt = items.select("doc_id", "piece", "start", "length", "ids_crc32").hint("rebalance", "doc_id", "piece")
    ordered = dealt.sortWithinPartitions(F.xxhash64("piece", "doc_id", "ids_crc32"), "doc_id", "piece", "ids_crc32")
    return ordered.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    return pack(pieces(docs, tokenizer, size, end_id), size, open_bins)


def op2_best_fit_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
