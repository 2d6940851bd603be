"""Exact token counts for every context limit, from the histogram of encoded lengths.

Documents are encoded in place and only (length, documents) leaves a task, summed before the
shuffle. Sums from the long end then answer, for each limit, how many documents and tokens lie at or
beyond it and what a corpus cut to that limit holds. The suffix sums run in two levels, so
that no single task sees every length.

Cases: a null text counts as empty (length 1, the end id). An empty table gives no rows. Repeated
rows count each. A null doc_id counts like any other. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import encoder, table, tokenizer_path, written

#: Lengths of one block of the two-level sums.
BLOCK = 1024


def histogram(docs: DataFrame, tokenizer: str, end_tokens: int = 1) -> DataFrame:
    """length long, docs long: how many documents have each length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held = encoder(tokenizer).encode, Counter()
        for batch in batches:
            held.update(len(ids) // 4 + end_tokens for ids in encode(batch.column("text").to_pylist()))
        yield pa.RecordBatch.from_pydict({"length": pa.array(list(held), pa.int64()), "docs": pa.array(list(held.values()), pa.int64())})

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "length long, docs long")
    return counted.groupBy("length").agg(F.sum("docs").alias("docs"))


def limits(lengths: DataFrame) -> DataFrame:
    """For each length that occurs: documents and tokens of at least it, and the corpus cut to it.

    docs_at_least, tokens_at_least: suffix sums. truncated_tokens: tokens left if every document is
    cut to `length`. docs_at_most / total_docs is the length's quantile: the q-quantile is the first
    row whose docs_at_most >= q * total_docs.
    """
    h = lengths.withColumn("tokens", F.col("length") * F.col("docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    up = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    x = h.withColumn("d_in", F.sum("docs").over(up)).withColumn("t_in", F.sum("tokens").over(up)).join(blocks, "block")
    docs_at_least, tokens_at_least = F.col("d_in") + F.col("d_after"), F.col("t_in") + F.col("t_after")
    return x.select(
        "length",
        "docs",
        docs_at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        (F.col("total_docs") - docs_at_least + F.col("docs")).alias("docs_at_most"),
        (F.col("total_tokens") - tokens_at_least + F.col("length") * docs_at_least).alias("truncated_tokens"),
        "total_docs",
        "total_tokens",
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """truncated_tokens, docs_over and tokens_lost for any limit, one that no document has included."""
    over = F.col("length") > limit
    got = sums.agg(F.sum(F.when(over, F.col("docs"))).alias("o"), F.sum(F.when(over, F.col("length") * F.col("docs"))).alias("t"), F.max("total_tokens").alias("all"))
    o, t, every = (F.coalesce(F.col(c), F.lit(0)) for c in ("o", "t", "all"))
    return got.select((every - t + o * limit).alias("truncated_tokens"), o.alias("docs_over"), (t - o * limit).alias("tokens_lost"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents doesn't exceed; null if there are none."""
    return sums.where(F.col("docs_at_most") >= F.ceil(q * F.col("total_docs"))).agg(F.min("length").alias("length"))


def op6_token_counts(spark, sf_dir):
    # Both levels of the sums read the histogram: written once, documents are encoded once.
    lengths = written(histogram(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")), "lengths")
    return limits(lengths)
