"""Streaming accumulation: the sums that merge, kept while fragments arrive, and quotas that don't."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import temporary


def eq_classes(labels: DataFrame) -> DataFrame:
    """A stream of (frag_id, label) to label, count so far."""
    return labels.groupBy("label").agg(F.count("*").alias("count"))


def lengths(pairs: DataFrame) -> DataFrame:
    """A stream of unique pairs (frag_id, frag_len) to len, n so far."""
    return pairs.groupBy(F.col("frag_len").alias("len")).agg(F.count("*").alias("n"))


def drain(df: DataFrame, label: str) -> DataFrame:
    """Runs an aggregated stream over all that is there and returns the table it ends with, which is written whole by each batch."""
    spark = df.sparkSession
    at = temporary(spark, label)
    put = lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/table")
    df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/table")


def first_pairs(pairs: DataFrame, quota: int, label: str) -> DataFrame:
    """The first `quota` unique pairs (frag_id, frag_len) of a stream: batches in their order, a batch by frag_id.

    What is taken lies in a folder a batch, so that a batch that runs again replaces its own rows; what earlier batches
    took is counted from there.
    """
    spark = pairs.sparkSession
    at = temporary(spark, label)
    schema = "frag_id long, frag_len long, batch long"

    def put(rows: DataFrame, batch: int) -> None:
        try:
            taken = rows.sparkSession.read.schema(schema).parquet(f"{at}/table").where(F.col("batch") < batch).count()
        except AnalysisException:  # nothing has been taken yet
            taken = 0
        left = max(0, quota - taken)
        some = rows.select(F.col("frag_id").cast("long"), F.col("frag_len").cast("long")).orderBy("frag_id", "frag_len").limit(left)
        some.write.mode("overwrite").parquet(f"{at}/table/batch={batch}")

    pairs.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/table").select("frag_id", "frag_len")


def each_sample(samples: DataFrame, sink) -> None:
    """Hands each sample (sample_id, tid, value) to sink(sample_id, table of tid and value), in the order of samples."""
    for row in samples.select("sample_id").distinct().orderBy("sample_id").collect():
        sink(row.sample_id, samples.where(F.col("sample_id") == row.sample_id).select("tid", "value").orderBy("tid"))
