"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import rolling


@udtf(returnType="pos int, code long")
class Kmers:
    """kmers(seq, k): place and code of each k-mer without an unknown base."""

    def eval(self, seq: str, k: int):
        if seq is not None:
            for pos, code in enumerate(rolling.codes(seq, k).tolist()):
                if code >= 0:
                    yield pos, code


def register(spark: SparkSession) -> None:
    spark.udtf.register("kmers", Kmers)
