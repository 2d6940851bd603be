"""The driver's tables as fragments, hits, targets and sequences; the same bindings as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """A line item is a hit: its order is the fragment, its part the target."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    pos, q = F.col("l_linenumber") * 10, F.col("l_quantity").cast("int")
    status = F.when(F.col("l_suppkey") % 7 == 0, "PAIRED_END_LEFT").when(F.col("l_suppkey") % 7 == 1, "PAIRED_END_RIGHT").otherwise("PAIRED_END_PAIRED")
    return li.select(
        F.col("l_orderkey").alias("frag_id"), (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("hit_ord"), F.col("l_partkey").cast("int").alias("tid"), pos.alias("pos"), (F.col("l_linestatus") == "F").alias("fwd"),
        F.lit(50).alias("read_len"), status.alias("mate_status"), (pos + 5 * q).alias("mate_pos"), (F.col("l_returnflag") != "R").alias("mate_fwd"), F.lit(50).alias("mate_len"), (10 * q).alias("frag_len"),
    )


HITS = """hits AS (SELECT l_orderkey AS frag_id, l_linenumber * 100000 + l_suppkey AS hit_ord, l_partkey::INT AS tid, l_linenumber * 10 AS pos, l_linestatus = 'F' AS fwd, 50 AS read_len,
 CASE l_suppkey % 7 WHEN 0 THEN 'PAIRED_END_LEFT' WHEN 1 THEN 'PAIRED_END_RIGHT' ELSE 'PAIRED_END_PAIRED' END AS mate_status,
 l_linenumber * 10 + 5 * floor(l_quantity)::INT AS mate_pos, l_returnflag <> 'R' AS mate_fwd, 50 AS mate_len, 10 * floor(l_quantity)::INT AS frag_len FROM lineitem)"""


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """tid, name, gene, length: a part is a target, its brand the gene."""
    return table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("tid"), F.format_string("t%07d", "p_partkey").alias("name"), F.col("p_brand").alias("gene"), (F.col("p_size") * 20 + 200).alias("length"))


TARGETS = "targets AS (SELECT p_partkey::INT AS tid, printf('t%07d', p_partkey) AS name, p_brand AS gene, p_size * 20 + 200 AS length FROM part)"

_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """tid, seq: a document's letters as bases."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select(F.col("doc_id").cast("int").alias("tid"), F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), _LETTERS, _BASES).alias("seq"))


SEQUENCES = f"seqs AS (SELECT doc_id::INT AS tid, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_LETTERS}', '{_BASES}') AS seq FROM documents)"
