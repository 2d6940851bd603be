"""Fragment length distributions and effective lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Tables here have a row per fragment length, at most max_frag_len; windows over all of it are small.
def _up():
    return Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)


def conditional_means(counts: DataFrame) -> DataFrame:
    """len, cf: mean of the lengths up to len; 0 while there is no mass."""
    mass, total = F.sum("n").over(_up()), F.sum(F.col("len") * F.col("n")).over(_up())
    return counts.select("len", F.when(mass > 0, total / mass).otherwise(0.0).alias("cf"))


def kernel(length: Column, mean: float, sd: float) -> Column:
    z = (length - mean) / sd
    return F.exp(-0.5 * z * z) / sd


def gaussian(spark: SparkSession, max_len: int, mean: float, sd: float) -> DataFrame:
    """len, n: the kernel's weight of each length."""
    return spark.range(max_len).select(F.col("id").alias("len"), kernel(F.col("id"), mean, sd).alias("n"))


def gaussian_counts(spark: SparkSession, total: int, max_len: int, mean: float, sd: float) -> DataFrame:
    """len, n: `total` fragments over the lengths in the kernel's proportions, rounded."""
    g = gaussian(spark, max_len, mean, sd)
    return g.select("len", F.round(total * F.col("n") / F.sum("n").over(Window.partitionBy())).cast("long").alias("n"))


def distribution(counts: DataFrame) -> DataFrame:
    """len, pdf, cdf: mass above all but a millionth is cut off and the rest normalised; a single length has all the mass."""
    every = Window.partitionBy()
    x = counts.select("len", "n", (F.sum("n").over(_up()) / F.sum("n").over(every)).alias("c"))
    end = F.coalesce(F.min(F.when(F.col("c") > 1 - 1e-6, F.col("len"))).over(every), F.max("len").over(every) + 1)
    x = x.withColumn("end", end)
    kept = F.when(F.col("len") < F.col("end"), F.col("n"))
    mass = F.sum(kept).over(every)
    pdf = F.when(mass > 0, F.coalesce(kept / mass, F.lit(0.0))).otherwise(F.when(F.col("len") == F.col("end"), 1.0).otherwise(0.0))
    x = x.select("len", "end", pdf.cast("double").alias("pdf"))
    return x.select("len", "pdf", F.when(F.col("len") < F.col("end"), F.sum("pdf").over(_up())).otherwise(1.0).alias("cdf"))


def quantile_bounds(dist: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    return dist.agg(F.min(F.when(F.col("cdf") >= low, F.col("len"))).alias("low"), F.min(F.when(F.col("cdf") >= high, F.col("len"))).alias("high"))


def mean_length(counts: DataFrame, default: int = 200) -> DataFrame:
    """One row, mean: the whole part of the mean, or the default where lengths sum to no more than fragments."""
    n, total = F.sum("n"), F.sum(F.col("len") * F.col("n"))
    return counts.agg(F.when(total > n, F.floor(total / n)).otherwise(F.lit(default)).cast("long").alias("mean"))


def median(counts: DataFrame) -> DataFrame:
    """One row, median: where mass taken from both ends in turn meets; null without mass."""
    below = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    x = counts.select("len", "n", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("b"), F.sum("n").over(every).alias("t"))
    # The ends meet at the first length whose mass with what lies below exceeds what lies above.
    return x.where((F.col("t") > 0) & (F.col("b") + F.col("n") > F.col("t") - F.col("b") - F.col("n"))).agg(F.min("len").alias("median"))


def smoothed(targets: DataFrame, cf: DataFrame, max_len: int) -> DataFrame:
    """tid, length, eff_length = length - cf(length) + 1, never below 1."""
    at = F.least(F.col("length"), F.lit(max_len - 1))
    eff = F.col("length") - F.col("cf") + 1
    return targets.withColumn("len", at.cast("long")).join(F.broadcast(cf), "len").select("tid", "length", F.when(eff < 1, F.col("length")).otherwise(eff).cast("double").alias("eff_length"))


def unsmoothed(targets: DataFrame, dist: DataFrame, med: DataFrame) -> DataFrame:
    """tid, length, eff_length: sum of pdf(l) (length - l + 1) over l up to length; length up to the median or without support.

    One row a length on the broadcast side; the sum over shorter lengths is a difference of prefix sums, not a range join.
    """
    sums = dist.select("len", F.sum("pdf").over(_up()).alias("p"), F.sum(F.col("pdf") * F.col("len")).over(_up()).alias("lp"))
    top = dist.agg(F.max("len").alias("top")).join(med, F.lit(True))
    t = targets.join(F.broadcast(top), F.lit(True)).withColumn("len", F.least(F.col("length").cast("long"), F.col("top")))
    eff = F.col("p") * (F.col("length") + 1) - F.col("lp")
    return t.join(F.broadcast(sums), "len").select("tid", "length", F.when((F.col("length") <= F.col("median")) | (eff <= 0), F.col("length")).otherwise(eff).cast("double").alias("eff_length"))


def direct(targets: DataFrame) -> DataFrame:
    return targets.select("tid", "length", F.col("length").cast("double").alias("eff_length"))


def chosen(counts: DataFrame, quota: int = 10_000, max_len: int = 1000, mean: float = 200.0, sd: float = 80.0, prior: bool = False) -> tuple[DataFrame, DataFrame, bool]:
    """The length counts to go on with (len, n), their conditional means (len, cf), and whether they are the observed ones.

    Observed counts are taken only if the quota of unique pairs was reached; else, and always with `prior`, the Gaussian
    prior of mean and sd.
    """
    if not prior and (counts.agg(F.sum("n")).first()[0] or 0) >= quota:
        return counts, conditional_means(counts), True
    spark = counts.sparkSession
    return gaussian_counts(spark, quota, max_len, mean, sd), conditional_means(gaussian(spark, max_len, mean, sd)), False


def draws(dist: DataFrame, n: int = 10_000, seed: int = 1) -> DataFrame:
    """k, len: n seeded draws from a distribution (len, cdf). Each draw meets its length by an equi-join on a fine grid of the cdf.

    The table of lengths is as large as max_frag_len and is broadcast.
    """
    steps = dist.select("len", F.coalesce(F.lag("cdf").over(Window.orderBy("len")), F.lit(0.0)).alias("lo"), "cdf").where("cdf > lo")
    table = F.broadcast(steps.agg(F.array_sort(F.collect_list(F.struct("cdf", "len"))).alias("steps")))
    u = dist.sparkSession.range(n).select(F.col("id").alias("k"), F.rand(seed).alias("u"))
    at = F.coalesce(F.get(F.filter("steps", lambda s: s["cdf"] > F.col("u")), F.lit(0))["len"], F.element_at("steps", -1)["len"])
    return u.join(table, F.lit(True)).select("k", at.alias("len"))
