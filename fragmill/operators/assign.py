"""Hits to labelled fragments: ceilings, orphans, compatibility, and what is counted on the way.

hits: frag_id, hit_ord, tid, pos, fwd, read_len, mate_status, mate_pos, mate_fwd, mate_len, frag_len.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats

PAIRED_STATUS, LEFT, RIGHT, SINGLE = "PAIRED_END_PAIRED", "PAIRED_END_LEFT", "PAIRED_END_RIGHT", "SINGLE_END"


@dataclass(frozen=True)
class Options:
    lib_type: str = "IU"
    max_read_occ: int = 200
    discard_orphans: bool = False
    ignore_compat: bool = False
    enforce_compat: bool = False
    allow_dovetail: bool = False
    orphan_strand_fix: bool = False
    dedupe_label: bool = False


def five_prime(pos: Column, fwd: Column, length: Column) -> Column:
    return F.when(fwd, pos).otherwise(pos + length)


def ceiling(hits: DataFrame, most: int) -> DataFrame:
    """Drops all hits of a fragment that has more than `most`."""
    counted = hits.withColumn("_n", F.count("*").over(Window.partitionBy("frag_id")))
    return counted.where(F.col("_n") <= most).drop("_n")


def without_orphans(hits: DataFrame) -> DataFrame:
    """Drops fragments whose first hit isn't a pair."""
    first = F.first("mate_status").over(Window.partitionBy("frag_id").orderBy("hit_ord"))
    return hits.withColumn("_f", first).where(F.col("_f") == PAIRED_STATUS).drop("_f")


def with_compatibility(hits: DataFrame, options: Options) -> DataFrame:
    """Adds compat: whether a hit agrees with the library format."""
    if options.ignore_compat:
        return hits.withColumn("compat", F.lit(True))
    _, orientation, strand = formats.FORMATS[options.lib_type.upper()]
    o, s = F.lit(orientation), F.lit(strand)
    start1, start2 = five_prime(F.col("pos"), F.col("fwd"), F.col("read_len")), five_prime(F.col("mate_pos"), F.col("mate_fwd"), F.col("mate_len"))
    seen = formats.hit_type(start1, F.col("fwd"), F.col("read_len"), start2, F.col("mate_fwd"), F.col("mate_len"), options.allow_dovetail)
    pair = formats.compatible_pair(o, s, seen["orientation"], seen["strandedness"])
    single = formats.compatible_single(o, s, F.col("fwd"), F.col("mate_status"), options.orphan_strand_fix)
    return hits.withColumn("compat", F.when(F.col("mate_status") == PAIRED_STATUS, pair).otherwise(single))


def prefer_compatible(hits: DataFrame, enforce: bool = False) -> DataFrame:
    """A fragment's compatible hits if it has any; otherwise all of them, or none if enforce."""
    if enforce:
        return hits.where("compat")
    any_ = F.max("compat").over(Window.partitionBy("frag_id"))
    return hits.withColumn("_any", any_).where(F.col("compat") | ~F.col("_any")).drop("_any")


def chosen(hits: DataFrame, options: Options = Options()) -> DataFrame:
    """The hits that make a fragment's label. All windows share one partitioning by fragment."""
    hits = ceiling(hits, options.max_read_occ)
    if options.discard_orphans:
        hits = without_orphans(hits)
    return prefer_compatible(with_compatibility(hits, options), options.enforce_compat)


def labels(hits: DataFrame, dedupe: bool = False) -> DataFrame:
    """frag_id, label: the sorted targets of a fragment; a target hit by both mates apart counts twice."""
    collect = F.collect_set if dedupe else F.collect_list
    return hits.groupBy("frag_id").agg(F.array_sort(collect("tid")).alias("label"))


def strict_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """frag_id, tid, kind of mates' hits (frag_id, tid): the targets both hit, or, if there are none, all as orphans."""
    both = left.withColumn("l", F.lit(1)).join(right.withColumn("r", F.lit(1)), ["frag_id", "tid"], "full")
    paired = F.col("l").isNotNull() & F.col("r").isNotNull()
    any_ = F.max(paired).over(Window.partitionBy("frag_id"))
    kind = F.when(paired, PAIRED_STATUS).when(F.col("l").isNotNull(), LEFT).otherwise(RIGHT)
    return both.select("frag_id", "tid", kind.alias("kind"), paired.alias("p"), any_.alias("any")).where("p OR NOT any").select("frag_id", "tid", "kind")


def fuzzy_intersection(left: DataFrame, right: DataFrame, matched: DataFrame) -> DataFrame:
    """As strict_intersection, but mates that hit different targets alone give nothing, nor does a mate alone whose partner matched somewhere.

    matched: frag_id, left, right: whether any k-mer of that mate is in the index, even if that gave no hit.
    """
    sides = left.withColumn("l", F.lit(True)).join(right.withColumn("r", F.lit(True)), ["frag_id", "tid"], "full").join(matched.select("frag_id", F.col("left").alias("ml"), F.col("right").alias("mr")), "frag_id", "left")
    frag = Window.partitionBy("frag_id")
    l, r, quiet = F.col("l").isNotNull(), F.col("r").isNotNull(), lambda c: ~F.coalesce(F.col(c), F.lit(False))
    seen = sides.withColumn("any_l", F.max(l).over(frag)).withColumn("any_r", F.max(r).over(frag))
    kept = (l & r) | (l & ~F.col("any_r") & quiet("mr")) | (r & ~F.col("any_l") & quiet("ml"))
    return seen.where(kept).select("frag_id", "tid", F.when(l & r, PAIRED_STATUS).when(l, LEFT).otherwise(RIGHT).alias("kind"))


def paired_hits(left: DataFrame, right: DataFrame, kinds: DataFrame) -> DataFrame:
    """Mates' hits (frag_id, tid, pos, fwd, read_len) and what fragments they make (frag_id, tid, kind) to hits.

    Of several hits of a mate on one target the leftmost counts.
    """
    one = lambda df, names: df.groupBy("frag_id", "tid").agg(F.min(F.struct("pos", "fwd", "read_len")).alias("h")).select("frag_id", "tid", *[F.col(f"h.{c}").alias(n) for c, n in zip(("pos", "fwd", "read_len"), names, strict=True)])
    own, mate = ("pos", "fwd", "read_len"), ("mate_pos", "mate_fwd", "mate_len")
    both = kinds.join(one(left, ("lp", "lf", "ll")), ["frag_id", "tid"], "left").join(one(right, ("rp", "rf", "rl")), ["frag_id", "tid"], "left")
    alone = F.col("kind") == RIGHT
    first = [F.when(alone, F.col(r)).otherwise(F.col(x)).alias(n) for x, r, n in zip(("lp", "lf", "ll"), ("rp", "rf", "rl"), own, strict=True)]
    paired = F.col("kind") == PAIRED_STATUS
    second = [F.when(paired, F.col(r)).alias(n) for r, n in zip(("rp", "rf", "rl"), mate, strict=True)]
    span = F.greatest(F.col("lp") + F.col("ll"), F.col("rp") + F.col("rl")) - F.least("lp", "rp")
    order = F.when(alone, 1).otherwise(0) * F.lit(1 << 32) + F.col("tid")
    return both.select("frag_id", order.alias("hit_ord"), "tid", *first, F.col("kind").alias("mate_status"), *second, F.when(paired, span).otherwise(0).alias("frag_len"))


def single_hits(found: DataFrame) -> DataFrame:
    """Hits of reads without mates (frag_id, tid, pos, fwd, read_len) as hits."""
    none = F.lit(None).cast("int")
    return found.select("frag_id", F.col("tid").cast("long").alias("hit_ord"), "tid", "pos", "fwd", "read_len", F.lit(SINGLE).alias("mate_status"), none.alias("mate_pos"), none.cast("boolean").alias("mate_fwd"), none.alias("mate_len"), F.lit(0).alias("frag_len"))


def forward(hits: DataFrame) -> Column:
    return F.when(F.col("mate_status") == RIGHT, ~F.col("fwd")).otherwise(F.col("fwd"))


def counters(hits: DataFrame, kept: DataFrame, observed: int | Column | None = None) -> DataFrame:
    """One row: fragments observed and mapped, hits, forward and reverse hits, mapping rate.

    observed: the fragments' number where it is known; else fragments with a hit are counted.
    """
    seen = F.countDistinct("frag_id") if observed is None else F.lit(observed) if isinstance(observed, int) else observed
    seen = hits.agg(seen.cast("long").alias("observed"), F.count("*").alias("total_hits"))
    used = kept.agg(F.countDistinct("frag_id").alias("mapped"), F.count_if(forward(kept)).alias("n_fwd"), F.count_if(~forward(kept)).alias("n_rc"))
    return seen.join(used, how="inner", on=F.lit(True)).withColumn("mapping_rate", F.col("mapped") / F.col("observed"))


def bias_samples(hits: DataFrame, lengths: DataFrame, window: int = 6, quota: int = 1_000_000) -> DataFrame:
    """frag_id, tid, p, fwd: of each fragment the first hit whose window of bases lies inside its target; the first `quota` by frag_id.

    lengths: tid, length. p is where the fragment starts in its direction.
    """
    p = five_prime(F.col("pos"), F.col("fwd"), F.col("read_len"))
    at = hits.join(lengths.select("tid", "length"), "tid").withColumn("p", p)
    start = F.when(F.col("fwd"), F.col("p") - 2).otherwise(F.col("p") - 4)
    fits = at.where((F.col("p") > 0) & (F.col("p") < F.col("length")) & (start >= 0) & (start + window < F.col("length")))
    first = fits.groupBy("frag_id").agg(F.min(F.struct("hit_ord", "tid", "p", "fwd")).alias("h"))
    return first.select("frag_id", "h.tid", "h.p", "h.fwd").orderBy("frag_id").limit(quota)


def unique_pairs(hits: DataFrame, max_frag_len: int = 1000, quota: int = 10_000) -> DataFrame:
    """Fragments with one hit, a pair of a length below max_frag_len; the first `quota` by frag_id."""
    one = hits.groupBy("frag_id").agg(F.count("*").alias("n"), F.first("mate_status").alias("mate_status"), F.first("frag_len").alias("frag_len"))
    fit = one.where((F.col("n") == 1) & (F.col("mate_status") == PAIRED_STATUS) & (F.col("frag_len") < max_frag_len))
    return fit.select("frag_id", "frag_len").orderBy("frag_id").limit(quota)


def length_histogram(pairs: DataFrame, max_frag_len: int = 1000) -> DataFrame:
    """len, n on every length below max_frag_len."""
    some = pairs.groupBy(F.col("frag_len").cast("long").alias("len")).agg(F.count("*").alias("n"))
    return pairs.sparkSession.range(max_frag_len).withColumnRenamed("id", "len").join(some, "len", "left").select("len", F.coalesce("n", F.lit(0)).alias("n"))
