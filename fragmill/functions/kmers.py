"""k-mer codes, reverse complements, GC, digamma: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(kmer: Column) -> Column:
    """Base 4, first base highest, A 0 C 1 G 2 T and U 3; null if a character is none of these."""
    digits = F.translate(F.upper(kmer), "ACGTU", "01233")
    return F.when(F.upper(kmer).rlike("^[ACGTU]+$"), F.conv(digits, 4, 10).cast("long"))


def decode(index: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(index.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(F.upper(seq)), "ACGTU", "TGCAA")


def next_index(index: Column, base: Column, k: int, reverse: bool = False) -> Column:
    """The code one base further; an unknown base counts as A. reverse: of the base's complement, for a read backwards."""
    base = reverse_complement(base) if reverse else base
    code = F.coalesce(encode(base), F.lit(0))
    return (index * 4 + code).bitwiseAND(F.lit(4**k - 1))


#: Bases of a chunk: finding a place in a string costs its distance from the start, so windows are cut from chunks.
_CHUNK = 512


def windows(seq: Column, k: int, stride: int = 1) -> Column:
    """array of struct(pos from 0, kmer)."""
    last, span = F.length(seq) - k, _CHUNK // stride * stride or stride
    chunks = F.transform(F.sequence(F.lit(0), last, F.lit(span)), lambda c: F.struct(c.alias("at"), F.substring(seq, c + 1, F.lit(span + k - 1)).alias("s")))
    inside = lambda x: F.transform(F.sequence(F.lit(0), F.least(F.lit(span - 1), last - x["at"]), F.lit(stride)), lambda p: F.struct((x["at"] + p).alias("pos"), F.substring(x["s"], p + 1, F.lit(k)).alias("kmer")))
    return F.when(last >= 0, F.flatten(F.transform(chunks, inside))).otherwise(F.array())


def gc_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "GCgc", ""))


def gc_before(seq: Column, position: Column) -> Column:
    """G and C up to and with a position."""
    return gc_count(F.substring(seq, F.lit(1), position + 1))


def gc_before_sampled(seq: Column, position: Column, step: int) -> Column:
    """gc_before() from counts kept at every `step`-th place and the last one, by straight lines between."""
    low = F.floor(position / step) * step
    high = F.least(low + step, F.length(seq) - 1)
    below, above = gc_before(seq, low.cast("int")), gc_before(seq, high.cast("int"))
    return F.when(high == low, below.cast("double")).otherwise(below + (above - below) * (position - low) / (high - low))


def gc_percent(seq: Column, start: Column, end: Column) -> Column:
    """Percent of G and C in (start, end] over end - start + 1 bases, halves to even."""
    between = F.substring(seq, start + 2, F.greatest(end - start, F.lit(0)))
    return F.rint(100.0 * gc_count(between) / (end - start + 1)).cast("int")


#: Coefficients of the asymptotic series (fixed values), for 1/y**2, 1/y**4, ...
_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132)


def digamma(x: Column) -> Column:
    """psi(x) for x > 0, to about 1e-11: six steps up, then the series."""
    y = x + 6.0
    out = F.ln(y) - 0.5 / y
    for k, c in enumerate(_SERIES, 1):
        out = out + c / F.pow(y, F.lit(2.0 * k))
    for k in range(6):
        out = out - 1.0 / (x + float(k))
    return out


def log_add(x: Column, y: Column) -> Column:
    """ln(exp(x) + exp(y)); an infinite side stands for zero and gives the other."""
    none = lambda c: F.abs(c) == F.lit(float("inf"))
    return F.when(none(x), y).when(none(y), x).otherwise(F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y))))


def log_sub(x: Column, y: Column) -> Column:
    """ln(exp(x) - exp(y)) for x > y; infinite where nothing is left."""
    return F.when(F.abs(y) == F.lit(float("inf")), x).when(x <= y, F.lit(float("inf"))).otherwise(x + F.log1p(-F.exp(y - x)))


def phred_log_right(quality: Column) -> Column:
    """ln of the probability that a base of this Phred quality is right; -1000 for quality 0."""
    return F.when(quality <= 0, F.lit(-1000.0)).otherwise(F.log1p(-F.pow(F.lit(10.0), -quality / 10.0)))


def pack(tid: Column, offset: Column) -> Column:
    """A target and a place in it as one number: the target above 32 bits."""
    return F.shiftleft(tid.cast("long"), 32).bitwiseOR(offset.cast("long").bitwiseAND(F.lit((1 << 32) - 1)))


def unpack(packed: Column) -> Column:
    """struct(tid, offset) of pack()."""
    return F.struct(F.shiftrightunsigned(packed, 32).alias("tid"), packed.bitwiseAND(F.lit((1 << 32) - 1)).alias("offset"))


def label_hash(label: Column) -> Column:
    """A 64-bit hash of an array of targets, in their order."""
    return F.xxhash64(label)
