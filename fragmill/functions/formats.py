"""Library formats: names, codes, compatibility of hits, and hit types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes (fixed values): read type, relative orientation, strandedness.
SINGLE, PAIRED = 0, 1
SAME, AWAY, TOWARD, NONE = 0, 1, 2, 3
SA, AS, S, A, U = 0, 1, 2, 3, 4
#: The twelve names with their codes (fixed values).
FORMATS = {
    "U": (SINGLE, NONE, U), "SF": (SINGLE, NONE, S), "SR": (SINGLE, NONE, A),
    "IU": (PAIRED, TOWARD, U), "ISF": (PAIRED, TOWARD, SA), "ISR": (PAIRED, TOWARD, AS),
    "OU": (PAIRED, AWAY, U), "OSF": (PAIRED, AWAY, SA), "OSR": (PAIRED, AWAY, AS),
    "MU": (PAIRED, SAME, U), "MSF": (PAIRED, SAME, S), "MSR": (PAIRED, SAME, A),
}
MAX_ID = PAIRED | NONE << 1 | U << 3


def parse(name: Column) -> Column:
    """struct(type, orientation, strandedness) of a name in any case; an unknown name is an error."""
    out = F.raise_error(F.concat(F.lit("unknown library format "), F.coalesce(name, F.lit("null"))))
    for known, codes in FORMATS.items():
        out = F.when(F.upper(name) == known, F.struct(*[F.lit(c).alias(n) for c, n in zip(codes, ("type", "orientation", "strandedness"), strict=True)])).otherwise(out)
    return out


def format_id(type_: Column, orientation: Column, strandedness: Column) -> Column:
    return type_.bitwiseOR(F.shiftleft(orientation, 1)).bitwiseOR(F.shiftleft(strandedness, 3))


def from_id(id_: Column) -> Column:
    return F.struct(id_.bitwiseAND(1).alias("type"), F.shiftright(id_, 1).bitwiseAND(3).alias("orientation"), F.shiftright(id_, 3).bitwiseAND(7).alias("strandedness"))


def valid(type_: Column, orientation: Column, strandedness: Column) -> Column:
    """Whether the three codes make sense together."""
    one = (type_ == SINGLE) & (orientation == NONE) & strandedness.isin(S, A, U)
    same = (orientation == SAME) & strandedness.isin(S, A, U)
    apart = orientation.isin(AWAY, TOWARD) & strandedness.isin(SA, AS, U)
    return one | ((type_ == PAIRED) & (same | apart))


def compatible_pair(e_orientation, e_strand, o_orientation, o_strand) -> Column:
    """A pair's observed format against the expected one."""
    return (e_orientation == o_orientation) & ((e_strand == U) | (e_strand == o_strand))


def compatible_single(orientation, strand, fwd: Column, mate_status: Column, orphan_strand_fix: bool = False) -> Column:
    """A read without its mate. Strands SA and AS are never met, unless orphan_strand_fix takes them for S and A."""
    if orphan_strand_fix:
        strand = F.when(strand == SA, S).when(strand == AS, A).otherwise(strand)
    as_first = F.when(mate_status == "PAIRED_END_RIGHT", ~fwd).otherwise(fwd)
    return (
        F.when(strand == U, F.lit(True))
        .when(orientation == SAME, ((strand == S) & fwd) | ((strand == A) & ~fwd))
        .when(strand == S, as_first)
        .when(strand == A, ~as_first)
        .otherwise(F.lit(False))
    )


def hit_type(start1: Column, fwd1: Column, len1: Column, start2: Column, fwd2: Column, len2: Column, dovetail: bool = False) -> Column:
    """struct(orientation, strandedness) that a pair of mates shows."""
    slack1, slack2 = (len2, len1) if dovetail else (F.lit(0), F.lit(0))
    pair = lambda o, s: F.struct(F.lit(o).alias("orientation"), F.lit(s).alias("strandedness"))
    return (
        F.when(fwd1 & ~fwd2, F.when(start1 <= start2 + slack1, pair(TOWARD, SA)).otherwise(pair(AWAY, SA)))
        .when(~fwd1 & fwd2, F.when(start2 <= start1 + slack2, pair(TOWARD, AS)).otherwise(pair(AWAY, AS)))
        .when(fwd1, pair(SAME, S))
        .otherwise(pair(SAME, A))
    )


def format_table(spark: SparkSession) -> DataFrame:
    rows = [(n, *c) for n, c in FORMATS.items()]
    return spark.createDataFrame(rows, "name string, type int, orientation int, strandedness int")


#: Names of the codes (fixed values), by code.
TYPE_NAMES = ("single end", "paired end")
ORIENTATION_NAMES = ("matching", "outward", "inward", "none")
STRAND_NAMES = ("(sense, antisense)", "(antisense, sense)", "sense", "antisense", "unstranded")


def describe(type_: Column, orientation: Column, strandedness: Column) -> Column:
    """A format in words."""
    named = lambda names, c: F.get(F.array(*map(F.lit, names)), c)
    parts = ("Library format { type:", named(TYPE_NAMES, type_), ", relative orientation:", named(ORIENTATION_NAMES, orientation), ", strandedness:", named(STRAND_NAMES, strandedness), " }")
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def direction(fwd: Column) -> Column:
    return F.when(fwd, "FORWARD").otherwise("REVERSE_COMPLEMENT")
