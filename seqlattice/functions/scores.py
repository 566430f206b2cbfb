"""Column expressions of scores, flags, weights and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mapq(posterior: Column) -> Column:
    """Phred-scaled mapping quality, 0 to 40."""
    return F.floor(-10 * F.log10(F.greatest(1 - posterior, F.lit(1e-4))) + 0.5).cast("int")


def reported_mapq(posterior: Column, num_hits: Column, input_quality: Column) -> Column:
    """mapq(), held to the input's quality where the read has one hit only."""
    return F.when(num_hits == 1, F.least(mapq(posterior), input_quality)).otherwise(mapq(posterior))


def sam_flag(best: Column, minus: Column, aligned: Column) -> Column:
    """0 for the best hit, 0x100 for others, 16 more on the minus strand; 4 for an unaligned read."""
    return F.when(~aligned, F.lit(4)).otherwise(F.when(best, 0).otherwise(256).bitwiseOR(F.when(minus, 16).otherwise(0)))


def flank(start: Column, stop: Column, length: Column, by: int = 5) -> tuple[Column, Column]:
    """The locus with ``by`` bases more on both sides, inside the chromosome."""
    return F.greatest(start - by, F.lit(0)), F.least(stop + by, length)


def locus_weight(depth: Column) -> Column:
    """1 below 10 reads, then one over the logarithm of the depth, 1/4 from 10,000 up."""
    return F.when(depth < 10, 1.0).when(depth < 10_000, 1 / F.log10(depth)).otherwise(0.25)


def temperature(iteration: Column, iterations: int) -> Column:
    """The annealing schedule: 0 at the start, 1 at the end."""
    return F.log10(iteration / F.lit(iterations) * 9 + 1)


def adler32(text: Column) -> Column:
    """Adler-32 of an ASCII string."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def step(s: Column, c: Column) -> Column:
        a = (s["a"] + c) % 65521
        return F.struct(a.alias("a"), ((s["b"] + a) % 65521).alias("b"))

    return F.aggregate(codes, start, step, lambda s: s["b"] * 65536 + s["a"])


def dcode(*values: Column) -> Column:
    """Five bytes (threads, sequence iterations, genome iterations, two pseudocounts) as 16 hex digits."""
    packed = F.lit(0).cast("long")
    for v in values:
        packed = F.shiftleft(packed, 8).bitwiseOR(v.cast("long").bitwiseAND(F.lit(255)))
    return F.lpad(F.hex(packed), 16, "0")


def parse_dcode(name: Column) -> list[Column]:
    """The five bytes after ``DCODE`` in a file name, or -1 each."""
    digits = F.regexp_extract(name, "DCODE([0-9A-Fa-f]+)", 1)
    digits = F.when(digits != "", F.regexp_extract(name, "DCODE0*([0-9A-Fa-f]{1,15})", 1))
    value = F.conv(digits, 16, 10).cast("long")
    return [F.coalesce(F.shiftright(value, s).bitwiseAND(F.lit(255)), F.lit(-1)).cast("int") for s in (32, 24, 16, 8, 0)]


def error_rate(position: Column, length: Column, first: float, last: float) -> Column:
    """The simulated error rate at a position (from 1), on a line between the ends' rates."""
    slope = (F.lit(last) - F.lit(first)) / (length - 1)
    return F.lit(first) + slope * (position - 1)


def interval_distance(chrom: Column, start: Column, stop: Column, strand: Column, chrom2: Column, start2: Column, stop2: Column, strand2: Column) -> Column:
    """-1 between chromosomes or strands, else the larger distance of starts and of stops."""
    return F.when((chrom != chrom2) | (strand != strand2), F.lit(-1)).otherwise(F.greatest(F.abs(start - start2), F.abs(stop - stop2)))


def quality_bucket(quality: Column) -> Column:
    return F.least(F.floor(quality / 10), F.lit(5)).cast("int")


def error_bucket(errors: Column) -> Column:
    return F.least(errors, F.lit(5)).cast("int")


def empirical_quality(correct: Column, wrong: Column) -> Column:
    """Phred-scaled share of wrong placements; 100 where none is wrong."""
    return F.when(wrong == 0, F.lit(100)).otherwise(F.floor(-10 * F.log10(wrong / (correct + wrong)))).cast("int")
