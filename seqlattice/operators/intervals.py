"""Overlap joins of intervals by hierarchical bins.

An interval stands in the one smallest bin that holds it: bins of 2^BASE bases,
and on each level above eight of those below. Two intervals that overlap stand
in bins of which one holds the other, so one side asks for the bins above and
below its own: above, one a level; below, those of the levels that its length
covers. The other side has one row an interval, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE, STEP, LEVELS = 14, 3, 13  # the widest bins hold 2^53 bases, more than any chromosome


def bin_of(start: Column, stop: Column) -> Column:
    """level * 2^40 + number of the smallest bin that holds [start, stop)."""
    out = F.lit(None).cast("long")
    for level in reversed(range(LEVELS + 1)):
        shift = BASE + STEP * level
        same = F.shiftright(start, shift) == F.shiftright(stop - 1, shift)
        out = F.when(same, F.lit(level << 40) + F.shiftright(start, shift)).otherwise(out)
    return out


def bins_met(start: Column, stop: Column) -> Column:
    """The bins of all levels that [start, stop) touches: on every level those from its first base's to its last one's."""

    def level(i: int) -> Column:
        return F.sequence(*[F.lit(i << 40) + F.shiftright(x, BASE + STEP * i) for x in (start, stop - 1)])

    return F.concat(*[level(i) for i in range(LEVELS + 1)])


def overlaps(left: DataFrame, right: DataFrame, on: str = "chrom", least: int = 1) -> DataFrame:
    """Pairs of rows whose [start, stop) share ``least`` bases or more on one chromosome: all columns of ``left``, those of ``right`` with the prefix other_, and shared.

    ``left`` asks for bins: better the side of short intervals, a long one has
    a row for each bin that it touches until the join. Empty intervals, those
    that begin before 0, and rows with a null meet nothing.
    """
    good = lambda df: df.where("start >= 0 AND stop > start").withColumns({"start": F.col("start").cast("long"), "stop": F.col("stop").cast("long")})
    asked = good(left).withColumn("__bin", F.explode(bins_met(F.col("start"), F.col("stop"))))
    held = good(right).withColumn("__held", bin_of(F.col("start"), F.col("stop")))
    held = held.select(*[F.col(c).alias(c if c == "__held" else f"other_{c}") for c in held.columns])
    met = asked.join(held, (F.col(on) == F.col(f"other_{on}")) & (F.col("__bin") == F.col("__held")))
    shared = F.least("stop", "other_stop") - F.greatest("start", "other_start")
    return met.withColumn("shared", shared).where(F.col("shared") >= least).drop("__bin", "__held")
