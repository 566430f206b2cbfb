"""The genome in overlapping tiles, so that a place is looked up in a short row instead of a whole chromosome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 1_024


def cut(seq: Column | str, size: int, overlap: int) -> Column:
    """Array of the pieces of ``size`` letters, each followed by the next ``overlap`` letters (at most ``size``); one pass over the sequence."""
    parts = F.regexp_extract_all(seq, F.lit(f".{{1,{size}}}"), F.lit(0))
    return F.zip_with(parts, F.slice(parts, F.lit(2), F.lit(1 << 30)), lambda a, b: F.concat(a, F.substring(F.coalesce(b, F.lit("")), F.lit(1), F.lit(overlap))))


def pieces(genome, size: int, overlap: int) -> DataFrame:
    """(chrom_idx, tile, part, seq_len): pieces of ``size`` letters, each followed by the next ``overlap``, of a genome (chrom_idx, seq, seq_len) or of one that cuts its own tiles."""
    if not isinstance(genome, DataFrame):
        return genome.tiles(size, overlap)
    cuts = genome.select("chrom_idx", "seq_len", F.posexplode(cut("seq", size, overlap)).alias("tile", "part"))
    return cuts.select("chrom_idx", F.col("tile").cast("long").alias("tile"), "part", "seq_len")


def chromosomes_of(genome) -> DataFrame:
    """The table of chromosomes (chrom_idx, chrom, seq_len) of either kind of genome."""
    return genome if isinstance(genome, DataFrame) else genome.chromosomes


def tiles(genome: DataFrame, longest: int, size: int = TILE) -> tuple[DataFrame, int]:
    """(chrom_idx, tile, part, seq_len) and the tiles' size: any ``longest`` letters that begin in a tile lie in its part."""
    size = max(size, longest)
    return pieces(genome, size, longest), size


def look_up(places: DataFrame, genome: DataFrame, start: str, longest: int) -> DataFrame:
    """``places`` (with chrom_idx and the column ``start``, from 0) with seq_len and part, the letters from ``start`` on: ``longest`` or more of them, or all up to the chromosome's end.

    Places in none of its tiles go.
    """
    pieces, size = tiles(genome, longest)
    at = places.withColumn("tile", F.floor(F.col(start) / size).cast("long")).join(pieces, ["chrom_idx", "tile"])
    return at.withColumn("part", F.expr(f"substring(part, cast({start} - tile * {size} + 1 as int))")).drop("tile")


def named_only(genome, places: DataFrame, most: int = 10_000) -> DataFrame:
    """The genome for a look-up of ``places`` (stored): where they name ``most`` chromosomes at most, these alone.

    Their numbers pass the driver, as a condition reaches the scan where a
    semi-join doesn't: the sequence of no other chromosome is made or cut.
    """
    if not isinstance(genome, DataFrame):
        return genome
    named = [r.chrom_idx for r in places.where("chrom_idx IS NOT NULL").select("chrom_idx").distinct().limit(most + 1).collect()]
    return genome.where(f"chrom_idx IN ({', '.join(map(str, named))})" if named else "false") if len(named) <= most else genome


def longest_of(df: DataFrame, length: Column) -> int:
    """The largest ``length`` of all rows, 0 if there are none."""
    return int(df.agg(F.max(length)).first()[0] or 0)
