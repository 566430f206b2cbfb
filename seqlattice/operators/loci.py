"""Candidate loci: their sequences, depths and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bases import reverse_complement
from ..functions.scores import flank, locus_weight
from ..session import stored
from .tiles import longest_of, look_up

LOCUS = ["chrom_idx", "start", "stop", "strand"]


def hits_of(places: DataFrame) -> DataFrame:
    """Hits (read_id, hit_idx from 0, chrom_idx, start, stop, strand, num_hits) from ranked places (start, len, rank)."""
    return places.select(
        "read_id", (F.col("rank") - 1).alias("hit_idx"), "chrom_idx", "start", (F.col("start") + F.col("len")).alias("stop"), "strand",
        F.count("*").over(Window.partitionBy("read_id")).alias("num_hits"),
    )


def locus_sequences(genome: DataFrame, hits: DataFrame, by: int = 5, longest: int | None = None) -> DataFrame:
    """Hits with locus: the bases from start - by to stop + by inside the chromosome, as the read lies there.

    ``longest`` is the length of the longest hit, by default looked up in
    ``hits``; a longer one is an error.
    """
    longest = (longest_of(hits, F.col("stop") - F.col("start")) if longest is None else longest) + 2 * by
    at = look_up(hits.withColumn("locus_start", F.greatest(F.col("start") - by, F.lit(0))), genome, "locus_start", longest)
    at = at.withColumn("locus_stop", flank(F.col("start"), F.col("stop"), F.col("seq_len"), by)[1])
    size = (F.col("locus_stop") - F.col("locus_start")).cast("int")
    plus = F.when(size > longest, F.raise_error(F.lit("a locus is longer than was said"))).otherwise(F.substring("part", F.lit(1), size))
    return at.withColumn("locus", F.when(F.col("strand") == "-", reverse_complement(plus)).otherwise(plus)).select(*hits.columns, "locus_start", "locus_stop", "locus")


def locus_depths(hits: DataFrame) -> DataFrame:
    """(locus, depth, weight): reads that name the locus, each as one over the number of its hits."""
    return hits.groupBy(*LOCUS).agg(F.sum(1 / F.col("num_hits")).alias("depth")).withColumn("weight", locus_weight(F.col("depth")))


def with_weights(hits: DataFrame) -> DataFrame:
    """Hits with the depth and weight of their locus; both read the hits as stored, so that their sequences are looked up once."""
    hits = stored(hits)
    return hits.join(locus_depths(hits), LOCUS)
