"""Connected components by alternating large-star and small-star rounds over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b long): component is the smallest id reachable.

    Edges lead to smaller ids. A round first leads each edge on to the
    smallest neighbour of its target, then joins all targets of a vertex to
    the smallest of them. The join on targets asks for a second key, the hash,
    so that the aggregated side is dealt anew beside the edges and AQE can
    split the rows of a target that very many edges share. The edges are
    written to shared storage after every round, so lineage stays short and a
    lost executor costs one round. Rounds grow with the logarithm of the
    number of vertices. Null ends and loops are ignored.
    """

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()

    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    seen = mark(now)
    while True:
        low = now.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("u"), F.xxhash64("v").alias("h"), "m")
        large = now.withColumn("h", F.xxhash64("u")).join(low, ["u", "h"], "left").select("v", F.coalesce("m", "u").alias("u"))
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        star = large.join(least, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        after = scratch.write(star.select("e.v", "e.u").where("v > u").distinct())
        scratch.drop(now)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    flat = now.select(F.col("v").alias("id"), F.col("u").alias("component"))
    return flat.unionByName(flat.select(F.col("component").alias("id"), "component").distinct())
