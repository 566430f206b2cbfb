"""Mixing sources to target weights: iterative proportional fitting over source, language and topic.

Token weights (a token is a word here) are summed by cell (source, language, topic) and raked until the
weighted sums meet the target shares of sources, of languages and of topics.
The factor of a source is worked out inside its own group of cells, so any
number of sources stays distributed; each sweep is one job that brings only
the sums by language and topic back to the driver, where they stand in one
matrix. Documents are then kept
with the calibrated probability of their cell, by a hash of their content. The
scale follows the cells that matter: those of the highest ratios that hold no
more than TINY of all words together are kept whole and fall short of their
target, so that a stray document under its own name can't thin all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch
from .textops import U64, mix, slices, word_hashes

TOPIC_BITS = 3
SWEEPS, CLOSE = 40, 1e-4
SMOOTH = 0.9  # power of the natural shares that the default targets follow
TINY = 0.01  # share of all words that cells too small to set the scale hold together, at most


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with __tokens (words of the whole text), __topic and __unit.

    The topic is the text's side of TOPIC_BITS random hyperplanes in the space
    of word counts: texts with like vocabulary fall on like sides. __unit is a
    number from 0 to 1 that follows from id and text alone.
    """
    schema = docs.select("*", F.lit(0).cast("long").alias("__tokens"), F.lit(0).alias("__topic"), F.lit(0.0).alias("__unit")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                hashes, at = word_hashes(batch["text"])
                n = np.diff(at)
                owner = np.repeat(np.arange(batch.num_rows), n)
                topic = np.zeros(batch.num_rows, np.int32)
                for b in range(TOPIC_BITS):
                    sign = 1.0 - 2.0 * ((hashes >> U64(7 + b)) & U64(1)).astype(np.float64)
                    topic |= (np.bincount(owner, sign, batch.num_rows) > 0).astype(np.int32) << b
                ids = np.array([0 if i is None else i & 0xFFFFFFFFFFFFFFFF for i in batch["doc_id"].to_pylist()], U64)
                text = np.bincount(owner, (hashes >> U64(32)).astype(np.float64), batch.num_rows).astype(U64)
                unit = (mix(ids * U64(0x9E3779B97F4A7C15) + text) >> U64(11)).astype(np.float64) / 2.0**53
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int64)), pa.array(topic), pa.array(unit)], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def smoothed(totals: dict, power: float = SMOOTH) -> dict:
    """Target shares that follow the natural ones to ``power``."""
    raised = {k: v**power for k, v in totals.items() if v > 0}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def rake(cells: DataFrame, source_shares: DataFrame | None = None, lang_shares: dict | None = None, topic_shares: dict | None = None, power: float = SMOOTH, sweeps: int = SWEEPS, close: float = CLOSE) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``ratio``: the calibrated share of the mixture a token of the cell stands for.

    Targets default to the natural shares to ``power``. source_shares has
    source and share; sources that it lacks share nothing. Languages by topics
    make a matrix on the driver; sources don't. Cells without tokens get ratio
    0. Adds residual, how far a language's or topic's weight is from its target
    at most: under ``close``, unless the targets can't be met or ``sweeps``
    were not enough.
    """
    spark = cells.sparkSession
    cells = cells.where("tokens > 0")
    if source_shares is None:
        by_source = cells.groupBy("source").agg((F.sum("tokens").cast("double") ** power).alias("raised"))
        whole = by_source.agg(F.sum("raised")).first()[0] or 1.0
        cells = cells.withColumn("share", F.sum("tokens").over(Window.partitionBy("source")).cast("double") ** power / F.lit(whole))
    else:
        asked = source_shares.select(F.col("source").alias("__s"), F.col("share").cast("double"))
        cells = cells.join(asked, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumn("share", F.coalesce("share", F.lit(0.0)))
    sums = {(r.lang, r.topic): float(r.t) for r in cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("t")).collect()}
    langs, topics = sorted({k[0] for k in sums}, key=str), sorted({k[1] for k in sums}, key=str)
    row, column = {x: i for i, x in enumerate(langs)}, {x: i for i, x in enumerate(topics)}

    def matrix(values: dict) -> np.ndarray:
        out = np.zeros((len(langs), len(topics)))
        for (x, y), v in values.items():
            out[row[x], column[y]] = v
        return out

    natural = matrix(sums)
    lang_shares = lang_shares or smoothed(dict(zip(langs, natural.sum(1).tolist(), strict=True)), power)
    topic_shares = topic_shares or smoothed(dict(zip(topics, natural.sum(0).tolist(), strict=True)), power)
    targets = np.array([lang_shares.get(x, 0.0) for x in langs]), np.array([topic_shares.get(x, 0.0) for x in topics])
    f, g = np.ones(len(langs)), np.ones(len(topics))

    def weighed() -> DataFrame:
        rows = [(x, y, float(f[row[x]] * g[column[y]])) for x, y in sums]
        factors = spark.createDataFrame(rows, cells.select(F.col("lang").alias("__l"), F.col("topic").alias("__t"), F.lit(0.0).alias("__f")).schema)
        raw = cells.join(factors, F.col("lang").eqNullSafe(F.col("__l")) & F.col("topic").eqNullSafe(F.col("__t"))).withColumn("raw", F.col("tokens") * F.col("__f")).drop("__l", "__t", "__f")
        total = F.sum("raw").over(Window.partitionBy("source"))
        return raw.withColumn("weight", F.when(total > 0, F.col("share") * F.col("raw") / total).otherwise(0.0))

    off = 0.0
    for _ in range(sweeps if sums else 0):
        now = matrix({(r.lang, r.topic): r.w for r in weighed().groupBy("lang", "topic").agg(F.sum("weight").alias("w")).collect()})
        off = 0.0
        for _ in range(50):  # settle languages and topics between two passes over the sources
            moved = 0.0
            for axis, factors, target in ((1, f, targets[0]), (0, g, targets[1])):
                have = now.sum(axis)
                moved = max(moved, float(np.abs(have - target).max()))
                scale = np.divide(target, have, out=np.ones_like(have), where=have > 0)
                factors *= scale
                now = now * (scale[:, None] if axis else scale[None, :])
            off = max(off, moved)
            if moved < close / 10:
                break
        if off < close:
            break
    return weighed().withColumn("ratio", F.col("weight") / F.col("tokens")).withColumn("residual", F.lit(off)).drop("raw")


def scale_of(raked: DataFrame, tiny: float = TINY) -> float:
    """The largest ratio once the cells of the highest ratios are left out that hold at most ``tiny`` of all words together (by steps of 2 %)."""
    steps = raked.where("ratio > 0").groupBy(F.floor(F.log2("ratio") * 32).alias("step")).agg(F.sum("tokens").alias("n"), F.max("ratio").alias("top"))
    rows = sorted(steps.collect(), key=lambda r: -r.step)  # 32 for each doubling of the ratio
    whole, above = raked.agg(F.sum("tokens")).first()[0] or 0, 0
    for r in rows:
        above += r.n
        if above > tiny * whole:
            return r.top
    return rows[-1].top if rows else 1.0


def mix_sources(spark: SparkSession, docs: DataFrame, power: float = SMOOTH, tiny: float = TINY, **targets) -> DataFrame:
    """n_tokens, topic, probability, shortfall, residual and kept of each row of ``docs``: the documents sampled into the mixture.

    Columns beside them: doc_id, source, lang and text_key, a hash of the text.
    The tokens that weigh are words of the whole text, apart by white space.
    A document is kept with the probability of its cell: the cell's ratio over
    the scale, the largest ratio but for the cells of the highest ratios that
    hold at most ``tiny`` of all words together. Those are kept whole, and
    shortfall is the share of their target that they can't supply (0 for all
    others). With ``tiny`` 0 the rarest kind sets the scale and all targets
    are met. Null source and language are kinds of their own. Documents
    without words weigh nothing and are kept. Rows without id fall by their
    text, rows repeated with one id and text fall alike. residual is how far
    the raking stayed from its targets. Other columns are ignored; an empty
    table gives no rows.
    """
    scratch = Scratch(spark)
    sized = measured(docs.select("doc_id", "text", "source", "lang")).withColumn("text_key", F.xxhash64("text")).drop("text")
    sized = scratch.write(sized)
    cells = sized.groupBy("source", "lang", F.col("__topic").alias("topic")).agg(F.sum("__tokens").alias("tokens"))
    raked = scratch.write(rake(scratch.write(cells), power=power, **targets))
    top = scale_of(raked, tiny)
    rate = raked.select(F.col("source").alias("s"), F.col("lang").alias("l"), F.col("topic").alias("t"), (F.col("ratio") / F.lit(top)).alias("wanted"), "residual")
    out = sized.join(rate, F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l")) & (F.col("__topic") == F.col("t")), "left")
    out = out.withColumn("probability", F.when(F.col("__tokens") > 0, F.least(F.coalesce("wanted", F.lit(0.0)), F.lit(1.0))).otherwise(1.0))
    out = out.withColumn("shortfall", F.when(F.col("wanted") > 1, 1 - 1 / F.col("wanted")).otherwise(0.0))
    return out.select("doc_id", "source", "lang", "text_key", F.col("__tokens").alias("n_tokens"), F.col("__topic").alias("topic"), "probability", "shortfall", "residual", (F.col("__unit") < F.col("probability")).alias("kept"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
