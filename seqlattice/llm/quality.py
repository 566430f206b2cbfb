"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating has a point for good text and a point for text that isn't toxic, so
grades run from 0 to 2. One set of weights
over hashed text features gives a score, ordered thresholds cut it:
P(grade <= k) = sigmoid(threshold_k - score). Documents are selected by the
tail probability P(grade >= 2).

The model is fitted on a bounded sample of labelled rows: the SAMPLE rows
whose ids have the smallest hashes, or as many of the first of them as have
SAMPLE_FEATURES features together. Only their features reach the driver.
Every document is scored over its whole text, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch
from .textops import mix, slices, token_runs

SAMPLE = 10_000  # labelled rows that the model is fitted on, at most
SAMPLE_FEATURES = 40_000_000  # features of those rows together, at most: what the driver holds while it fits
BUCKETS = 1 << 22  # so many that words seen once seldom share one with a telling word
PREFIXES = (4, 5)  # bytes
GRADES = 3


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text's tokens and of their prefixes, as text number and bucket, sorted.

    Tokens are runs of letters, of digits or of symbols. One bucket more tells
    the text's shape: how many tokens it has and what share of them is new.
    """
    hashes, at = token_runs(texts, PREFIXES)
    total = np.diff(at)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), total) * BUCKETS
    lists = [distinct(owner + (h >> np.uint64(20)).astype(np.int64) % BUCKETS) for h in hashes]
    fresh = np.bincount(lists[0] // BUCKETS, minlength=len(texts))
    shape = np.floor(20 * fresh / np.maximum(total, 1)) * 64 + np.floor(np.log2(total + 1.0))
    shape = (mix(shape.astype(np.uint64) + np.uint64(77)) >> np.uint64(20)).astype(np.int64) % BUCKETS
    pairs = distinct(np.concatenate([*lists, np.arange(len(texts), dtype=np.int64) * BUCKETS + shape]))
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass(frozen=True)
class Model:
    """Weights by bucket and the ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) of each text for k from 1 up."""
        owner, bucket = features(texts)
        score = np.bincount(owner, self.weights[bucket], len(texts))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def descend(loss, p: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Minimises ``loss`` (value and gradient) by limited-memory quasi-Newton steps with halving line search."""
    value, g = loss(p)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, kept = g.copy(), []
        for s, y, rho in reversed(past):
            kept.append(rho * (s @ q))
            q -= kept[-1] * y
        q *= 1 / (past[-1][2] * (past[-1][1] @ past[-1][1])) if past else 1 / max(1.0, float(np.abs(g).max()))
        for (s, y, rho), a in zip(past, reversed(kept), strict=True):
            q += s * (a - rho * (y @ q))
        step, slope = 1.0, float(g @ q)
        while step > 1e-6:
            ahead, g_ahead = loss(p - step * q)
            if ahead <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, g_ahead - g
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y, 1 / float(s @ y))]
        done = value - ahead < 1e-9 * max(1.0, abs(value))
        p, value, g = p + s, ahead, g_ahead
        if done:
            break
    return p


class Ordinal:
    """The mean negative log-likelihood of grades under cumulative links, with a ridge, and its gradient.

    Parameters: a weight for each column, a first threshold and the logarithms
    of the steps up to the next ones, so that thresholds stay ordered.
    """

    def __init__(self, owner: np.ndarray, column: np.ndarray, grades: np.ndarray, width: int, ridge: float):
        self.owner, self.column, self.grades, self.width, self.ridge = owner, column, grades, width, ridge
        by_column = np.argsort(column, kind="stable")
        self.owner_by_column = owner[by_column]
        self.starts = np.searchsorted(column[by_column], np.arange(width))

    def cuts(self, p: np.ndarray) -> np.ndarray:
        return p[self.width] + np.concatenate([[0.0], np.cumsum(np.exp(p[self.width + 1 :]))])

    def __call__(self, p: np.ndarray) -> tuple[float, np.ndarray]:
        w, rows, grades, ridge, cut = self.width, len(self.grades), self.grades, self.ridge, self.cuts(p)
        score = np.bincount(self.owner, p[self.column], rows)
        a, b = (1 / (1 + np.exp(-np.clip(x - score, -500, 500))) for x in (np.append(-1e3, cut)[grades], np.append(cut, 1e3)[grades]))
        chance = np.maximum(b - a, 1e-12)
        da, db = a * (1 - a) / chance / rows, b * (1 - b) / chance / rows
        slope = db - da  # by the score
        g = np.empty_like(p)
        g[:w] = (np.add.reduceat(slope[self.owner_by_column], self.starts) if w else 0) + ridge * p[:w]
        by_cut = np.bincount(grades, -db, GRADES)[:-1] + np.bincount(grades, da, GRADES)[1:]
        g[w] = by_cut.sum()
        g[w + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(p[w + 1 :]) + ridge * p[w + 1 :]
        return float(-np.log(chance).mean() + ridge / 2 * (p[:w] @ p[:w] + p[w + 1 :] @ p[w + 1 :])), g


def fit_ordinal(owner: np.ndarray, bucket: np.ndarray, grades: np.ndarray, rounds: int = 200, ridge: float = 1e-5, rare: int = 5, telling: float = 2.5) -> Model:
    """Fits weights and thresholds.

    Weights go to warning signs: buckets held by ``rare`` rows or more whose
    mean grade is ``telling`` standard errors or more below the overall mean.
    The others keep weight 0, as hundreds of common words in a long text would
    outweigh the one word that tells.
    """
    count = np.bincount(bucket, minlength=BUCKETS)
    apart = np.bincount(bucket, (grades - grades.mean())[owner], BUCKETS)
    use = (count >= rare) & (-apart >= telling * max(float(grades.std()), 1e-9) * np.sqrt(count))
    del count, apart
    owner, bucket = owner[use[bucket]], bucket[use[bucket]]
    known, column = np.unique(bucket, return_inverse=True)
    loss = Ordinal(owner, column, grades, len(known), ridge)
    below = np.cumsum(np.bincount(grades, minlength=GRADES) + 1.0)[:-1] / (len(grades) + GRADES)
    first = np.log(below / (1 - below))
    p = descend(loss, np.concatenate([np.zeros(len(known)), first[:1], np.log(np.maximum(np.diff(first), 1e-3))]), rounds)
    weights = np.zeros(BUCKETS, np.float32)
    weights[known] = p[: len(known)]
    return Model(weights, loss.cuts(p))


def grade(quality, toxic):
    """A point for good text, and one for text that isn't toxic."""
    return F.when(quality > 0, 1).otherwise(0) + F.when(toxic > 0, 0).otherwise(1)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_FEATURES) -> Model:
    """The model fitted on at most ``sample`` labelled documents of at most ``most`` features together; without any, one that gives every text grade 2."""
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    rated = rated.select(F.col("doc_id").alias("rated_id"), grade(F.col("quality"), F.col("toxic")).alias("grade"))
    chosen = rated.orderBy(F.xxhash64("rated_id"), "rated_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("rated_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                owner, bucket = features(batch["text"])
                cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                own = [bucket[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["grade"], pa.array(own, pa.binary())], names=["doc_id", "grade", "buckets"])

    found = Scratch(spark).write(texts.select(F.col("doc_id").cast("long"), F.col("grade").cast("int"), "text").mapInArrow(run, "doc_id long, grade int, buckets binary"))
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    sizes = found.groupBy("doc_id").agg(F.sum(F.length("buckets").cast("long") / 4).alias("n"))  # sample rows at most
    fits = sizes.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") <= most).select(F.col("doc_id").alias("fit_id"))
    table = found.join(F.broadcast(fits), F.col("doc_id") == F.col("fit_id")).drop("fit_id").toArrow()
    if not table.num_rows:
        return Model(np.zeros(BUCKETS, np.float32), np.full(GRADES - 1, -50.0))
    table = table.sort_by([("doc_id", "ascending"), ("buckets", "ascending")])
    lists = [np.frombuffer(x, "<i4") for x in table["buckets"].to_pylist()]
    owner = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    return fit_ordinal(owner, np.concatenate(lists), table["grade"].to_numpy().astype(np.int64))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with expected_grade, tail_probability (of the highest grade) and selected.

    selected is tail_probability >= ``least``. The whole text counts; null and
    empty texts have no features and get what the thresholds alone say. Labels
    without id or quality are left out, of several labels of one id the
    highest holds. Repeated rows stay, clashing columns are replaced, an empty
    label table selects everything.
    """
    shared = spark.sparkContext.broadcast(fit(spark, docs, labels, sample))
    kept = docs.select([c for c in docs.columns if c not in ("expected_grade", "tail_probability", "selected")])
    schema = kept.select("*", F.lit(0.0).alias("expected_grade"), F.lit(0.0).alias("tail_probability"), F.lit(True).alias("selected")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                tails = shared.value.tails(batch["text"])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)], names=[f.name for f in schema])

    return kept.mapInArrow(run, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
