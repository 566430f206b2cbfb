"""Importance resampling towards a target: hashed n-gram features, array-scored weights, Gumbel scores and a distributed radix sort.

Features are runs of one to three words. Their CRC-32 is put together from
those of single words: the checksum of two strings in a row is that of the
first, moved on by the length of the second, with that of the second. All
words of a slice are worked on at once. A bucket's gain is the logarithm of
its share in the target over its share in the corpus; the gains are one array
of fixed length, and a document's weight is the sum of those of its features.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .radix_sort import ranked
from .scratch import Scratch
from .textops import runs, slices, utf8

BUCKETS, LONGEST, LEAST_WORDS, SHARE, SEED = 10_000, 3, 20, 5, 42
U32 = np.uint32
NEAR = 64  # bytes; longer words are worked on one by one

_CRC = np.zeros(256, U32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c
_PART = np.ones(256, bool)  # bytes of words, once A-Z are lower-cased
_PART[:128] = False
_PART[[*range(48, 58), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _moves() -> np.ndarray:
    """What zero to NEAR + 1 zero bytes make of each byte of a checksum: (bytes, place, value)."""
    out = np.zeros((NEAR + 2, 4, 256), U32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint64).astype(U32) << U32(8 * k)
    for n in range(1, NEAR + 2):
        out[n] = _CRC[out[n - 1] & U32(255)] ^ (out[n - 1] >> U32(8))
    return out


_MOVED = _moves().reshape(-1)


def _moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksums moved on by so many bytes."""
    left = np.minimum(by, NEAR)
    at = left * 1024
    out = _MOVED[at + (crc & U32(255))]
    for k in range(1, 4):
        out ^= _MOVED[at + 256 * k + ((crc >> U32(8 * k)) & U32(255))]
    far = np.flatnonzero(by > NEAR)
    if len(far):
        out[far] = _moved_far(out[far], by[far] - NEAR)
    return out


def _moved_far(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The same for any number of bytes, by powers of two of them."""
    power = np.array([_MOVED[1024 + 256 * k + 2**b] for k in range(4) for b in range(8)], U32)  # what one zero byte makes of each bit
    out = crc.copy()
    while by.any():
        odd = (by & 1) == 1
        out[odd] = _applied(power, out[odd])
        power, by = _applied(power, power), by >> 1
    return out


def _applied(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros(len(crc), U32)
    for b in range(32):
        out ^= np.where((crc >> U32(b)) & U32(1), matrix[b], U32(0))
    return out


def word_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes."""
    sizes = ends - starts
    state = np.full(len(starts), 0xFFFFFFFF, U32)
    rows = np.flatnonzero(sizes <= NEAR)
    for at in range(NEAR):
        rows = rows[sizes[rows] > at]
        if not len(rows):
            break
        s = state[rows]
        state[rows] = _CRC[(s ^ data[starts[rows] + at]) & U32(255)] ^ (s >> U32(8))
    out = state ^ U32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > NEAR).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def features(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """How many words each text has, and for each length of a run the rows and buckets of its features, rows ascending."""
    raw, offsets = utf8(texts)
    data = _LOWER[raw]
    starts, ends = runs(_PART[data], offsets)
    at = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    single = word_checksums(data, starts, ends)
    sizes = ends - starts
    spaced = _moved(np.full(len(sizes), zlib.crc32(b" "), U32), sizes) ^ single  # of a space and the word
    found, run = [(owner, (single % U32(buckets)).astype(np.int32))], single
    for n in range(2, longest + 1):
        if len(run) < 2:
            break
        run = _moved(run[:-1], sizes[n - 1 :] + 1) ^ spaced[n - 1 :]
        whole = np.flatnonzero(owner[: len(run)] == owner[n - 1 :])
        found.append((owner[whole], (run[whole] % U32(buckets)).astype(np.int32)))
    return np.diff(at), found


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; tasks send their sums, at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in slices(whole):
                for _, b in features(batch["text"], buckets)[1]:
                    total += np.bincount(b, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    summed = texts.select(F.col(column).cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in summed.toLocalIterator():  # one row a bucket at most
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: 1,000 times the logarithm of its smoothed share in the target over that in the corpus, rounded down."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """row (a number of its own), doc_id, n_words, n_features and weight of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                words, found = features(batch["text"], len(gain))
                n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                for owner, b in found:
                    sums, ends = np.append(0, np.cumsum(gain[b])), np.searchsorted(owner, np.arange(batch.num_rows + 1))
                    n += np.diff(ends)
                    weight += sums[ends[1:]] - sums[ends[:-1]]
                yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array(words.astype(np.int64)), pa.array(n), pa.array(weight)], names=["row", "doc_id", "n_words", "n_features", "weight"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long")


def importance_sample(spark: SparkSession, docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """n_words, n_features, weight, score and rank of each document: ``share`` per cent of those with ``least_words`` words or more are drawn.

    Weight is the sum of the gains of a document's features, score adds a
    Gumbel number that follows from doc_id and ``seed``; so the highest scores
    are a draw without replacement by weight. rank counts from 1 among the
    drawn, ties of scores by doc_id, and is null for others. Null and wordless
    texts have no features and weight 0. Rows without doc_id have no score and
    are never drawn, nor do they count among those drawn from. Repeated rows
    stay, with places of their own. Only doc_id and text are read (of
    ``target``: text); an empty table gives no rows, an empty target gains
    from the corpus alone.
    """
    scratch = Scratch(spark)
    gain = gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = scratch.write(weighed(docs, gain).withColumn("score", F.col("weight") + gumbel))
    able = rows.where((F.col("n_words") >= least_words) & F.col("score").isNotNull()).select("row", "score", "doc_id")
    order = ranked(scratch, able, [("score", True), ("doc_id", False)])
    drawn = order.where(F.col("place") < share * order.count() // 100).select("row", (F.col("place") + 1).alias("rank"))
    return rows.join(drawn, "row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance_sample(spark, docs, target).select("doc_id", "n_features", "weight", "score", "rank")
