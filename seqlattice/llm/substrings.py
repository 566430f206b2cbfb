"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark; repeated windows merge into maximal removal intervals.

Documents are dealt to slices. A slice rolls a hash over its words, settles
what repeats inside the slice, and sends each distinct window once to the
bucket of its hash, packed with the others that go there. A bucket finds the
smallest document of every hash and answers with a bit for each window: does
it also start in a smaller document? The bits go back to the slice, whose
windows become removal intervals. The texts are shuffled once and read twice
from that shuffle; a window costs seven bytes of hash on its way and a bit on
its way back. Slices and buckets grow in number, not in size; a window that
occurs everywhere reaches its bucket once from each slice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import _SEPARATORS, U64, mix, runs, span_hashes, utf8

WINDOW = 20
SLICE_CHARS, BUCKET_CHARS = 6 << 20, 6 << 20  # of text in a slice, and of text whose windows share a bucket, on average
LAST = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15  # odd
SENT = "slice long, bucket int, hashes binary, ids binary, times binary"
PIECE = 1 << 18  # windows hashed at once
RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, text string"


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """The Rabin-Karp hash of each ``size`` words in a row: a polynomial in BASE modulo 2^64."""
    out = np.zeros(max(0, len(words) - size + 1), U64)
    for a in range(0, len(out), PIECE):
        part = out[a : a + PIECE]
        for i in range(size):
            part *= U64(BASE)
            part += words[a + i : a + i + len(part)]
    return mix(out)


@dataclass
class Slice:
    """The windows of a slice's texts, in the order of doc_id, and what can be settled without the others."""

    raw: np.ndarray
    starts: np.ndarray  # of words, in bytes
    ends: np.ndarray
    first: np.ndarray  # the first word of each text, and the end of the last
    at: np.ndarray  # the first word of each window
    earlier: np.ndarray  # whether the window also starts earlier in its text, or in a smaller document of the slice
    ask: np.ndarray  # which of the sent windows tells of the others
    hashes: np.ndarray  # of the sent windows, by bucket, then in the order of the texts
    ids: np.ndarray
    bounds: np.ndarray  # where each bucket's windows start


def windows_of(texts: pa.Array, ids: np.ndarray, size: int, buckets: int) -> Slice:
    """The slice of texts that go by ``ids``, ascending."""
    raw, offsets = utf8(texts)
    starts, ends = runs(~_SEPARATORS[raw], offsets)
    first = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(len(ids)), np.maximum(np.diff(first) - size + 1, 0))
    begin = np.append(0, np.cumsum(np.maximum(np.diff(first) - size + 1, 0)))
    at = np.arange(begin[-1]) - begin[owner] + first[owner]
    h = rolled(span_hashes(raw, starts, ends, lower=False), size)[at]
    order = np.argsort(h, kind="stable")
    sorted_h, doc, row = h[order], ids[owner[order]], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_h[1:] != sorted_h[:-1]
    group = np.cumsum(new) - 1
    lead = np.flatnonzero(new)
    behind = doc > doc[lead][group] if len(lead) else np.zeros(0, bool)
    behind[1:] |= ~new[1:] & (row[1:] == row[:-1])
    earlier = np.empty(len(order), bool)
    earlier[order] = behind
    sent = np.zeros(len(order), bool)
    sent[order[lead]] = True
    places = np.flatnonzero(sent)
    bucket = ((h[places] >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    deal = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    number = np.empty(len(order), np.int64)
    number[places[deal]] = np.arange(len(places))
    ask = np.empty(len(order), np.int64)
    ask[order] = number[order[lead]][group] if len(lead) else 0
    return Slice(raw, starts, ends, first, at, earlier, ask, h[places][deal], ids[owner[places]][deal], np.searchsorted(bucket[deal], np.arange(buckets + 1)))


def _read(table: pa.Table | pa.RecordBatch, size: int, buckets: int) -> tuple[Slice, pa.Table]:
    """The slice of the rows of one group, and those rows in its order; rows without id come last."""
    ids = pc.fill_null(table["doc_id"], LAST).to_numpy()
    order = np.argsort(ids, kind="stable")
    table = table.take(pa.array(order))
    text = table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"]
    return windows_of(text, ids[order], size, buckets), table


def _sent(size: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        s, table = _read(table, size, buckets)
        rows = []
        for b in np.flatnonzero(np.diff(s.bounds)).tolist():
            x, y = s.bounds[b], s.bounds[b + 1]
            new = np.flatnonzero(np.append(True, s.ids[x + 1 : y] != s.ids[x : y - 1]))
            low = np.ascontiguousarray(s.hashes[x:y].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :7]  # the eighth byte is all but told by the bucket
            rows.append((table["slice"][0].as_py(), b, low.tobytes(), s.ids[x:y][new].astype("<i8").tobytes(), np.diff(np.append(new, y - x)).astype("<u4").tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["slice", "bucket", "hashes", "ids", "times"])

    return run


def _answered(table: pa.Table) -> pa.Table:
    """For each slice's windows of one bucket, whether they start in a smaller document, too."""
    hashes, ids = [], []
    for h, i, t in zip(*[table[c].to_pylist() for c in ("hashes", "ids", "times")], strict=True):
        wide = np.zeros((len(h) // 7, 8), np.uint8)
        wide[:, :7] = np.frombuffer(h, np.uint8).reshape(-1, 7)
        hashes.append(wide.view("<u8").ravel())
        ids.append(np.repeat(np.frombuffer(i, "<i8"), np.frombuffer(t, "<u4")))
    sizes = np.array([len(x) for x in hashes])
    h, doc = np.concatenate(hashes), np.concatenate(ids)
    order = np.argsort(h)
    new = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    least = np.minimum.reduceat(doc[order], new)
    later = np.empty(len(h), bool)
    later[order] = doc[order] > np.repeat(least, np.diff(np.append(new, len(h))))
    ends = np.cumsum(sizes)
    bits = [later[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    some = np.flatnonzero([b.any() for b in bits])
    kept = table.select(["slice", "bucket"]).take(pa.array(some))
    return kept.append_column("bits", pa.array([np.packbits(bits[i]).tobytes() for i in some.tolist()], pa.binary()))


def intervals(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of words covered by windows that begin at ``at``, ascending."""
    if not len(at):
        return at, at
    gap = np.flatnonzero(np.diff(at) > size)
    return at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)] + size


def _cut(size: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if left.num_rows:
            s, left = _read(left, size, buckets)
            later = np.zeros(len(s.hashes), bool)
            for b, bits in zip(right["bucket"].to_pylist(), right["bits"].to_pylist(), strict=True):
                x, y = s.bounds[b], s.bounds[b + 1]
                later[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8), count=y - x)
            gone = s.at[s.earlier | later[s.ask]] if len(s.at) else s.at
            cuts = np.searchsorted(gone, s.first)
            data = s.raw.tobytes()
            begins, stops = s.starts.tolist(), s.ends.tolist()
            for r, doc in enumerate(left["doc_id"].to_pylist()):
                a, b = int(s.first[r]), int(s.first[r + 1])
                froms, tos = (x.tolist() for x in intervals(gone[cuts[r] : cuts[r + 1]], size))
                kept, here = [], a
                for x, y in [*zip(froms, tos, strict=True), (b, b)]:
                    kept += [data[begins[i] : stops[i]] for i in range(here, x)]
                    here = y
                for column, value in zip(out, (doc, b - a, b - a - len(kept), [{"start": x - a, "end": y - a} for x, y in zip(froms, tos, strict=True)], b" ".join(kept).decode()), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Each document without the words of windows that start earlier, too: doc_id, n_words, n_removed, removed, text.

    A window is ``size`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one text.
    It goes if the same words also start earlier in its text or in a document
    of smaller doc_id; all windows are judged on the input. ``removed`` has
    the maximal intervals of words that go (from 0, end exclusive), ``text``
    the words left, joined by one space. Null and empty texts have no words.
    Rows of one id, repeated or not, don't come before each other; rows
    without id come after all others. Words are equal if their 64-bit hashes
    are, windows if those of their words are. Only doc_id and text are read;
    an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices, buckets = max(tasks, -(-chars // SLICE_CHARS)), max(tasks, -(-chars // BUCKET_CHARS))
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(slices))).repartition(slices, "slice")
    sent = dealt.groupBy("slice").applyInArrow(_sent(size, buckets), SENT)
    answers = sent.groupBy("bucket").applyInArrow(_answered, "slice long, bucket int, bits binary")
    return dealt.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_cut(size, buckets), RESULT)


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM n),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE r > 1),
l AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT l.doc_id, count(*) AS n, string_agg(w[l.p], ' ' ORDER BY l.p) AS t FROM l ANTI JOIN c ON c.doc_id = l.doc_id AND c.p = l.p GROUP BY l.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
