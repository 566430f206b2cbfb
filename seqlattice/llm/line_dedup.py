"""Line dedup by pairwise alignment.

Documents overlap where they share a run of lines: from each line on, and up to
each line, the shortest run of consecutive lines that reaches ``least`` words is
hashed, and each later holder of a run is paired with the run's first holder.
Every line of a common block lies in such a run inside the block, so one pair a
holder and run is enough, however common the single lines are. Pairs are
aligned by patience diff over line hashes: lines unique in both documents
and in the same order anchor the alignment, which grows from the anchors and
recurs between them; what is left over is aligned again until nothing
more is found, so moved and repeated blocks count too. Aligned lines grow to the
whole common block they lie in, and blocks of at least ``least`` words are
deleted from the later document. Only hashes and word counts of lines travel;
texts move once, to lose their lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .textops import _SEPARATORS, U64, run_hashes, runs, slices, span_hashes, utf8

LEAST_WORDS = 50


def outlines(docs: DataFrame) -> DataFrame:
    """doc_id, unit, and by line of the whole text the hash (hashes, 16 bytes) and the number of words (words, 4 bytes).

    unit tells the texts of rows with one id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                raw, offsets = utf8(batch["text"])
                breaks = np.flatnonzero(raw == 10)
                starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
                ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
                hashes = np.stack([span_hashes(raw, starts, ends, lower=False, seed=k) for k in (0, 1)], 1)
                words = runs(~_SEPARATORS[raw], offsets)[0]
                counts = (np.searchsorted(words, ends) - np.searchsorted(words, starts)).astype("<i4")
                lines = np.bincount(np.searchsorted(offsets[1:-1], breaks, "right"), minlength=batch.num_rows) + 1
                at = np.append(0, np.cumsum(lines))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["unit"], pa.array([hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    names=["doc_id", "unit", "hashes", "words"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("unit"), "text").mapInArrow(run, "doc_id long, unit long, hashes binary, words binary")


def shortest_runs(words: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and end of the shortest runs of ``least`` words from each line on and up to each line; documents start at ``at`` and no run leaves its document."""
    total = np.append(0, np.cumsum(words, dtype=np.int64))
    line = np.arange(len(words))
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    to = np.searchsorted(total, total[:-1] + max(least, 1), "left")
    since = np.searchsorted(total, total[1:] - max(least, 1), "right") - 1
    down, up = to <= at[owner + 1], since >= at[owner]
    found = np.unique(np.concatenate([line[down] * (len(words) + 1) + to[down], since[up] * (len(words) + 1) + line[up] + 1]))
    return found // (len(words) + 1), found % (len(words) + 1)


def runs_of(outlined: DataFrame, least: int) -> DataFrame:
    """(hash, doc_id, unit): each document's distinct shortest runs of ``least`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 2_000) for i in range(0, whole.num_rows, 2_000)):
                lines = [np.frombuffer(h, U64)[::2] for h in batch["hashes"].to_pylist()]
                at = np.append(0, np.cumsum([len(x) for x in lines]))
                first, end = shortest_runs(np.concatenate([np.frombuffer(w, "<i4") for w in batch["words"].to_pylist()]), at, least)
                hashes = run_hashes(np.concatenate(lines), first, end)
                owner = np.searchsorted(at, first, "right") - 1
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.ones(len(order), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[new].view(np.int64)), *[pa.array(batch[c].to_numpy()[owner[new]]) for c in ("doc_id", "unit")]], names=["hash", "doc_id", "unit"])

    return outlined.mapInArrow(run, "hash long, doc_id long, unit long")


def longest_rise(values: list[int]) -> list[int]:
    """Positions of a longest strictly rising subsequence (patience sorting)."""
    tops: list[int] = []
    ends: list[int] = []
    before = []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        before.append(ends[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[p], ends[p] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal lines, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = {}, {}
        for seen, part, at in ((once_a, a[a0:a1], a0), (once_b, b[b0:b1], b0)):
            for i, x in enumerate(part, at):
                seen[x] = -1 if x in seen else i
        pairs = [(i, once_b[x]) for x, i in once_a.items() if i >= 0 and once_b.get(x, -1) >= 0]
        anchors = [pairs[k] for k in longest_rise([j for _, j in pairs])]
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: np.ndarray, least: int) -> list[int]:
    """Lines of ``b`` in blocks that it shares with ``a`` (equal lines without a gap in either) of ``least`` words or more."""
    gone = np.zeros(len(b), bool)

    def grow(pairs: list[tuple[int, int]]) -> bool:
        """Deletes the whole blocks that the pairs lie in, where they are large enough; tells whether any line is new."""
        before, done = int(gone.sum()), (-1, -1)
        for i, j in sorted(pairs, key=lambda p: (p[1] - p[0], p[1])):
            if done[0] == j - i and j < done[1]:
                continue
            p, q = j, j
            while p > 0 and p + i - j > 0 and a[p - 1 + i - j] == b[p - 1]:
                p -= 1
            while q < len(b) and q + i - j < len(a) and a[q + i - j] == b[q]:
                q += 1
            done = (j - i, q)
            if int(words[p:q].sum()) >= least:
                gone[p:q] = True
        return int(gone.sum()) > before

    while True:
        left = np.flatnonzero(~gone).tolist()
        if not grow([(i, left[j]) for i, j in patience(a, [b[j] for j in left])]):
            break
    # what repeats too often to be aligned: runs of enough words that ``a`` holds somewhere
    known = dict(zip(b, words.tolist(), strict=True))
    held = dict(_runs(a, np.array([known.get(x, least) for x in a], np.int64), least))
    grow([(held[h], j) for h, j in _runs(b, words, least) if h in held])
    return np.flatnonzero(gone).tolist()


def _runs(lines: list[int], words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The hash and first line of each shortest run of ``least`` words."""
    first, end = shortest_runs(words, np.array([0, len(lines)]), least)
    return list(zip(run_hashes(np.array(lines, U64), first, end).tolist(), first.tolist(), strict=True))


def align(pairs: DataFrame, least: int) -> DataFrame:
    """(doc_id, unit, lines): positions of lines to delete, from pairs with both outlines (a_hashes, b, b_unit, b_hashes, b_words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, unit, x, y, w in zip(*(batch[c].to_pylist() for c in ("b", "b_unit", "a_hashes", "b_hashes", "b_words")), strict=True):
                words = np.frombuffer(w, "<i4")
                if x == y:
                    found.append((doc, unit, list(range(len(words)))))
                    continue
                a, b = np.frombuffer(x, "V16").tolist(), np.frombuffer(y, "V16").tolist()
                number = {line: i for i, line in enumerate(dict.fromkeys([*a, *b]))}
                lines = common_blocks([number[i] for i in a], [number[i] for i in b], words, least)
                if lines:
                    found.append((doc, unit, lines))
            ids, units, lines = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(units, pa.int64()), pa.array(lines, pa.list_(pa.int32()))], names=["doc_id", "unit", "lines"])

    return pairs.mapInArrow(run, "doc_id long, unit long, lines array<int>")


def dedup_lines(spark: SparkSession, docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with text freed of lines in blocks that an earlier document (smaller doc_id) holds too.

    Adds n_lines (before) and removed (the positions of deleted lines, from
    0, by position). Lines end at newlines and are equal if two 64-bit hashes
    of their bytes are. Null text stays null; an empty text has one empty
    line. Rows without doc_id keep their text. Rows with one id and text are
    one document; unlike texts under one id are documents of their own, in the
    order of their hashes. Documents that lose all lines keep their row with
    an empty text. Clashing columns are replaced.
    """
    scratch = Scratch(spark)
    named = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    outlined = scratch.write(outlines(named).dropDuplicates(["doc_id", "unit"]))  # read anew, so that the joins below can split the rows of a document with very many partners
    blocks = scratch.write(runs_of(outlined, least))
    own = F.struct("doc_id", "unit")
    held = blocks.groupBy("hash").agg(F.min(own).alias("first"), F.max(own).alias("last")).where("first < last")
    held = scratch.write(held.select(F.col("hash").alias("h"), "first"))  # read anew, so that the join can split the rows of a very common run
    pairs = blocks.join(held, F.col("hash") == F.col("h")).where(F.col("first") < own)
    pairs = scratch.write(pairs.select(F.col("doc_id").alias("b"), F.col("unit").alias("b_unit"), F.col("first.doc_id").alias("a"), F.col("first.unit").alias("a_unit")).distinct())
    scratch.drop(blocks)
    scratch.drop(held)
    left = outlined.select(F.col("doc_id").alias("a"), F.col("unit").alias("a_unit"), F.col("hashes").alias("a_hashes"))
    right = outlined.select(F.col("doc_id").alias("b"), F.col("unit").alias("b_unit"), F.col("hashes").alias("b_hashes"), F.col("words").alias("b_words"))
    sides = pairs.join(left, ["a", "a_unit"]).join(right, ["b", "b_unit"])
    gone = align(sides, least).select(F.col("doc_id").alias("__id"), F.col("unit").alias("__unit"), F.explode("lines").alias("line"))
    gone = scratch.write(gone.groupBy("__id", "__unit").agg(F.array_sort(F.collect_set("line")).alias("removed")))
    scratch.drop(outlined)
    scratch.drop(pairs)
    kept = docs.select([c for c in docs.columns if c not in ("n_lines", "removed")])
    # one plan at every size: texts move once, and the side that is held in memory has ids and line numbers only
    out = kept.join(gone.hint("shuffle_hash"), (kept["doc_id"] == gone["__id"]) & (F.xxhash64(kept["text"]) == gone["__unit"]), "left").drop("__id", "__unit")
    out = out.withColumn("n_lines", F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long"))
    parts = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    rest = F.transform(F.filter(parts, lambda p: ~F.array_contains("removed", p["i"])), lambda p: p["x"])
    out = out.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")))
    return out.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(spark, docs).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", "text")
