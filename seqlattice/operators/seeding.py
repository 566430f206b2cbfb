"""Seed search: exact k-mer seeds of reads against the genome, then bit-parallel verification of the windows they name."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bases import kmer_text, reverse_complement
from ..session import stored
from .seed_index import LETTERS, SeedIndex, build_index, compared, keyed_seeds, pattern_masks, search_index
from .tiles import cut, longest_of, look_up

SEED, STEP, LONGEST, TILE = 12, 8, 64, 256
LEFT, RIGHT, TOP = 0, 10, 10
BASES_ONLY = re.compile("[ACGT]*").fullmatch
CUT = 1 << 20  # bases of a stretch of ends that are sorted together
MANY_WORDS, MASK_BYTES = 8, 64 << 20  # of patterns that are compared together: words of 64 letters, and bytes of their masks


def genome_kmers(genome: DataFrame, k: int = SEED, tile: int = TILE) -> DataFrame:
    """(chrom_idx, pos, kmer), pos from 0. Chromosomes are cut into short tiles that overlap by k-1 bases, so a long one is many rows of work."""
    size = max(tile, k)
    tiles = genome.select("chrom_idx", F.posexplode(cut(kmer_text("seq"), size, k - 1)).alias("tile", "part")).where(F.length("part") >= k)
    kmers = tiles.select("chrom_idx", "tile", "part", F.explode(F.sequence(F.lit(1), F.length("part") - k + 1)).alias("i"))
    return kmers.select("chrom_idx", (F.col("tile") * size + F.col("i") - 1).alias("pos"), F.substring("part", F.col("i"), F.lit(k)).alias("kmer"))


def read_seeds(reads: DataFrame, k: int = SEED, step: int = STEP, whole: bool = False) -> DataFrame:
    """(read_id, strand, offset, kmer) of both strands, from the first 64 bases (the rest of a longer read takes no part in the search), with ``whole`` from all; reverse seeds end where the read ends."""
    first = lambda c: c if whole else F.substring(c, F.lit(1), F.lit(LONGEST))
    forward = reads.select("read_id", F.lit("+").alias("strand"), first(kmer_text("seq")).alias("s"), F.lit(0).alias("from"))
    back = reads.select("read_id", F.lit("-").alias("strand"), first(kmer_text(reverse_complement("seq"))).alias("s"))
    back = back.withColumn("from", F.greatest(F.length("s") - k, F.lit(0)) % step)
    both = forward.unionByName(back).where(F.length("s") >= k)
    seeds = both.select("read_id", "strand", "s", F.explode(F.sequence(F.col("from"), F.length("s") - k, F.lit(step))).alias("offset"))
    return seeds.select("read_id", "strand", "offset", F.substring("s", F.col("offset") + 1, F.lit(k)).alias("kmer"))


def seed_hits(genome: DataFrame, reads: DataFrame, k: int = SEED, step: int = STEP, whole: bool = False) -> DataFrame:
    """(read_id, strand, offset, chrom_idx, pos): seeds (read_seeds()) found in the genome; seeds of A only are left out before the join.

    Both sides are dealt by k-mer, so the rows of a very common one can be split over tasks.
    """
    dull = F.repeat(F.lit("A"), F.lit(k))
    seeds = read_seeds(reads, k, step, whole).where(F.col("kmer") != dull)
    return genome_kmers(genome, k).where(F.col("kmer") != dull).join(seeds, "kmer").select("read_id", "strand", "offset", "chrom_idx", "pos")


def diagonals(hits: DataFrame) -> DataFrame:
    """(read_id, strand, chrom_idx, diagonal, seeds): where a read would begin, and how many seeds say so."""
    return hits.groupBy("read_id", "strand", "chrom_idx", (F.col("pos") - F.col("offset")).alias("diagonal")).agg(F.count("*").alias("seeds"))


def admissible_links(ends: DataFrame, keys: list[str], width: int = CUT) -> DataFrame:
    """``keys``, end and next: for each end the smallest one of its group that comes ``len`` or more after it, null if there is none.

    Ends and the points len after them are sorted together inside stretches of
    ``width``; where a stretch holds no end any more, the first one of the next
    stretches counts. So no window holds a whole group.
    """
    own = ends.select(*keys, F.col("end").alias("v"), F.col("end").alias("real"), F.lit(None).cast("long").alias("of"))
    asked = ends.select(*keys, (F.col("end") + F.col("len")).alias("v"), F.lit(None).cast("long").alias("real"), F.col("end").alias("of"))
    points = own.unionByName(asked).withColumn("stretch", F.floor(F.col("v") / width))
    ahead = Window.partitionBy(*keys, "stretch").orderBy("v", F.col("real").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    near = points.withColumn("near", F.first("real", ignorenulls=True).over(ahead)).where("of IS NOT NULL")
    later = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(1, Window.unboundedFollowing)
    stretches = points.groupBy(*keys, "stretch").agg(F.min("real").alias("first")).withColumn("far", F.first("first", ignorenulls=True).over(later)).drop("first")
    return near.join(stretches, [*keys, "stretch"]).select(*keys, F.col("of").alias("end"), F.coalesce("near", "far").alias("next"))


def suppressed(hits: DataFrame, reads: DataFrame, k: int = SEED) -> DataFrame:
    """Hits that a scan from the left would test: one is taken if it ends a read's length or more after the last one taken, by read, strand and chromosome.

    The taken ends are a chain of links from the first. It is followed in
    steps that double: a round adds the ends one jump behind those found so
    far, then joins every jump with the next; rounds are written, and end when
    no jump is left. No group is ever one list or one task. A group whose ends
    all come within a read's length of its first has no link, and isn't looked
    at again.
    """
    keys = ["read_id", "strand", "chrom_idx"]
    lengths = reads.select("read_id", F.length("seq").cast("long").alias("len"))
    ends = stored(hits.join(lengths, "read_id").select(*keys, "len", (F.col("pos") + k - 1).cast("long").alias("end")).distinct())
    spans = stored(ends.groupBy(*keys).agg(F.min("end").alias("end"), (F.max("end") - F.min("end") >= F.max("len")).alias("more")))
    single, taken = (spans.where(F.col("more") == x).select(*keys, "end") for x in (False, True))
    linked = stored(ends.join(taken.select(*keys), keys, "left_semi"))
    jumps = stored(admissible_links(linked, keys).where("next IS NOT NULL"))
    while not jumps.isEmpty():
        taken = stored(taken.unionByName(taken.join(jumps, [*keys, "end"]).select(*keys, F.col("next").alias("end"))))
        onward = jumps.select(*keys, F.col("end").alias("next"), F.col("next").alias("after"))
        jumps = stored(jumps.join(onward, [*keys, "next"]).select(*keys, "end", F.col("after").alias("next")))
    return single.unionByName(taken)


def windows(genome: DataFrame, reads: DataFrame, places: DataFrame, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """The text that each (read_id, strand, chrom_idx, diagonal) is compared with, inside the chromosome, and the read as it lies there."""
    seq = reads.select("read_id", "seq", reverse_complement("seq").alias("rc"))
    joined = places.join(seq, "read_id").withColumn("read", F.when(F.col("strand") == "+", F.col("seq")).otherwise(F.col("rc"))).drop("seq", "rc")
    joined = joined.withColumn("window_start", F.greatest(F.col("diagonal") - left, F.lit(0)))
    at = look_up(joined, genome, "window_start", longest_of(reads, F.length("seq")) + left + right)
    size = F.greatest(F.col("diagonal") + F.length("read") + right - F.col("window_start"), F.lit(0))
    return at.select("read_id", "strand", "chrom_idx", "diagonal", "read", "window_start", F.substring("part", F.lit(1), size.cast("int")).alias("window"))


def best_matches(patterns: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Smallest edit distance of each pattern (its first 64 letters) to any substring of its text, and the largest start of such a substring.

    One bit-parallel column step a letter, from the right, for all pairs at once.
    """
    n = len(patterns)
    patterns = [p[:LONGEST] for p in patterns]
    sizes = np.array([len(p) for p in patterns], np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    masks = np.zeros((n, 256), np.uint64)
    for i, p in enumerate(patterns):
        for bit, c in enumerate(reversed(p.encode())):
            masks[i, c] |= np.uint64(1 << bit)
    width = int(lengths.max(initial=0))
    letters = np.zeros((n, width), np.uint8)
    for i, t in enumerate(texts):
        letters[i, : len(t)] = np.frombuffer(t.encode()[::-1], np.uint8)
    one = np.uint64(1)
    top = one << np.maximum(sizes - 1, 0).astype(np.uint64)
    up, down = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    score, best, where = sizes.copy(), sizes.copy(), lengths.copy()
    rows = np.arange(n)
    for j in range(width):
        equal = masks[rows, letters[:, j]]
        across = (((equal & up) + up) ^ up) | equal | down
        plus = down | ~(across | up)
        minus = up & across
        score = score + ((plus & top) > 0) - ((minus & top) > 0)
        plus, minus = plus << one, minus << one
        vertical = equal | down
        up = minus | ~(vertical | plus)
        down = plus & vertical
        better = (score < best) & (j < lengths) & (sizes > 0)
        best = np.where(better, score, best)
        where = np.where(better, lengths - j - 1, where)
    return best, where


def best_matches_whole(patterns: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """best_matches() over whole patterns of any length: states in words of 64, from which carries go on to the next word."""
    n, one = len(patterns), np.uint64(1)
    sizes, lengths = np.array([len(p) for p in patterns], np.int64), np.array([len(t) for t in texts], np.int64)
    words = max(1, -(-int(sizes.max(initial=1)) // LONGEST))
    masks = np.zeros((n, 256, words), np.uint64)
    for i, p in enumerate(patterns):
        raw = np.frombuffer(p.encode("ascii", "replace")[::-1], np.uint8)
        place = np.arange(len(raw))
        np.bitwise_or.at(masks[i], (raw, place // LONGEST), one << (place % LONGEST).astype(np.uint64))
    width = int(lengths.max(initial=0))
    letters = np.zeros((n, width), np.uint8)
    for i, t in enumerate(texts):
        letters[i, : len(t)] = np.frombuffer(t.encode("ascii", "replace")[::-1], np.uint8)
    last_word, last_bit = np.maximum(sizes - 1, 0) // LONGEST, one << (np.maximum(sizes - 1, 0) % LONGEST).astype(np.uint64)
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    score, best, where, rows = sizes.copy(), sizes.copy(), lengths.copy(), np.arange(n)
    high = np.uint64(LONGEST - 1)
    for j in range(width):
        plus_in, minus_in = np.zeros(n, np.uint64), np.zeros(n, np.uint64)  # what the row above gives the next word: one more, or one less
        for w in range(words):
            equal = masks[rows, letters[:, j], w]
            vertical = equal | down[w]
            equal = equal | minus_in
            across = (((equal & up[w]) + up[w]) ^ up[w]) | equal
            plus = down[w] | ~(across | up[w])
            minus = up[w] & across
            mine = last_word == w
            score = score + (mine & ((plus & last_bit) > 0)) - (mine & ((minus & last_bit) > 0))
            plus_out, minus_out = plus >> high, minus >> high
            plus, minus = plus << one | plus_in, minus << one | minus_in
            up[w], down[w] = minus | ~(vertical | plus), plus & vertical
            plus_in, minus_in = plus_out, minus_out
        better = (score < best) & (j < lengths) & (sizes > 0)
        best, where = np.where(better, score, best), np.where(better, lengths - j - 1, where)
    return best, where


def best_match_long(pattern: str, text: str) -> tuple[int, int]:
    """best_matches_whole() of one pair whose pattern may be very long: a column is one integer of as many bits."""
    size, masks = len(pattern), {}
    for c in set(pattern):
        masks[c] = int("".join("1" if x == c else "0" for x in pattern), 2)
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best, where = full, 0, size, size, len(text)
    for j, c in enumerate(reversed(text)):
        equal = masks.get(c, 0)
        across = (((equal & up) + up) ^ up | equal | down) & full
        plus, minus = down | full & ~(across | up), up & across
        score += bool(plus & top) - bool(minus & top)
        plus, minus, vertical = plus << 1 & full, minus << 1 & full, equal | down
        up, down = minus | full & ~(vertical | plus), plus & vertical
        if score < best:
            best, where = score, len(text) - j - 1
    return best, where


def _whole_matches(patterns: tuple[str, ...], texts: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Matches of whole patterns: up to 64 letters by _matches(), up to MANY_WORDS words for some at a time, longer ones alone."""
    words = np.array([-(-len(p) // LONGEST) for p in patterns], np.int64)
    error, at = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    for n in np.unique(words).tolist():
        rows = np.flatnonzero(words == n)
        some = max(1, MASK_BYTES // (2_048 * max(1, n))) if n <= MANY_WORDS else 1
        for i in (rows[j : j + some] for j in range(0, len(rows), some)):
            ps, ts = tuple(patterns[x] for x in i), tuple(texts[x] for x in i)
            if n <= 1:
                error[i], at[i] = _matches(ps, ts)
            elif n <= MANY_WORDS:
                error[i], at[i] = best_matches_whole(list(ps), list(ts))
            else:
                error[i], at[i] = best_match_long(ps[0], ts[0])
    return error, at


def _matches(patterns: tuple[str, ...], texts: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """best_matches() of many pairs, in the words of the stored index's search where all letters are bases."""
    if not all(p and BASES_ONLY(p) and BASES_ONLY(t) for p, t in zip(patterns, texts, strict=True)):
        return best_matches(list(patterns), list(texts))
    number: dict[str, int] = {}
    which = np.array([number.setdefault(p[:LONGEST], len(number)) for p in patterns], np.int64)
    masks, size, _ = pattern_masks(list(number))
    length = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(length) - length
    text = LETTERS[np.frombuffer("".join(texts).encode(), np.uint8)]
    order = np.argsort(length, kind="stable")
    error, at = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    error[order], at[order] = compared(masks, size, which[order], text, begin[order], length[order])
    return error, at


def verified(windowed: DataFrame, whole: bool = False) -> DataFrame:
    """Windows with error (smallest edit distance) and start (where in the chromosome that match begins, from 0).

    Of a longer read the first 64 bases count, with ``whole`` all of them.
    """
    schema = windowed.select("*", F.lit(0).alias("error"), F.lit(0).cast("long").alias("start")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for batch in (held.slice(i, 4_096) for i in range(0, held.num_rows, 4_096)):
                pairs: dict[tuple[str, str], int] = {}  # equal texts are compared once
                which = np.array([pairs.setdefault(x, len(pairs)) for x in zip(batch["read"].to_pylist(), batch["window"].to_pylist(), strict=True)], np.int64)
                error, at = (_whole_matches if whole else _matches)(*zip(*pairs, strict=True)) if pairs else (which, which)
                error, at = error[which], at[which]
                start = batch["window_start"].to_numpy(zero_copy_only=False) + at
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(error.astype(np.int32)), pa.array(start.astype(np.int64))], names=[f.name for f in schema])

    return windowed.mapInArrow(run, schema)


def top_hits(checked: DataFrame, most: int = TOP, worst: int = 15) -> DataFrame:
    """Each read's best places by error, then in scan order; equal places count once, those with ``worst`` errors or more not at all."""
    places = checked.where(F.col("error") < worst).groupBy("read_id", "strand", "chrom_idx", "start").agg(F.min("error").alias("error"), F.first(F.length("read")).alias("len"))
    order = Window.partitionBy("read_id").orderBy("error", "chrom_idx", "start", "strand")
    return places.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def search_plainly(genome: DataFrame, reads: DataFrame, k: int = SEED, step: int = STEP, left: int = LEFT, right: int = RIGHT, most: int = TOP) -> DataFrame:
    """The seed search with every window of every seed compared."""
    return top_hits(verified(windows(genome, reads, diagonals(seed_hits(genome, reads, k, step)), left, right)), most)


def search(genome: DataFrame, reads: DataFrame, k: int = SEED, step: int = STEP, left: int = LEFT, right: int = RIGHT, most: int = TOP, index: SeedIndex | None = None) -> DataFrame:
    """The seed search from end to end: (read_id, strand, chrom_idx, start, error, len, rank), as search_plainly() gives it.

    ``index`` is the genome's stored index; without one it is built for this search, of the seeds' k-mers only.
    """
    if step < 1:
        raise ValueError("steps are positive")
    reads = stored(reads.select("read_id", "seq"))
    index = index or build_index(genome, max(k, longest_of(reads, F.length("seq"))), k, left, right, seeds=keyed_seeds(reads, k, step))
    return search_index(index, reads, step, left, right, most)
