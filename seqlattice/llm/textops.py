"""Vectorised work on Arrow columns of text: words, hashes, shingles, distinct sets.

Everything here runs inside a task on one slice of an Arrow batch; a slice
holds a few megabytes of text whatever the batch holds (a single longer text
makes a slice of its own), so memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
SLICE_BYTES = 1 << 20
SHORT = 64  # bytes; longer spans are hashed one by one
_BASE = 0x9E3779B97F4A7C15
_PARTIAL = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], U64)
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """``batch`` cut into pieces of at most SLICE_BYTES of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, and where each starts and ends; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8, offsets[-1]) if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return raw[offsets[0] :], offsets - offsets[0]


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags; no run crosses a text's border."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[offsets] = True
    first, last = flags.copy(), flags.copy()
    first[1:] &= ~flags[:-1] | edge[1:-1]
    last[:-1] &= ~flags[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; another seed gives another hash.

    Spans of SHORT bytes or fewer are mixed eight bytes at a time, all spans
    together, so unlike spans of up to eight bytes never meet; longer ones go
    through XXH3 one by one.
    """
    data = _LOWER[raw] if lower else raw
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    sizes = ends - starts
    h = mix(sizes.astype(U64) + U64(_BASE * (2 * seed + 1) & 0xFFFFFFFFFFFFFFFF))
    rows = np.flatnonzero((sizes > 0) & (sizes <= SHORT))
    for at in range(0, SHORT, 8):
        rows = rows[sizes[rows] > at] if at else rows
        if not len(rows):
            break
        h[rows] = mix(h[rows] ^ (eight[starts[rows] + at] & _PARTIAL[np.minimum(sizes[rows] - at, 8)]))
    for i in np.flatnonzero(sizes > SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].data, seed)
    return h


def run_hashes(items: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run ``items[first:end]`` of 64-bit numbers, of one or more.

    Hashes of 1, 2, 4, ... items from each place are built from those of half
    as many; a run takes the two of the largest power that fits, at its start
    and at its end.
    """
    size = end - first
    power = np.frexp(size)[1] - 1
    out = np.zeros(len(first), U64)
    level = mix(items)
    for k in range(int(power.max(initial=-1)) + 1):
        at = np.flatnonzero(power == k)
        out[at] = mix(mix(level[first[at]] + U64(_BASE)) ^ (level[end[at] - (1 << k)] * U64(3) + size[at].astype(U64)))
        half = 1 << k
        if len(level) <= half:
            break
        level = mix(mix(level[:-half] + U64(k + 1)) ^ (level[half:] * U64(3)))
    return out


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and where each text's words start and end."""
    raw, offsets = utf8(texts)
    starts, ends = runs(~_SEPARATORS[raw], offsets)
    return span_hashes(raw, starts, ends, lower), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes; fewer words make one shingle, none an empty set."""
    words, at = word_hashes(texts)
    out = []
    weights = [U64((_BASE * (2 * i + 3)) & 0xFFFFFFFFFFFFFFFF | 1) for i in range(k)]
    rolled = np.zeros(max(0, len(words) - k + 1), U64)
    for i in range(k):
        rolled += words[i : i + len(rolled)] * weights[i]
    rolled = mix(rolled)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            short = np.full(1, b - a, U64)
            for i in range(b - a):
                short += words[a + i : a + i + 1] * weights[i]
            out.append(mix(short))
        else:
            out.append(np.zeros(0, U64))
    return out


def token_runs(texts: pa.Array, prefixes: tuple[int, ...] = ()) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of each text's runs of letters, of digits and of symbols, lower-cased, and where each text's start.

    The first array has the hashes of whole runs, then one for each of
    ``prefixes`` has those of the first so many bytes (of shorter runs: again
    of the whole).
    """
    raw, offsets = utf8(texts)
    kind = _KIND[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = kind > 0
    first[1:] &= (kind[1:] != kind[:-1]) | edge[1:-1]
    last = kind > 0
    last[:-1] &= (kind[1:] != kind[:-1]) | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    found = [span_hashes(raw, starts, ends), *[span_hashes(raw, starts, np.minimum(ends, starts + n)) for n in prefixes]]
    return found, np.searchsorted(starts, offsets)


_KIND = np.full(256, 3, np.uint8)
_KIND[_SEPARATORS] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole runs of equal keys from batches sorted by ``keys``: each table yielded holds one or more complete groups."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch[k].to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        first = tuple(batch[k][0].as_py() for k in keys)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cut = np.flatnonzero(change)
        if len(cut):
            yield pa.Table.from_batches([*held, batch.slice(0, cut[-1])])
            held = [batch.slice(cut[-1])]
        else:
            held.append(batch)
        last = tuple(batch[k][batch.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of equal keys starts, and the end of the last."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        v = table[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
