"""Edit-aware token counts over a segment tree of pre-tokens per document.

A document is a list of leaves of pre-tokens with a segment tree of their
sizes in code points and in tokens. An edit finds its place by descending the
tree, re-splits and re-encodes only what it touches with some context on both
sides, and updates the sums on the way up. The split is exact: it restarts at
a boundary LOOK code points or more before the edit, which no match before it
can look past, and ends where a new boundary falls on an old one. The leaves'
sums can be kept with the edited text: a later batch of edits starts from them
and splits only the leaves that it touches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .bpe import read_ranks

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE_SIZE = 1_000_000  # pre-tokens, and those of one text
LONG = 64  # characters; longer pre-tokens aren't kept
LEAF = 64  # pre-tokens
LOOK = 3  # code points that a match may look at from its end, or an alternative from its start
EDITS = "array<struct<start:long,stop:long,text:string>>"
LEAVES = "array<struct<chars:long,tokens:long>>"


class Counter:
    """Splits texts into pre-tokens and says how many tokens each has; keeps the counts of those seen, up to a bound."""

    def __init__(self, ranks: list[bytes], pattern: str):
        self.split = regex.compile(pattern).findall
        self.encode = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks={p: i for i, p in enumerate(ranks)}, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        try:
            return list(map(self.known.__getitem__, parts))
        except KeyError:
            pass
        if len(self.known) > CACHE_SIZE:
            self.known.clear()
        known, out = self.known, []
        for p in parts:
            n = known.get(p)
            if n is None:
                n = len(self.encode(p))
                if len(p) <= LONG:
                    known[p] = n
            out.append(n)
        return out


_counters: dict[str, Counter] = {}


class SegmentTree:
    """Sums of (chars, tokens) over leaves; the nodes of a level stand beside each other, node 1 is the root."""

    def __init__(self, leaves: list[tuple[int, int]]):
        self.size = 1
        while self.size < max(1, len(leaves)):
            self.size *= 2
        empty = (0, 0)
        self.nodes = [empty] * self.size + leaves + [empty] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            a, b = self.nodes[2 * i], self.nodes[2 * i + 1]
            self.nodes[i] = (a[0] + b[0], a[1] + b[1])

    def total(self) -> tuple[int, int]:
        return self.nodes[1]

    def set(self, leaf: int, sums: tuple[int, int]) -> None:
        i = leaf + self.size
        self.nodes[i] = sums
        while i > 1:
            i //= 2
            a, b = self.nodes[2 * i], self.nodes[2 * i + 1]
            self.nodes[i] = (a[0] + b[0], a[1] + b[1])

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds code point ``char`` (the last with any, beyond the end) and where it starts."""
        i, before = 1, 0
        char = min(char, self.nodes[1][0] - 1)
        while i < self.size:
            i *= 2
            if char - before >= self.nodes[i][0]:
                before += self.nodes[i][0]
                i += 1
        return i - self.size, before


class CountedText:
    """A text with its token count, kept up to date under edits.

    ``sums`` are the (chars, tokens) of the leaves of this very text, as
    sums() gave them; such leaves are split only when an edit touches them. A
    leaf is a list of pre-tokens, or its place in the text as it came.
    """

    def __init__(self, text: str, counter: Counter, sums: list[tuple[int, int]] | None = None):
        self.counter, self.source = counter, text
        self.encoded = 0  # pre-tokens encoded so far
        if sums and sum(c for c, _ in sums) == len(text):
            ends = np.cumsum([c for c, _ in sums]).tolist()
            self.leaves: list[list[str] | tuple[int, int]] = list(zip([0, *ends[:-1]], ends, strict=True))
            self.tree = SegmentTree(list(sums))
        else:
            self._build(counter.split(text))

    def _build(self, parts: list[str]) -> None:
        """Leaves and tree of a whole text, whose pre-tokens are encoded together."""
        self.encoded += len(parts)
        chars, tokens = self._sizes(parts)
        self.leaves = [parts[i : i + LEAF] for i in range(0, len(parts), LEAF)] or [[]]
        at = np.arange(0, len(parts), LEAF)
        self.tree = SegmentTree(list(zip(np.add.reduceat(chars, at).tolist(), np.add.reduceat(tokens, at).tolist(), strict=True)) if len(at) else [(0, 0)])

    def _parts(self, leaf: int) -> list[str]:
        """The pre-tokens of a leaf; what follows it in the text as it came shows where the last one ends."""
        held = self.leaves[leaf]
        if isinstance(held, tuple):
            start, stop = held
            held, at = [], start
            for p in self.counter.split(self.source[start : stop + LOOK]):
                if at == stop:
                    break
                held.append(p)
                at += len(p)
            self.leaves[leaf] = held
        return held

    def sums(self) -> list[tuple[int, int]]:
        """(chars, tokens) of the leaves that hold anything."""
        return [s for s in self.tree.nodes[self.tree.size : self.tree.size + len(self.leaves)] if s[0]]

    def _sizes(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points and tokens of each pre-token."""
        return np.fromiter(map(len, parts), np.int64, len(parts)), np.array(self.counter.counts(parts), np.int64)

    def _sums(self, parts: list[str]) -> tuple[int, int]:
        chars, tokens = self._sizes(parts)
        return int(chars.sum()), int(tokens.sum())

    @property
    def tokens(self) -> int:
        return self.tree.total()[1]

    @property
    def chars(self) -> int:
        return self.tree.total()[0]

    def text(self) -> str:
        return "".join([self.source[x[0] : x[1]] if isinstance(x, tuple) else "".join(x) for x in self.leaves])

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replaces code points ``start`` to ``stop`` (held within the text) by ``text``."""
        n = self.chars
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        if not n:
            self._build(self.counter.split(text))
            return
        leaf, at = self.tree.find(max(0, start - LOOK))
        parts, first = self._parts(leaf), 0
        while first < len(parts) and at + len(parts[first]) <= start - LOOK:
            at += len(parts[first])
            first += 1
        kept, old, last = parts[:first], parts[first:], leaf
        span = sum(map(len, old))
        while True:  # until the new boundaries meet the old ones
            while at + span < min(n, stop + 2 * LOOK) and last + 1 < len(self.leaves):
                last += 1
                old = old + self._parts(last)
                span += sum(map(len, self._parts(last)))
            whole = "".join(old)
            fresh = whole[: start - at] + text + whole[stop - at :]
            shift = len(fresh) - len(whole)
            bounds, here = {}, 0
            for i, p in enumerate(old):
                here += len(p)
                bounds[here] = i + 1
            ends = at + span >= n
            done, here, found = [], 0, self.counter.split(fresh)
            tail: list[str] | None = None
            for p in found:
                done.append(p)
                here += len(p)
                if here - shift >= stop - at and here - shift in bounds and (ends or here <= len(fresh) - LOOK):
                    tail = old[bounds[here - shift] :]
                    break
            if tail is not None or ends:
                break
            last += 1
            old = old + self._parts(last)
            span += sum(map(len, self._parts(last)))
        middle = kept + done + (tail or [])
        self.encoded += len(done)
        if len(middle) > 8 * LEAF * (last - leaf + 1):  # a long insertion: new leaves between the others, whose sums stay
            cut = [middle[i : i + LEAF] for i in range(0, len(middle), LEAF)]
            known = self.tree.nodes[self.tree.size : self.tree.size + len(self.leaves)]
            self.leaves[leaf : last + 1] = cut
            self.tree = SegmentTree(known[:leaf] + [self._sums(x) for x in cut] + known[last + 1 :])
            return
        self.leaves[leaf] = middle
        self.tree.set(leaf, self._sums(middle))
        for i in range(leaf + 1, last + 1):
            self.leaves[i] = []
            self.tree.set(i, (0, 0))


def count_edits(spark: SparkSession, docs: DataFrame, path: str, pattern: str, edits: str = "edits", leaves: str | None = None, keep: bool = False) -> DataFrame:
    """``docs`` with n_tokens, n_tokens_edited, n_pretokens and n_reencoded; with ``keep`` also edited_text and edited_leaves.

    ``edits`` is a column of EDITS, applied in order, each to the text that
    the one before it left; positions are code points, held within the text.
    ``leaves`` names a column of LEAVES, the edited_leaves of an earlier call
    whose edited_text is now the text: the count then starts from their sums.
    Null leaves, or such as don't add up to the text's length, count as none.
    Null text counts as empty, a null list or edit as none, a null replacement
    as deletion. n_pretokens is how many pre-tokens were encoded before the
    edits (all of the text's, or none where its leaves are known), n_reencoded
    how many because of them. Repeated rows stay; clashing columns are
    replaced. No shuffle.
    """
    ranks = read_ranks(path)
    name = hashlib.sha256(repr((ranks, pattern)).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary
    added = {"n_tokens": "long", "n_tokens_edited": "long", "n_pretokens": "long", "n_reencoded": "long"} | ({"edited_text": "string", "edited_leaves": LEAVES} if keep else {})
    types = {edits: EDITS} | ({leaves: LEAVES} if leaves else {})
    kept = docs.select([F.col(c).cast(types[c]).alias(c) if c in types else c for c in docs.columns if c not in added or c in types])
    told = [c for c in kept.columns if c not in added]
    schema = kept.select(*told, *[F.lit(None).cast(t).alias(c) for c, t in added.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _counters:
            _counters[name] = Counter(shared.value, pattern)
        counter = _counters[name]
        leaf_type = pa.list_(pa.struct([("chars", pa.int64()), ("tokens", pa.int64())]))
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                rows = []
                known = batch[leaves].to_pylist() if leaves else [None] * batch.num_rows
                for text, todo, sums in zip(batch["text"].to_pylist(), batch[edits].to_pylist(), known, strict=True):
                    sums = [(x["chars"], x["tokens"]) for x in sums if x and x["chars"] is not None and x["tokens"] is not None] if sums else None
                    counted = CountedText(text or "", counter, sums)
                    before, parts = counted.tokens, counted.encoded
                    for e in todo or []:
                        if e is not None:
                            counted.edit(e["start"] or 0, e["stop"] if e["stop"] is not None else e["start"] or 0, e["text"] or "")
                    rows.append((before, counted.tokens, parts, counted.encoded - parts, *((counted.text(), [{"chars": c, "tokens": t} for c, t in counted.sums()]) if keep else ())))
                kinds = [pa.int64()] * 4 + ([pa.string(), leaf_type] if keep else [])
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in told), *columns], names=[f.name for f in schema])

    return kept.mapInArrow(run, schema)


def standard_edits(text):
    """A deletion in the last quarter, an insertion in the middle and a replacement near the start."""
    n = F.length(F.coalesce(text, F.lit(""))).cast("long")
    at = lambda share: F.floor(n * share).cast("long")
    one = lambda a, b, t: F.struct(a.alias("start"), b.alias("stop"), F.lit(t).alias("text"))
    return F.array(one(at(0.75), at(0.75) + 12, ""), one(at(0.5), at(0.5), " revised 2nd's\n\n  draft"), one(at(0.1), at(0.1) + 5, "it'll"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumn("edits", standard_edits(F.col("text")))
    return count_edits(spark, docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=True).drop("text", "edits", "edited_text")
