"""Byte-level BPE encoding and decoding through a serialised sentencepiece model.

The vocabulary of ranks becomes a sentencepiece BPE model directly, without
training: piece i is the byte string of rank i with every byte mapped to a
printable character, its score is -i, and normalisation is the identity.
Merging by the highest score is then merging by the lowest rank. Pre-tokens
(matches of the pattern) are encoded separately; a pre-token that is itself a
piece is that piece. Decoding asks the model for each id's piece and maps its
characters back to bytes.

The model is a fixed few megabytes at most (the size of the vocabulary), so it
is broadcast. Texts are handled one by one inside a task; pre-tokens seen
before come from a cache of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_SIZE = 400_000  # pre-tokens, and those of one piece of a text
LONG = 200  # characters; longer pre-tokens aren't kept


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank, from a file of ``base64 rank`` lines; ranks must be 0 to n-1."""
    found = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                piece, rank = line.split()
                found[int(rank)] = base64.b64decode(piece)
    if sorted(found) != list(range(len(found))):
        raise ValueError(f"{path}: ranks are not 0 to {len(found) - 1}")
    return [found[i] for i in range(len(found))]


def byte_characters() -> list[str]:
    """A character for each byte: printable Latin-1 bytes stand for themselves, the others follow from 256 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    keep = set(plain)
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value & 0xFFFFFFFFFFFFFFFF)


def serialise_model(ranks: list[bytes]) -> bytes:
    """The sentencepiece ModelProto of the vocabulary; ids equal ranks, and one unknown piece follows them."""
    to = byte_characters()
    normal, unknown = 1, 2
    out = bytearray()
    for i, piece in enumerate(ranks):
        text = "".join([to[b] for b in piece]).encode()
        out += _field(1, _field(1, text) + _field(2, float(-i)) + _field(3, normal))
    out += _field(1, _field(1, b"<unk>") + _field(2, float(-len(ranks))) + _field(3, unknown))
    bpe = 2
    out += _field(2, _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + _field(41, -1) + _field(42, -1) + _field(43, -1))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    """Encodes and decodes with one model; lives as long as its Python worker uses it.

    A pre-token that is a piece of the vocabulary has that one id, as the
    tiktoken library gives it even where merges would end elsewhere; all other
    pre-tokens are merged by sentencepiece.
    """

    def __init__(self, ranks: list[bytes], model: bytes, pattern: str):
        self.whole = {p: i for i, p in enumerate(ranks)}
        self.split = regex.compile(pattern).findall
        self.spm = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table = {i: c for i, c in enumerate(byte_characters())}
        back = {ord(c): b for b, c in enumerate(byte_characters())}
        self.pieces = [p.translate(back).encode("latin-1") for p in self.spm.id_to_piece(list(range(len(ranks))))]
        self.cache: dict[str, bytes] = {}

    def _learn(self, pretokens: list[str]) -> None:
        ask = []
        for p in pretokens:
            raw = p.encode("utf-8", "surrogatepass")
            i = self.whole.get(raw)
            if i is None:
                ask.append((p, raw.decode("latin-1").translate(self.table)))
            else:
                self.cache[p] = np.uint32(i).tobytes()
        for (p, _), ids in zip(ask, self.spm.encode([m for _, m in ask], num_threads=1) if ask else [], strict=True):
            self.cache[p] = np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_parts(self.split(text))

    def encode_parts(self, parts: list[str]) -> bytes:
        """The ids of pre-tokens."""
        try:
            return b"".join(map(self.cache.__getitem__, parts))
        except KeyError:
            pass
        out = []
        for at in range(0, len(parts), 100_000):
            some = parts[at : at + 100_000]
            missing = set(some).difference(self.cache)
            if missing and len(self.cache) + len(missing) > CACHE_SIZE:
                self.cache.clear()
                missing = set(some)
            self._learn(list(missing))
            out += map(self.cache.__getitem__, some)
            for p in missing:
                if len(p) > LONG:
                    del self.cache[p]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[str, Codec] = {}


def _codec(shared, name: str) -> Codec:
    if name not in _codecs:
        _codecs[name] = Codec(*shared.value)
    return _codecs[name]


def encode_texts(spark: SparkSession, docs: DataFrame, path: str, pattern: str, column: str = "text", ids: bool = True) -> DataFrame:
    """``docs`` with token ids of the whole text and what decoding them gives.

    Adds n_tokens (long), token_ids (binary, little-endian unsigned 32-bit;
    only with ``ids``), ids_sha256 and decoded_sha256 (hex). Null text counts
    as empty: no tokens, digests of nothing. All other columns, repeated rows
    and their order within a partition stay; columns that clash with the added
    names are replaced. No shuffle.
    """
    ranks = read_ranks(path)
    model = serialise_model(ranks)
    name = hashlib.sha256(model + pattern.encode()).hexdigest()
    shared = spark.sparkContext.broadcast((ranks, model, pattern))
    added = ["n_tokens", "token_ids", "ids_sha256", "decoded_sha256"]
    kept = docs.select([c for c in docs.columns if c not in added])
    extra = "n_tokens long, " + ("token_ids binary, " if ids else "") + "ids_sha256 string, decoded_sha256 string"
    schema = kept.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in extra.split(", "))]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, name)
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                count, tokens, first, second = [], [], [], []
                for text in batch[column].to_pylist():
                    found = codec.encode(text or "")
                    count.append(len(found) // 4)
                    if ids:
                        tokens.append(found)
                    first.append(hashlib.sha256(found).hexdigest())
                    second.append(hashlib.sha256(codec.decode(found)).hexdigest())
                columns = [pa.array(count, pa.int64()), *([pa.array(tokens, pa.binary())] if ids else []), pa.array(first), pa.array(second)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[f.name for f in schema])

    return kept.mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    done = encode_texts(spark, docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ids=False)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
