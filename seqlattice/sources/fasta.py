"""Indexed FASTA: genomes of any size by byte ranges, without a row for a chromosome.

A file is scanned in stretches of at most STRETCH bytes. A stretch tells its
headers and how many bases lie between them; what a line that began in an
earlier stretch is, and which base comes first, follows from the stretches
before by running sums. The result is a table of segments: which bytes hold
which bases of which chromosome. Tiles are cut from segments, each read once;
a lookup reads the bytes of its own bases only, where lines have one length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..session import stored
from .ranges import Bytes, files_of

STRETCH, SPLIT = 1 << 20, 32 << 20
PARTS, ROWS = 256, 5_000  # tasks of a scan, unless each then had more than SPLIT bytes; pieces in a batch
HELD = 4 << 20  # bases of tiles in a batch, and one segment more
BIN = 1 << 16  # bases; places and segments meet by these
PIECES = "file string, begin long, end long, kind string, name string, bases long, lead long, line long, width long"
_KEPT = np.full(256, ord("N"), np.uint8)  # letters of a sequence: either case, U as T, others than bases as N
for _c in "ACGT":
    _KEPT[[ord(_c), ord(_c.lower())]] = ord(_c)
_KEPT[[ord("U"), ord("u")]] = ord("T")


def letters(data: bytes) -> str:
    """The bases in some bytes of a file."""
    raw = np.frombuffer(data, np.uint8)
    return _KEPT[raw[raw > 32]].tobytes().decode("ascii")


def shape(raw: np.ndarray) -> tuple[int, int, int]:
    """Bases up to the first line break, bases of the other lines and bytes from break to break; zeros if lines differ or hold other white space."""
    ends = np.flatnonzero(raw == 10)
    if not len(ends):
        return (len(raw), len(raw) or 1, len(raw) or 1) if (raw > 32).all() else (0, 0, 0)
    blank = np.append(0, np.cumsum(raw <= 32))
    bases = np.diff(np.append(np.append(0, ends + 1), len(raw))) - np.diff(blank[np.append(np.append(0, ends + 1), len(raw))])
    gaps, eol = np.diff(ends), 1 + int(ends[0] > 0 and raw[ends[0] - 1] == 13)
    tail = len(raw) - 1 - ends[-1]
    width = int(gaps[0]) if len(gaps) else int(max(tail, 1) + eol)
    even = (gaps == width).all() and (bases[1:-1] == width - eol).all() and bases[0] == ends[0] + 1 - eol and tail <= width and bases[-1] in (tail, max(0, tail - 1)) and (len(gaps) or bases[-1] == tail)
    return (int(bases[0]), width - eol, width) if even and width > eol else (0, 0, 0)


def pieces_of(file: Bytes, path: str, begin: int, end: int) -> list[tuple]:
    """PIECES of a stretch: the rest of a line that began before (kind rest), headers (head) and runs of sequence lines (seq)."""
    data = file.read(begin, end)
    end = begin + len(data)
    raw = np.frombuffer(data, np.uint8)
    out, at = [], begin
    if begin and file.read(begin - 1, begin) != b"\n":
        cut = data.find(b"\n") + 1 or len(data)
        out.append((path, begin, begin + cut, "rest", None, int((raw[:cut] > 32).sum()), *shape(raw[:cut])))
        at += cut

    def run(a: int, b: int) -> None:
        if b > a:
            part = raw[a - begin : b - begin]
            out.append((path, a, b, "seq", None, int((part > 32).sum()), *shape(part)))

    while at < end:
        head = at - begin
        if data[head] != 62:  # ">"
            head = data.find(b"\n>", head) + 1
            if not head:
                run(at, end)
                break
        head += begin
        run(at, head)
        line, to = bytearray(), head
        while b"\n" not in line and to < file.size:
            line += file.read(to, to + 65_536)
            to = head + len(line)
        stop = line.find(b"\n") + 1 or len(line)
        found = re.match(rb">(\S*)", bytes(line[:stop]))
        out.append((path, head, head + stop, "head", found[1].decode("utf-8", "replace"), 0, 0, 0, 0))
        at = head + stop
    return out


@dataclass
class Part(InputPartition):
    ranges: list[tuple[str, int, int]]  # path, begin, end; each is cut into stretches by itself


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.stretch, self.split = options["path"], int(options["stretch"]), int(options["splitsize"])

    def partitions(self) -> list[Part]:
        ranges = [(path, a, min(a + self.split, size)) for path, size in files_of(self.path) for a in range(0, size, self.split)]
        each = min(-(-len(ranges) // PARTS), max(1, SPLIT // self.split))  # small splits go to a task together
        return [Part(ranges[i : i + each]) for i in range(0, len(ranges), each)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        file, held = None, []
        for path, begin, end in partition.ranges:
            file = file if file and file.path == path else Bytes(path)
            for a in range(begin, end, self.stretch):
                held += pieces_of(file, path, a, min(a + self.stretch, end))
                if len(held) >= ROWS:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


class FastaPieces(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_pieces"

    def schema(self) -> str:
        return PIECES

    def reader(self, schema) -> FastaReader:
        return FastaReader(dict(self.options))


@dataclass(frozen=True)
class IndexedGenome:
    """chromosomes: chrom_idx (in file order), chrom, seq_len. segments: chrom_idx, file, begin, end (bytes), first_base, bases, lead, line, width."""

    chromosomes: DataFrame
    segments: DataFrame

    def tiles(self, size: int, overlap: int) -> DataFrame:
        """(chrom_idx, tile, part, seq_len): pieces of ``size`` bases, each followed by the next ``overlap``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def given(held: list[tuple]) -> pa.RecordBatch:
                columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                return pa.RecordBatch.from_arrays(columns, names=["chrom_idx", "tile", "at", "piece"])

            file, held, bases = None, [], 0
            for batch in batches:
                for r in batch.to_pylist():
                    file = file if file and file.path == r["file"] else Bytes(r["file"])
                    text, a = letters(file.read(r["begin"], r["end"])), r["first_base"]
                    for t in range(max(0, -(-(a - size - overlap + 1) // size)), (a + len(text) - 1) // size + 1):
                        x = max(t * size - a, 0)
                        held.append((r["chrom_idx"], t, a + x, text[x : t * size + size + overlap - a]))
                    bases += len(text)
                    if bases >= HELD or len(held) >= 10 * ROWS:
                        yield given(held)
                        held, bases = [], 0
            if held:
                yield given(held)

        cut = self.segments.where("bases > 0").mapInArrow(run, "chrom_idx long, tile long, at long, piece string").where("piece <> ''")
        whole = cut.groupBy("chrom_idx", "tile").agg(_joined("at", "piece").alias("part"))  # as many as a tile has segments
        # a tile that only repeats the end of the one before holds no base of its own
        return whole.join(self.chromosomes.select("chrom_idx", "seq_len"), "chrom_idx").where(F.col("tile") * size < F.col("seq_len")).select("chrom_idx", "tile", "part", "seq_len")

    def fetch(self, places: DataFrame, key: list[str]) -> DataFrame:
        """``key`` and seq of places (chrom_idx, start, stop; from 0, stop exclusive, clipped to the chromosome), read by byte range; ``key`` tells places apart. Empty places go."""
        segments = self.segments.where("bases > 0").withColumn("last", F.col("first_base") + F.col("bases"))
        segments = segments.select("*", F.explode(F.sequence(F.floor(F.col("first_base") / BIN), F.floor((F.col("last") - 1) / BIN))).alias("bin"))
        asked = places.select(*key, F.col("chrom_idx").alias("of"), F.greatest("start", F.lit(0)).cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).where("stop > start")
        asked = asked.select("*", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("stop") - 1) / BIN))).alias("at_bin"))
        met = asked.join(segments, (F.col("of") == F.col("chrom_idx")) & (F.col("at_bin") == F.col("bin")) & (F.col("start") < F.col("last")) & (F.col("stop") > F.col("first_base")))
        # a pair of long ones meets in several bins, and counts in the first
        met = met.where(F.col("bin") == F.floor(F.greatest("start", "first_base") / BIN))
        kept = met.select(*key, "file", "begin", "end", "first_base", "lead", "line", "width", F.greatest("start", "first_base").alias("from"), F.least("stop", "last").alias("to"))
        needed = kept.columns[len(key) :]
        schema = kept.select(*key, F.col("from").alias("at"), F.lit("").alias("piece")).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files: dict[str, Bytes] = {}
            for batch in batches:
                out = []
                for r in batch.select(needed).to_pylist():
                    if r["file"] not in files:
                        files = {r["file"]: Bytes(r["file"])}
                    file = files[r["file"]]
                    a, b = r["from"] - r["first_base"], r["to"] - r["first_base"]
                    if r["width"]:
                        x, y = byte_of(a, r["lead"], r["line"], r["width"]), byte_of(b - 1, r["lead"], r["line"], r["width"]) + 1
                        out.append(letters(file.read(r["begin"] + x, r["begin"] + y)))
                    else:
                        out.append(letters(file.read(r["begin"], r["end"]))[a:b])
                yield pa.RecordBatch.from_arrays([*[batch[k] for k in key], batch["from"], pa.array(out, pa.string())], names=[f.name for f in schema])

        return kept.mapInArrow(run, schema).groupBy(*key).agg(_joined("at", "piece").alias("seq"))


def byte_of(base: int, lead: int, line: int, width: int) -> int:
    """Where a base of a segment stands, in bytes from its begin."""
    return base if base < lead else lead + (width - line) + (base - lead) // line * width + (base - lead) % line


def _joined(at: str, piece: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, piece))), lambda x: x[piece]), "")


def index_fasta(spark: SparkSession, path: str, stretch: int = STRETCH, split: int = SPLIT) -> IndexedGenome:
    """The index of a FASTA file, or of all files of a folder, stored in the shared scratch folder."""
    spark.dataSource.register(FastaPieces)
    pieces = spark.read.format("fasta_pieces").option("path", path).option("stretch", stretch).option("splitsize", split).load()
    before = Window.partitionBy("file").orderBy("begin", "end")
    heads = F.when(F.col("kind") == "head", 1).otherwise(0)
    known = pieces.withColumn("number", F.sum(heads).over(before)).withColumn("head_end", F.max(F.when(F.col("kind") == "head", F.col("end"))).over(before))
    # the rest of a header is no sequence, and neither is what comes before the first header
    known = known.where((F.col("number") > 0) & ~((F.col("kind") == "rest") & (F.col("begin") < F.col("head_end"))))
    own = Window.partitionBy("file", "number").orderBy("begin", "end")
    known = stored(known.withColumn("first_base", F.sum("bases").over(own) - F.col("bases")))
    named = known.where("kind = 'head'").select("file", "number", F.col("name").alias("chrom"))
    sizes = known.groupBy("file", "number").agg(F.sum("bases").alias("seq_len"))
    ordered = stored(named.join(sizes, ["file", "number"]).orderBy("file", "number"))
    chromosomes = stored(ordered.select(F.monotonically_increasing_id().alias("chrom_idx"), "chrom", "seq_len", "file", "number"))
    lines = known.where("kind <> 'head'").join(chromosomes.select("chrom_idx", "file", "number"), ["file", "number"])
    segments = stored(lines.select("chrom_idx", "file", "begin", "end", "first_base", "bases", "lead", "line", "width"))
    return IndexedGenome(chromosomes.select("chrom_idx", "chrom", "seq_len"), segments)
