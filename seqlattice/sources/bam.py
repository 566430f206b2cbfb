"""BAM files, read in splits and written part by part.

A BAM file is a chain of gzip members of at most 64 KiB that tell their size
(BGZF). A split begins at the first member after its start that a chain of
members follows, and at the first record in there that looks like one and is
followed by others that do; records that begin before the split's end belong
to it. Fields are cut out of all records of a stretch together.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import stored
from .ranges import Bytes, files_of, opened

SPLIT = 32 << 20
STRETCH = 4 << 20  # bytes of records decoded at once, and one record more
LIKELY = 8  # records in a row that must look like records
FIELDS = "name string, flag int, chrom string, pos long, mapq int, cigar string, seq string, qual string, nm int, xa string"
# The format's letters of bases by half byte, and of CIGAR operations by number.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_PAIR = np.array([[ord(BASES[b >> 4]), ord(BASES[b & 15])] for b in range(256)], np.uint8)
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_UNPACK = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}


def member_size(head: bytes, at: int = 0) -> int:
    """The size of the member that begins at ``at``, 0 if there is none."""
    if len(head) < at + 18 or head[at : at + 4] != b"\x1f\x8b\x08\x04":
        return 0
    extra = struct.unpack_from("<H", head, at + 10)[0]
    field, end = at + 12, at + 12 + extra
    while field + 6 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, field + 2)[0]
        if head[field : field + 2] == b"BC" and size == 2:
            return struct.unpack_from("<H", head, field + 4)[0] + 1
        field += 4 + size
    return 0


def first_member(file: Bytes, start: int) -> int:
    """Where the first member at or after ``start`` begins, which others follow up to the third or the file's end; the file's size if there is none."""
    begin = start
    while begin < file.size:
        data = file.read(begin, begin + (1 << 18))
        at = data.find(b"\x1f\x8b\x08\x04")
        while at >= 0:
            here = begin + at
            for _ in range(3):
                size = member_size(file.read(here, here + 64)) if here < file.size else -1
                if size <= 0:
                    break
                here += size
            if size != 0 and here <= file.size:
                return begin + at
            at = data.find(b"\x1f\x8b\x08\x04", at + 1)
        begin += len(data) - 3 if begin + len(data) < file.size else len(data)
    return file.size


class Members:
    """The unpacked bytes of members in a row, from the one at ``begin``; ``starts`` tells where each member begins in them."""

    def __init__(self, file: Bytes, begin: int):
        self.file, self.next, self.data, self.starts = file, begin, bytearray(), []

    def more(self, least: int = 1) -> bool:
        """Unpacks on, by ``least`` bytes at least; false at the end of the file."""
        want = len(self.data) + least
        while len(self.data) < want:
            head = self.file.read(self.next, self.next + 65_536 + 64)
            size = member_size(head)
            if not size:
                return False
            self.starts.append((len(self.data), self.next))
            self.data += zlib.decompress(head[:size], 31)
            self.next += size
        return True

    def need(self, end: int) -> bool:
        return len(self.data) >= end or self.more(end - len(self.data))

    def drop(self, upto: int) -> None:
        """Forgets the bytes before ``upto``."""
        del self.data[:upto]
        self.starts = [(a - upto, m) for a, m in self.starts]
        last = max((i for i, (a, _) in enumerate(self.starts) if a <= 0), default=0)
        self.starts = self.starts[last:]

    def member_of(self, at: int) -> int:
        """Where in the file the member of a byte begins."""
        return max(m for a, m in self.starts if a <= at)


def read_header(file: Bytes) -> tuple[list[str], list[int], int, int]:
    """Names and lengths of the chromosomes; the member and the byte in it where records begin."""
    m = Members(file, 0)
    m.need(8)
    if bytes(m.data[:4]) != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", m.data, 4)[0]
    m.need(at + 4)
    names, lengths, (count,) = [], [], struct.unpack_from("<i", m.data, at)
    at += 4
    for _ in range(count):
        m.need(at + 4)
        size = struct.unpack_from("<i", m.data, at)[0]
        m.need(at + 8 + size)
        names.append(bytes(m.data[at + 4 : at + 3 + size]).decode())
        lengths.append(struct.unpack_from("<i", m.data, at + 4 + size)[0])
        at += 8 + size
    if at == len(m.data):
        return names, lengths, m.next, 0
    member = m.member_of(at)
    return names, lengths, member, at - max(a for a, b in m.starts if b == member)


def header_end(file: Bytes) -> int:
    """A member's begin at or after that of the first record, or the file's size: how far the header reaches, of which no more than a few members are held."""
    m = Members(file, 0)
    m.need(8)
    if bytes(m.data[:4]) != b"BAM\1":
        raise ValueError("not a BAM file")
    at, left = 8 + struct.unpack_from("<i", m.data, 4)[0], None
    while left != 0:
        if at > 1 << 18:
            gone = min(at, len(m.data))
            m.drop(gone)
            at -= gone
        if not m.need(at + 4):
            raise ValueError("the header is cut off")
        if left is None:
            left, size = struct.unpack_from("<i", m.data, at)[0], 4
        else:
            left, size = left - 1, 8 + struct.unpack_from("<i", m.data, at)[0]
        at += size
    return m.next


def looks_like_record(m: Members, at: int, chromosomes: int) -> int:
    """The end of the record at ``at`` if it looks like one, else 0."""
    if not m.need(at + 36):
        return 0
    size, ref, pos, l_name, _, _, n_cigar, flag, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", m.data, at)
    if not (-1 <= ref < chromosomes and -1 <= next_ref < chromosomes and pos >= -1 and next_pos >= -1 and l_name >= 2 and l_seq >= 0 and flag < 4096):
        return 0
    least = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not least <= size < least + (1 << 24) or not m.need(at + 36 + l_name + 4 * n_cigar):
        return 0
    name = m.data[at + 36 : at + 36 + l_name]
    if name[-1] or any(not 33 <= c <= 126 for c in name[:-1]) or any(c & 15 > 8 for c in m.data[at + 36 + l_name : at + 36 + l_name + 4 * n_cigar : 4]):
        return 0
    return at + 4 + size


def first_record(m: Members, chromosomes: int, end: int) -> int | None:
    """Where the first record begins, in a member before ``end``; None if there is none."""
    at = 0
    while m.need(at + 1) and m.member_of(at) < end:
        here = at
        for _ in range(LIKELY):
            here = looks_like_record(m, here, chromosomes)
            if not here or not m.need(here + 1):
                break
        if here:
            return at
        at += 1
    return None


def _strings(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Spans of bytes as strings."""
    ends = np.cumsum(size)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(np.append(0, ends).astype("<i4").tobytes()), pa.py_buffer(data[index].tobytes())])


def _tags(data: bytes, at: int, end: int) -> tuple[int | None, str | None]:
    """The numbers of NM and the text of XA among a record's tags."""
    nm = xa = None
    while at + 3 <= end:
        tag, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            to = data.index(b"\0", at)
            if tag == b"XA":
                xa = data[at:to].decode()
            at = to + 1
        elif kind == "B":
            at += 5 + _SIZES[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            if tag == b"NM" and kind in _UNPACK:
                nm = struct.unpack_from(_UNPACK[kind], data, at)[0]
            at += _SIZES[kind]
    return nm, xa


def decoded(data: bytes, at: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """FIELDS of the records that begin at ``at``."""
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    word = lambda off: np.ndarray((len(raw) - 7,), "<i4", raw, strides=(1,))[at + off].astype(np.int64)
    half = lambda off: word(off) & 0xFFFF
    l_name, mapq, n_cigar, flag, l_seq = word(12) & 0xFF, (word(12) >> 8) & 0xFF, half(16), half(18), word(20)
    name = at + 36
    cigar = name + l_name
    seq = cigar + 4 * n_cigar
    qual = seq + (l_seq + 1) // 2
    tags, end = qual + l_seq, at + 4 + word(0)
    ops = np.ndarray((len(raw) - 7,), "<u4", raw, strides=(1,))
    cigars = ["".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops[c : c + 4 * n : 4].tolist()) or "*" for c, n in zip(cigar.tolist(), n_cigar.tolist(), strict=True)]
    packed = (l_seq + 1) // 2
    starts = np.append(0, np.cumsum(packed))
    bases = _PAIR[raw[np.arange(starts[-1]) + np.repeat(seq - starts[:-1], packed)]].ravel()
    seqs = _strings(bases, 2 * starts[:-1], l_seq)
    scores = (raw + np.uint8(33)).view(np.uint8)
    quals = _strings(scores, qual, l_seq)
    none = (l_seq == 0) | (raw[np.minimum(qual, len(raw) - 1)] == 255)
    star = lambda x, where: pc.if_else(pa.array(where), "*", x)
    found = [_tags(data, a, b) for a, b in zip(tags.tolist(), end.tolist(), strict=True)]
    chroms = np.array([*names, "*"], object)[word(4)]
    columns = [
        _strings(raw, name, l_name - 1), pa.array(flag.astype(np.int32)), pa.array(chroms, pa.string()), pa.array(word(8) + 1), pa.array(mapq.astype(np.int32)), pa.array(cigars, pa.string()),
        star(seqs, l_seq == 0), star(quals, none), pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FIELDS.split(", ")])


@dataclass
class Split(InputPartition):
    path: str
    begin: int
    end: int


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[Split]:
        return [s for path, size in files_of(self.path, ".bam") for s in self.splits(path, size)]

    def splits(self, path: str, size: int) -> list[Split]:
        """One from the file's begin, which takes the header with it, and others from where its records begin: a header of any length is read by those only that have records."""
        if size <= self.split:
            return [Split(path, 0, size)]
        records = header_end(Bytes(path))
        cuts = [0, *range(records + self.split, size, self.split), size]
        return [Split(path, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        file = Bytes(partition.path)
        names, _, member, inside = read_header(file)
        begin = member
        if partition.begin > member:
            begin, inside = first_member(file, partition.begin), None
        elif partition.end <= member:
            return
        if begin >= min(partition.end, file.size):
            return
        m = Members(file, begin)
        at = first_record(m, len(names), partition.end) if inside is None else inside
        while at is not None:
            found, here = [], at
            while here - at < STRETCH and m.need(here + 4) and m.member_of(here) < partition.end:
                to = here + 4 + struct.unpack_from("<i", m.data, here)[0]
                if not m.need(to):
                    raise ValueError(f"{partition.path} ends inside a record")
                found.append(here)
                here = to
            if found:
                yield decoded(bytes(m.data[:here]), np.array(found), names)
            if here - at < STRETCH:
                return
            m.drop(here)
            at = 0


def packed_member(data: bytes) -> bytes:
    """One BGZF member of at most 65,280 bytes of data."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def packed_header(names: list[str], lengths: list[int], order: str) -> bytes:
    text = (f"@HD\tVN:1.6\tSO:{order}\n" + "".join(f"@SQ\tSN:{n}\tLN:{x}\n" for n, x in zip(names, lengths, strict=True))).encode()
    parts = [b"BAM\1", struct.pack("<i", len(text)), text, struct.pack("<i", len(names))]
    for n, x in zip(names, lengths, strict=True):
        parts.append(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", x))
    return b"".join(parts)


def bin_of(begin: int, end: int) -> int:
    """The smallest bin of the usual hierarchy (16 KiB up to 64 MiB) that holds [begin, end)."""
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == (end - 1) >> shift:
            return first + (begin >> shift)
    return 0


def packed_record(r: dict, number: dict[str, int]) -> bytes:
    name = r["name"].encode() + b"\0"
    ops = [] if r["cigar"] in (None, "*") else re.findall(r"(\d+)([MIDNSHP=X])", r["cigar"])
    seq, qual = ("" if x in (None, "*") else x for x in (r["seq"], r["qual"]))
    codes = [max(0, BASES.find(c)) if c in BASES else 15 for c in seq] + [0] * (len(seq) % 2)
    pos = (r["pos"] or 0) - 1
    width = sum(int(n) for n, o in ops if o in "MDN=X") or 1
    tags = (b"" if r["nm"] is None else b"NMi" + struct.pack("<i", r["nm"])) + (b"" if r["xa"] is None else b"XAZ" + r["xa"].encode() + b"\0")
    body = struct.pack("<iiBBHHHiiii", number.get(r["chrom"], -1), pos, len(name), r["mapq"], bin_of(max(pos, 0), max(pos, 0) + width), len(ops), r["flag"], len(seq), -1, -1, 0)
    body += name + b"".join(struct.pack("<I", int(n) << 4 | OPERATIONS.index(o)) for n, o in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    body += bytes(ord(c) - 33 for c in qual) if len(qual) == len(seq) and qual else b"\xff" * len(seq)
    body += tags
    return struct.pack("<i", len(body)) + body


class BamWriter(DataSourceArrowWriter):
    """A task's records as one BAM file; its name is told to the driver, which drops files of failed attempts."""

    def __init__(self, options: dict):
        self.path, self.names, self.lengths = options["path"], options["names"].split("\t") if options["names"] else [], [int(x) for x in options["lengths"].split()]
        self.block, self.order = int(options.get("block", 65_280)), options.get("order", "unsorted")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        at = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.bam"
        number = {n: i for i, n in enumerate(self.names)}
        with system.open_output_stream(at) as out:
            held = bytearray(packed_header(self.names, self.lengths, self.order))
            for batch in batches:
                for r in batch.to_pylist():
                    held += packed_record(r, number)
                    while len(held) >= self.block:
                        out.write(packed_member(bytes(held[: self.block])))
                        del held[: self.block]
            if held:
                out.write(packed_member(bytes(held)))
            out.write(packed_member(b""))
        return Written(at)

    def abort(self, messages: list) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.at)


@dataclass
class Written(WriterCommitMessage):
    at: str


class Bam(DataSource):
    """Format ``bam``: options path, split (bytes), and for writing names, lengths, order and block."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(dict(self.options))


def read_bam(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The records of a BAM file, or of a folder's files that end in .bam, with the fields of read_sam()."""
    spark.dataSource.register(Bam)
    return spark.read.format("bam").option("path", path).option("split", split).load()


def write_bam(records: DataFrame, chromosomes: DataFrame, path: str, order: str = "unsorted", block: int = 65_280) -> None:
    """Records (the fields of read_sam()) as BAM files under ``path``, one a partition, each with the header of all chromosomes (chrom_idx, chrom, seq_len)."""
    records.sparkSession.dataSource.register(Bam)
    listed = stored(chromosomes.select("chrom_idx", "chrom", F.col("seq_len").cast("long").alias("n")))  # worked out once; to sort it takes two passes
    rows = [(r.chrom, str(r.n)) for r in listed.orderBy("chrom_idx").toLocalIterator()]  # a header holds all chromosomes
    names, lengths = [n for n, _ in rows], [x for _, x in rows]
    fields = [x.split()[0] for x in FIELDS.split(", ")]
    how = {"path": path, "names": "\t".join(names), "lengths": " ".join(lengths), "order": order, "block": block}
    records.select(*fields).write.format("bam").options(**how).mode("append").save()
