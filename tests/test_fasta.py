import random

import pytest
from pyspark.sql import functions as F

from seqlattice.plans import realign
from seqlattice.sources import fasta, formats


def write(folder, seed, ends="\n", ragged=False):
    """A FASTA file with odd headers, empty chromosomes and many line lengths; gives its sequences."""
    rnd, out, text = random.Random(seed), [], "; no header yet\n" if seed % 2 else ""
    for i in range(14):
        seq = "".join(rnd.choices("ACGTacgtuNx", k=rnd.choice((0, 1, 5, 60, 61, 400, 3_000))))
        width = rnd.choice((7, 60, 5_000))
        text += f">chr{i}{rnd.choice(['', ' a->b > c', ' ' + 'w' * 300])}{ends}"
        at = 0
        while at < len(seq):
            step = rnd.randint(1, 80) if ragged else width
            text += seq[at : at + step] + ends + (ends if ragged and rnd.random() < 0.1 else "")
            at += step
        kept = "".join(c if c in "ACGT" else "N" for c in seq.upper().replace("U", "T"))
        out.append((f"chr{i}", kept))
    path = folder / f"g{seed}.fa"
    path.write_bytes((text.rstrip("\r\n") if seed % 3 else text).encode())
    return str(path), out


@pytest.mark.parametrize("seed,ends,ragged,stretch", [(1, "\n", False, 50), (2, "\r\n", False, 333), (3, "\n", True, 100), (4, "\n", False, 1 << 20), (5, "\n", False, 61)])
def test_tiles_and_lookups_are_those_of_the_sequences(spark, tmp_path, seed, ends, ragged, stretch):
    path, want = write(tmp_path, seed, ends, ragged)
    g = fasta.index_fasta(spark, path, stretch, split=3 * stretch)
    chromosomes = {r.chrom_idx: (r.chrom, r.seq_len) for r in g.chromosomes.orderBy("chrom_idx").collect()}
    assert list(chromosomes.values()) == [(n, len(s)) for n, s in want]
    seqs = dict(zip(chromosomes, (s for _, s in want), strict=True))
    for size, overlap in ((100, 30), (64, 0), (40, 90)):
        got = {(r.chrom_idx, r.tile): (r.part, r.seq_len) for r in g.tiles(size, overlap).collect()}
        assert got == {(c, t): (s[t * size : t * size + size + overlap], len(s)) for c, s in seqs.items() for t in range(-(-len(s) // size))}
    rnd = random.Random(seed)
    places = [(i, c, (a := rnd.randint(-5, len(seqs[c]) + 3)), a + rnd.choice((0, 1, 30, 500))) for i, c in enumerate(rnd.choices(list(seqs), k=120))]
    found = {r.id: r.seq for r in g.fetch(spark.createDataFrame(places, "id long, chrom_idx long, start long, stop long"), ["id"]).collect()}
    assert found == {i: s for i, c, a, b in places if (s := seqs[c][max(0, a) : max(0, b)])}


def test_a_lookup_reads_its_own_bytes(spark, tmp_path, monkeypatch):
    seq = "".join(random.Random(1).choices("ACGT", k=6_000))
    (tmp_path / "g.fa").write_text(">c\n" + "\n".join(seq[i : i + 50] for i in range(0, 6_000, 50)) + "\n")
    rows = fasta.index_fasta(spark, str(tmp_path / "g.fa"), 1_000).segments.collect()
    assert len(rows) == 13 and all(r.width > r.line > 0 for r in rows) and sum(r.bases for r in rows) == 6_000
    for r in rows:
        data = (tmp_path / "g.fa").read_bytes()[r.begin : r.end]
        for x in range(0, r.bases, 37):
            assert chr(data[fasta.byte_of(x, r.lead, r.line, r.width)]) == seq[r.first_base + x]


def test_headers_may_hold_the_mark(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 a->b\nACGT\nAC\n>chr2\nGG\n")
    want = [("chr1", "ACGTAC", 6), ("chr2", "GG", 2)]
    assert sorted(map(tuple, formats.read_fasta(spark, str(tmp_path / "g.fa")).collect())) == want
    g = fasta.index_fasta(spark, str(tmp_path))
    parts = g.tiles(100, 0).join(g.chromosomes.drop("seq_len"), "chrom_idx").select("chrom", "part", F.col("seq_len").cast("int"))
    assert sorted(map(tuple, parts.collect())) == want


def test_the_search_runs_over_byte_ranges(spark, tmp_path):
    rnd = random.Random(2)
    seqs = ["".join(rnd.choices("ACGT", k=n)) for n in (9_000, 300)]
    (tmp_path / "g.fa").write_text("".join(f">c{i} > x\n" + "\n".join(s[j : j + 70] for j in range(0, len(s), 70)) + "\n" for i, s in enumerate(seqs)))
    (tmp_path / "r.fa").write_text("".join(f">r{c}_{at}\n{seqs[c][at : at + 40]}\n" for c, at in ((0, 0), (0, 4_080), (0, 8_960), (1, 100))))
    realign.search_files(spark, str(tmp_path / "g.fa"), str(tmp_path / "r.fa"), str(tmp_path / "out"))
    got = {r.name: (r.chrom, r.pos, r.nm) for r in formats.read_sam(spark, str(tmp_path / "out")).collect()}
    assert got == {"r0_0": ("c0", 1, 0), "r0_4080": ("c0", 4_081, 0), "r0_8960": ("c0", 8_961, 0), "r1_100": ("c1", 101, 0)}
