import random

import pytest

from seqlattice.plans import realign
from seqlattice.sources import bam, formats


def rows(n, seed=1, longest=200):
    rnd, out = random.Random(seed), []
    for i in range(n):
        k = rnd.choice((0, 1, 2, 30, 31, rnd.randint(3, longest)))
        seq = "".join(rnd.choices("ACGTN", k=k))
        mapped = k > 2 and rnd.random() < 0.8
        cigar = f"{k}M" if rnd.random() < 0.5 else f"1S{k - 2}M2D1I3N" if k > 2 else "*"
        qual = "".join(chr(rnd.randint(33, 93)) for _ in range(k)) if k and rnd.random() < 0.7 else "*"
        xa = "".join(f"chr_{j % 3},{rnd.choice('+-')}{j + 5},{k}M,{j};" for j in range(rnd.randint(1, 9))) if rnd.random() < 0.5 else None
        out.append((f"read.{i}", rnd.choice((0, 16, 256)) if mapped else 4, f"chr_{i % 3}" if mapped else "*", rnd.randint(1, 1 << 28) if mapped else 0, rnd.randint(0, 255) if mapped else 0, cigar if mapped else "*", seq or "*", qual, rnd.choice((None, 0, 300)), xa))
    return out


CHROMOSOMES = [(i, f"chr_{i}", "", 1 << 29) for i in range(3)]


def chromosomes(spark):
    return spark.createDataFrame(CHROMOSOMES, "chrom_idx long, chrom string, seq string, seq_len int")


@pytest.mark.parametrize("block,split", [(65_280, 1 << 25), (700, 5_000), (97, 1_000), (65_280, 999)])
def test_a_file_in_splits_is_its_sam_twin(spark, tmp_path, block, split):
    want = rows(800 if block < 65_280 else 3_000)
    df = spark.createDataFrame(want, bam.FIELDS)
    bam.write_bam(df.coalesce(1), chromosomes(spark), str(tmp_path / "b"), block=block)
    (tmp_path / "t.sam").write_text("@HD\tVN:1.6\n" + "".join("\t".join([*map(str, r[:6]), "*", "0", "0", r[6], r[7]] + ([f"NM:i:{r[8]}"] if r[8] is not None else []) + ([f"XA:Z:{r[9]}"] if r[9] else [])) + "\n" for r in want))
    got = bam.read_bam(spark, str(tmp_path / "b"), split)
    assert split > 1 << 24 or got.rdd.getNumPartitions() > 5
    assert [tuple(r) for r in got.collect()] == want
    assert sorted(map(tuple, formats.read_sam(spark, str(tmp_path / "t.sam")).collect()), key=str) == sorted(want, key=str)
    assert formats.sam_hits(got).count() == formats.sam_hits(formats.read_sam(spark, str(tmp_path / "t.sam"))).count()


def test_records_longer_than_members_and_splits(spark, tmp_path):
    want = [r for r in rows(40, 4, 30_000) if len(r[6]) > 5] + rows(30, 5)
    bam.write_bam(spark.createDataFrame(want, bam.FIELDS).coalesce(1), chromosomes(spark), str(tmp_path / "b"), block=1_500)
    assert [tuple(r) for r in bam.read_bam(spark, str(tmp_path / "b"), 4_000).collect()] == want


def test_folders_empty_files_and_others(spark, tmp_path):
    df = spark.createDataFrame(rows(200), bam.FIELDS).repartition(4)
    bam.write_bam(df, chromosomes(spark), str(tmp_path / "b"))
    (tmp_path / "b" / "notes.txt").write_text("none")
    assert bam.read_bam(spark, str(tmp_path / "b")).count() == 200
    bam.write_bam(df.where("false").coalesce(1), chromosomes(spark).where("false"), str(tmp_path / "e"))
    assert bam.read_bam(spark, str(tmp_path / "e")).count() == 0
    (tmp_path / "x.bam").write_bytes(bam.packed_member(b"something else"))
    with pytest.raises(Exception, match="not a BAM file"):
        bam.read_bam(spark, str(tmp_path / "x.bam")).collect()
    with pytest.raises(Exception, match="(?i)not ?found|no such"):
        bam.read_bam(spark, str(tmp_path / "none.bam")).collect()


def test_tags_of_all_kinds():
    import struct

    data = b"XXAqABc\xffACC\xfeADs\x01\x00AES\x01\x00AFi\x01\0\0\0AGI\x01\0\0\0AHf\0\0\0\0AZZtext\0AYH0A\0ABBs" + struct.pack("<ihh", 2, 1, 2) + b"NMC\x07XAZa,+1,3M,0;\0"
    assert bam._tags(data, 0, len(data)) == (7, "a,+1,3M,0;")
    assert bam._tags(b"NMs\x2c\x01", 0, 5) == (300, None) and bam._tags(b"", 0, 0) == (None, None)


def test_programs_read_bam(spark, tmp_path):
    placed = [(f"ORG{i}_chr_1_{i}_{i + 30}_+_0", 0, "chr_1", i + 1, 30, "30M", "A" * 30, "*", 0, None) for i in range(50)]
    bam.write_bam(spark.createDataFrame(placed, bam.FIELDS), chromosomes(spark), str(tmp_path / "p.bam"))
    total = realign.evaluate_files(spark, str(tmp_path / "p.bam"))["summary"].first()
    assert (total.total, total.mapped, total.percent_wrong) == (50, 50, 0.0)
