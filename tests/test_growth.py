"""Work and memory that must not grow with copies, headers or repeated reading."""

import random
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqlattice.operators import em, evaluate, seed_index, seeding, tiles
from seqlattice.operators.kernels import Lattice, expected_counts, forward
from seqlattice.plans import queries_sim, realign
from seqlattice.sources import bam, fasta

append = evaluate.append_report


def test_copies_of_a_pair_are_aligned_once():
    hits = [{"locus": x} for x in ("ACGTACGTACGTACGT", "ACGTACGTACGTACGT", "ACGTACGTACGTACGA")]
    pairs, which = em._pairs(["ACGTACGTACGT"] * 3, hits)
    assert len(pairs) == 2 and which.tolist() == [0, 0, 1]
    assert sum(len(rows) for rows in em._shapes(pairs)) == 2


def test_tables_of_a_pair_are_as_large_as_said_and_some_pairs_count_alone():
    rng = np.random.default_rng(4)
    T = np.log(em.initial_model())
    lattice = Lattice(rng.integers(0, 4, (6, 30)), rng.integers(0, 4, (6, 40)))
    score, f = forward(lattice, T)
    assert f.table.nbytes <= 6 * em.CELL_BYTES * 33 * 73
    weights = np.array([1.0, 0.0, 0.5, 0.0, 0.0, 0.0])
    some = np.flatnonzero(weights)
    alone = expected_counts(*[(x, T, y) for x, y in [em._some(lattice, f, some)]][0], score[some], weights[some])
    assert np.allclose(alone, expected_counts(lattice, T, f, score, weights), rtol=1e-12)


def test_scores_alone_hold_three_anti_diagonals_however_long_a_pair_is():
    rng = np.random.default_rng(5)
    T = np.log(em.initial_model())
    for n, m in ((11, 11), (30, 41), (300, 290)):
        lattice = Lattice(rng.integers(0, 4, (3, n)), rng.integers(0, 5, (3, m)))
        score, f = forward(lattice, T, keep=False)
        assert f.table.nbytes == 3 * 3 * (n + 3) * 3 * 8
        assert score.tolist() == forward(lattice, T)[0].tolist()


def test_rows_of_large_batches_are_made_as_they_are_asked_for():
    held, old = [], []

    def batches():
        for _ in range(3):
            old.extend(r() for r in held)
            batch = pa.RecordBatch.from_pydict({"text": pa.array([b"A" * (1 << 16)] * 100, pa.binary())})
            held.append(weakref.ref(batch))
            yield batch
            del batch

    tracemalloc.start()
    assert sum(len(r["text"]) for r in seed_index.rows_of(batches())) == 300 << 16
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 16 and old == [None] * 3


def _counted_genome(spark, chromosomes):
    """A genome of 200 bases a chromosome, and how many chromosomes' sequences have been made of it."""
    made = spark.sparkContext.accumulator(0)

    def bases(i):
        made.add(1)
        return "".join(random.Random(i).choices("ACGT", k=200))

    ids = spark.range(chromosomes).withColumnRenamed("id", "chrom_idx")
    return ids.select("chrom_idx", F.udf(bases, "string")("chrom_idx").alias("seq")).select("*", F.length("seq").alias("seq_len")), made


def test_an_index_makes_its_genome_once(spark):
    genome, made = _counted_genome(spark, 40)
    regions = seed_index.packed(genome, 64, 60).collect()
    assert sum(len(r.start) // 8 for r in regions) == 40 and made.value == 40


def test_hits_are_located_in_the_chromosomes_that_they_name(spark):
    genome, made = _counted_genome(spark, 40)
    hits = spark.createDataFrame([(1, 0, 7, 20, 50, "+", 2), (1, 1, 31, 0, 30, "-", 2), (2, 0, 7, 20, 50, "+", 1)], "read_id long, hit_idx int, chrom_idx long, start long, stop long, strand string, num_hits long")
    got = {(r.read_id, r.hit_idx): r for r in realign.locate(genome, hits).collect()}
    assert made.value == 2
    whole = genome.where("chrom_idx = 7").first().seq
    assert len(got) == 3 and got[2, 0].locus == whole[15:55] and got[2, 0].depth == 1.5 and len(got[1, 1].locus) == 35
    assert tiles.named_only(genome, hits, 1) is genome


def test_splits_of_bam_follow_its_records_not_its_header(spark, tmp_path):
    chromosomes = spark.range(20_000).selectExpr("id AS chrom_idx", "concat('chromosome', id) AS chrom", "100 + id AS seq_len")
    records = spark.range(300).selectExpr("concat('r', id) AS name", "0 AS flag", "concat('chromosome', id * 7) AS chrom", "id + 1 AS pos", "9 AS mapq", "'4M' AS cigar", "'ACGT' AS seq", "'*' AS qual", "1 AS nm", "cast(null AS string) AS xa")
    path = str(tmp_path / "bam")
    bam.write_bam(records.coalesce(1), chromosomes, path, block=3_000)
    (file,) = tmp_path.glob("bam/*.bam")
    reader = bam.BamReader({"path": path, "split": "2000"})
    parts = reader.partitions()
    assert 1 < len(parts) < 15 < file.stat().st_size / 2_000
    assert [p.begin for p in parts[1:]] == [p.end for p in parts[:-1]] and parts[0].begin == 0 and parts[-1].end == file.stat().st_size
    back = bam.read_bam(spark, path, 2_000)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, records.collect()))


def test_small_splits_of_fasta_share_tasks_and_batches(spark, tmp_path):
    text = "".join(f">c{i}\n" + "ACGTA\n" * 40 for i in range(400))
    (tmp_path / "g.fa").write_text(text)
    reader = fasta.FastaReader({"path": str(tmp_path / "g.fa"), "stretch": "50", "splitsize": "100"})
    parts = reader.partitions()
    assert len(parts) <= fasta.PARTS and sum(len(p.ranges) for p in parts) == -(-len(text) // 100)
    assert sum(len(list(reader.read(p))) for p in parts) == len(parts)
    tiles = fasta.index_fasta(spark, str(tmp_path / "g.fa"), 50, 100).tiles(30, 5).collect()
    whole = "ACGTA" * 40
    assert sorted((r.chrom_idx, r.tile, r.part) for r in tiles) == [(c, t, whole[30 * t : 30 * t + 35]) for c in range(400) for t in range(7)]


def test_a_report_is_judged_once_however_often_it_is_appended(spark, small, monkeypatch):
    rows = []
    monkeypatch.setattr(evaluate, "append_report", lambda row, path: (rows.append(row), append(row, path)))
    assert queries_sim.eval_report(spark, small).count() == 2
    assert len(rows) == 2 and not any("documents" in f for r in rows for f in r.inputFiles())


def test_many_windows_are_compared_as_single_ones_and_equal_ones_once(spark, monkeypatch):
    r = random.Random(8)
    reads = ["".join(r.choices("ACGT", k=r.randint(12, 73))) for _ in range(20)]
    pairs = [(p, "".join(x for x in p if r.random() > 0.1)[: r.choice((0, 9, 99))] + "ACGTACG"[: r.randint(0, 7)]) for p in reads for _ in range(6)] * 3
    want = seeding.best_matches([p for p, _ in pairs], [t for _, t in pairs])
    monkeypatch.setattr(seeding, "best_matches", None)  # the letter-by-letter way is for other letters only
    got = seeding._matches(*zip(*pairs, strict=True))
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_groups_that_end_within_a_read_make_no_links(spark, monkeypatch):
    hits = spark.createDataFrame([(1, "+", c, p) for c in range(50) for p in ((5, 9) if c else (5, 9, 30, 60))], "read_id long, strand string, chrom_idx long, pos int")
    reads = spark.createDataFrame([(1, "A" * 20)], "read_id long, seq string")
    linked, links = [], seeding.admissible_links
    monkeypatch.setattr(seeding, "admissible_links", lambda ends, keys: (linked.append(ends.count()), links(ends, keys))[1])
    got = sorted((r.chrom_idx, r.end) for r in seeding.suppressed(hits, reads, 12).collect())
    assert got == sorted([(c, 16) for c in range(50)] + [(0, 41), (0, 71)]) and linked == [4]


def test_reads_that_the_model_sees_as_equal_are_one_row_of_training(spark):
    rng = random.Random(21)
    read = lambda: "".join(rng.choices("ACGT", k=20))
    hit = lambda i, s: (i, i, 5, 25, "+", 0, "GTACC" + s + "ACGTT", 0, 0, -40.0, 0.5, 1.0)
    own = [read() for _ in range(6)]
    rows = [(i, f"r{i}", own[i % 6], -28.0, [hit(0, own[i % 6]), hit(1 + i % 2, read() if i == 29 else own[(i + 1) % 6])]) for i in range(30)]
    df = spark.createDataFrame(rows, f"read_id long, name string, seq string, r_score double, hits array<{em.HIT}>")
    pooled = em.pooled(df)
    assert sorted(r.copies for r in pooled.collect()) == [1.0, 4.0, 5.0, 5.0, 5.0, 5.0, 5.0]
    summed = [{r.code: r["count"] for r in em.expectation(x, em.initial_model(), False).collect()} for x in (df, pooled)]
    assert summed[0].keys() == summed[1].keys() and all(np.isclose(v, summed[1][k], rtol=1e-9) for k, v in summed[0].items())


def test_only_the_chosen_hits_are_aligned(spark):
    rng = random.Random(22)
    own = ["".join(rng.choices("ACGT", k=20)) for _ in range(4)]
    hits = [[(j, j, 5, 25, "+", 0, "GTACC" + own[(i + j) % 4] + "ACGTT", 0, 0, -40.0, 0.5, 1.0) for j in range(3)] for i in range(4)]
    df = spark.createDataFrame([(i, f"r{i}", s, -28.0, h) for i, (s, h) in enumerate(zip(own, hits, strict=True))], f"read_id long, name string, seq string, r_score double, hits array<{em.HIT}>")
    best = spark.createDataFrame([(0, 0), (2, 1), (3, 2)], "read_id long, hit_idx int")
    got = {(r.read_id, r.hit_idx): (r.v_score, r.path) for r in em.best_paths(spark, df, best, em.initial_model()).collect()}
    want = {(r.read_id, r.hit_idx): (r.v_score, r.path) for r in em.score_hits(spark, df, em.initial_model(), paths=True).collect()}
    assert got == {k: want[k] for k in ((0, 0), (2, 1), (3, 2))}
