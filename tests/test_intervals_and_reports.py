"""Interval joins, suppression without lists, whole-read matching, annealing, evaluation over a folder."""

import random

import numpy as np
import pytest
from test_kernels import distance

from seqlattice.operators import em, intervals, posterior, seeding
from seqlattice.plans import realign


def test_overlaps_are_those_of_all_pairs(spark):
    rnd = random.Random(3)
    draw = lambda n, most: [(i, rnd.choice("ab"), (s := rnd.choice((rnd.randrange(1 << 17), rnd.randrange(1 << 31)))), s + rnd.choice((1, 30, 16_384, rnd.randint(1, most)))) for i in range(n)]
    left = [*draw(150, 1 << 20), (900, "a", 0, 1 << 32), (901, "a", 5, 5), (902, None, 1, 9), (903, "a", 16_383, 16_385), (904, "a", -3, 9)]
    right = [*draw(150, 1 << 30), (800, "a", 0, 1 << 40), (801, "b", (1 << 17) - 1, (1 << 17) + 1), (802, "a", None, 4), (803, "a", 16_384, 16_385)]
    schema = "id long, chrom string, start long, stop long"
    for least in (1, 40):
        got = sorted((r.id, r.other_id, r.shared) for r in intervals.overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), least=least).collect())
        usable = lambda x: None not in x and 0 <= x[2] < x[3]
        pairs = [(a[0], b[0], min(a[3], b[3]) - max(a[2], b[2])) for a in left for b in right if usable(a) and usable(b) and a[1] == b[1]]
        assert got == sorted(p for p in pairs if p[2] >= least) and len(got) > 100


def test_suppression_of_a_hot_group_is_the_scan(spark, monkeypatch):
    monkeypatch.setattr(seeding, "CUT", 500)
    rnd = random.Random(4)
    hits = [(1, "+", 0, 7, p) for p in range(4_000)] + [(1, "+", 0, 7, 90_000), (1, "-", 0, 7, 3)] + [(r, "+", 0, rnd.randrange(3), rnd.randrange(3_000)) for r in (2, 3) for _ in range(150)]
    reads = [(1, "A" * 31), (2, "A" * 20), (3, "A" * 700)]
    df = spark.createDataFrame(hits, "read_id long, strand string, offset int, chrom_idx long, pos int").repartition(5)
    got = sorted(tuple(r) for r in seeding.suppressed(df, spark.createDataFrame(reads, "read_id long, seq string")).collect())
    want, upto = [], {}
    for r, s, _, c, p in sorted(set(hits), key=lambda x: x[4]):
        if p + 11 >= upto.get((r, s, c), -1):
            want.append((r, s, c, p + 11))
            upto[r, s, c] = p + 11 + len(reads[r - 1][1])
    assert got == sorted(want)
    assert seeding.suppressed(df.where("false"), spark.createDataFrame(reads, "read_id long, seq string")).count() == 0


@pytest.mark.parametrize("length", [1, 63, 64, 65, 128, 200])
def test_whole_reads_are_matched_word_by_word(length):
    rnd = random.Random(length)
    draw = lambda n: "".join(rnd.choices("ACGT", k=n))
    pairs = []
    for _ in range(6):
        p = draw(length)
        t = draw(rnd.randint(0, 9)) + "".join(rnd.choice(["", x, x, x, x + "G"]) for x in p) + draw(rnd.randint(0, 9))
        pairs.append((p, t))
    pairs += [(draw(length), ""), (draw(length), draw(12)), (draw(max(1, length // 2)), draw(length + 20))]
    error, start = seeding.best_matches_whole([p for p, _ in pairs], [t for _, t in pairs])
    for (p, t), e, s in zip(pairs, error, start, strict=True):
        # distances to all substrings: one table a start, whose last row has every end
        best = min((min(last_row(p, t[i:])), -i) for i in range(len(t) + 1))
        assert e == best[0]
        if best[0] < len(p):
            assert s == -best[1]
    if length <= 64:
        assert [x.tolist() for x in (error, start)] == [x.tolist() for x in seeding.best_matches([p for p, _ in pairs], [t for _, t in pairs])]
    assert distance("ACG", "AG") == 1


def test_windows_are_verified_with_64_bases_or_all(spark):
    rnd = random.Random(7)
    read = "".join(rnd.choices("ACGT", k=90))
    text = "TT" + read[:64] + "ACGT" + read[68:]
    df = spark.createDataFrame([(1, read, 100, text)], "read_id long, read string, window_start long, window string")
    first, whole = (seeding.verified(df, whole=x).first() for x in (False, True))
    assert (first.error, first.start) == (0, 102)
    assert (whole.error, -whole.start) == min((min(last_row(read, text[i:])), -(100 + i)) for i in range(len(text)))


def last_row(p, t):
    row = np.arange(len(t) + 1)
    for i, x in enumerate(p, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + np.array([x != y for y in t], int)) if t else np.zeros(0, int)
        out = [i]
        for v in new.tolist():
            out.append(min(v, out[-1] + 1))
        row = np.array(out)
    return row.tolist()


def test_annealed_and_early_ended_training(spark):
    rng = random.Random(6)
    genome = "".join(rng.choices("ACGT", k=900))
    rows = []
    for i in range(200):
        at = rng.randrange(5, 860)
        hits = [(0, 0, at, at + 30, "+", at - 5, genome[at - 5 : at + 35], 0, 0, -55.0, 0.25, 1.0), (1, 0, 1, 31, "+", 0, genome[rng.randrange(0, 850) :][:40], 0, 0, -55.0, 0.25, 1.0)]
        rows.append((i, f"r{i}", genome[at : at + 30], -42.0, hits))
    df = spark.createDataFrame(rows, f"read_id long, name string, seq string, r_score double, hits array<{em.HIT}>").cache()
    assert em.heat_of(5, 5) == 1.0 and 0 < em.heat_of(1, 5) < em.heat_of(2, 5) < 1
    whole, fits = em.sequence_em(df, 4)
    assert len(fits) == 8
    early, fewer = em.sequence_em(df, 4, close=0.5)
    assert len(fewer) == 5 and fewer[:2] == pytest.approx(fits[:2])
    warm, told = em.sequence_em(df, 4, anneal=True, close=0.5)
    assert len(told) == 8 and told[0] == pytest.approx(fits[0]) and not np.allclose(told[1:4], fits[1:4])
    assert np.allclose(warm.reshape(256, 256).sum(1), 1)
    with pytest.raises(ValueError):
        realign.Settings(close=1.5)


def test_tempered_posteriors_follow_the_formula(spark):
    df = spark.createDataFrame([(0, 0, -10.0, -12.0, -11.0, 0.3), (0, 1, -11.0, -12.5, -11.0, 0.1)], "read_id long, hit_idx int, a_score double, g_score double, r_score double, prior double")
    got = {r.hit_idx: (r.posterior, r.unaligned) for r in posterior.posteriors(df, heat=0.5).collect()}
    w = np.sqrt([np.exp(2) * 0.375, np.exp(1.5) * 0.125, np.exp(-11) * 0.5])
    assert np.allclose([got[0][0], got[1][0], got[0][1]], w / w.sum())


def test_a_folder_is_judged_in_one_pass(spark, tmp_path):
    folder = tmp_path / "runs"
    folder.mkdir()
    line = lambda i, pos, mapq: f"ORG{i}_chr_a_{i}_{i + 30}_+_1\t0\tchr_a\t{pos + 1}\t{mapq}\t30M\t*\t0\t0\t*\t*\n"
    (folder / "b.DCODE0000000805050A0A.sam").write_text("@HD\tVN:1.3\n" + line(5, 5, 37) + line(9, 50, 3) + "ORG7_chr_a_7_37_+_1\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*\n")
    (folder / "a.sam").write_text(line(5, 6, 60) * 3)
    (folder / "none.sam").write_text("@HD\tVN:1.3\n")
    (folder / "other.txt").write_text(line(1, 1, 1))
    rows = realign.evaluate_folder(spark, str(folder), str(tmp_path / "tsv")).collect()
    assert [(r.file, r.threads, r.total, r.mapped) for r in rows] == [("a.sam", -1, 3, 3), ("b.DCODE0000000805050A0A.sam", 8, 3, 2), ("none.sam", -1, 0, 0)]
    assert (rows[0].correct_Q5, rows[0].Q5_E1, rows[1].correct_Q3, rows[1].wrong_Q0, rows[1].Q0_E1) == (3, 3, 1, 1, 1)
    assert sum(rows[2][c] for c in rows[2].asDict() if c[0] in "cwQ") == 0
    back = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "tsv"))
    assert sorted(r.file for r in back.collect()) == ["a.sam", "b.DCODE0000000805050A0A.sam", "none.sam"]
