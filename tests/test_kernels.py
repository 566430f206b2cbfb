import random

import numpy as np

from seqlattice.operators.alignments import render
from seqlattice.operators.hmm import initial_model, reestimate
from seqlattice.operators.kernels import Lattice, backward, codes_of, expected_counts, forward, viterbi
from seqlattice.operators.seeding import best_matches


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bit_parallel_match_is_the_least_distance_to_any_substring_at_its_largest_start():
    rnd = random.Random(1)
    pairs = [("".join(rnd.choices("ACGT", k=rnd.randint(1, 8))), "".join(rnd.choices("ACGTN", k=rnd.randint(0, 14)))) for _ in range(150)]
    error, start = best_matches([p for p, _ in pairs], [t for _, t in pairs])
    for (p, t), e, s in zip(pairs, error, start, strict=True):
        all_of = [(distance(p, t[i:j]), -i) for i in range(len(t) + 1) for j in range(i, len(t) + 1)]
        best, at = min(all_of)
        assert e == best
        if best < len(p):
            assert s == -at


def test_patterns_of_64_and_more_letters_use_the_first_64():
    p = "".join(random.Random(9).choices("ACGT", k=72))
    error, start = best_matches([p[:64], p], ["TT" + p, "TT" + p])
    assert error.tolist() == [0, 0] and start.tolist() == [2, 2]


def into(x, state, i, j):
    """The recurrence as written: predecessors (state, i, j) of a live cell with the transition's code, for one pair."""
    a, b, n, m, I, E = x.a[0], x.b[0], x.n, x.m, 5, 6
    c = lambda *s: (s[0] << 12) | (s[1] << 8) | (s[2] << 4) | s[3]
    if state == "Y":
        gap = E if i in (0, n) else I
        own = c(gap, b[j - 1], gap, b[j])
        if (i, j) == (0, 2):
            return [("start", 0, 1, own)]
        return [("Y", i, j - 1, own)] + ([("M", i, j - 1, c(a[i], b[j - 1], gap, b[j])), ("X", i, j - 1, c(a[i], I, gap, b[j]))] if i else [])
    back, to = (j - 1, b[j]) if state == "M" else (j, I)
    if i == 1:
        return [("Y", 0, back, c(E, b[back], a[1], to))]
    return [("M", i - 1, back, c(a[i - 1], b[back], a[i], to)), ("X", i - 1, back, c(a[i - 1], I, a[i], to)), ("Y", i - 1, back, c(I, b[back], a[i], to))]


def paths_of(x, T):
    """Every alignment's probability and transitions, by walking all paths."""

    def live(s, i, j):
        return 2 <= j <= x.m - 2 and (s == "Y" or i >= 1) or s == "Y" and i == x.n and 2 <= j <= x.m

    def walk(s, i, j):
        for p, k, q, step in into(x, s, i, j):
            if p == "start":
                yield np.exp(T[step]), [step]
            elif live(p, k, q):
                for prob, used in walk(p, k, q):
                    yield prob * np.exp(T[step]), [*used, step]

    return list(walk("Y", x.n, x.m))


def test_forward_backward_viterbi_and_counts_against_all_paths():
    rng = np.random.default_rng(3)
    T = np.log(rng.random(65536))
    for n, m in ((2, 5), (3, 6), (3, 7)):
        lattice = Lattice(rng.integers(0, 5, (1, n)), rng.integers(0, 5, (1, m)), least=0)
        every = paths_of(lattice, T)
        total = sum(p for p, _ in every)
        score, f = forward(lattice, T)
        assert np.isclose(score[0], np.log(total))
        assert np.isclose(backward(lattice, T)[0][0], np.log(total))
        counts = expected_counts(lattice, T, f, score, np.array([2.0]))
        want = np.zeros(65536)
        for p, used in every:
            np.add.at(want, used, 2.0 * p / total)
        assert np.allclose(counts, want)
        best, paths = viterbi(lattice, T)
        top = max(every)
        assert np.isclose(best[0], np.log(top[0]))
        columns = paths[0]
        steps = [(columns[k][0] << 12) | (columns[k][1] << 8) | (columns[k + 1][0] << 4) | columns[k + 1][1] for k in range(len(columns) - 1)]
        assert len(steps) == len(top[1])
        assert [s & 0x0F0F for s in steps] == [t & 0x0F0F for t in top[1]]
        assert sum(r < 5 for r, _ in columns) == n and sum(g < 5 for _, g in columns) == m


def test_batches_score_as_single_pairs():
    rng = np.random.default_rng(5)
    T = np.log(initial_model())
    reads, loci = rng.integers(0, 4, (6, 12)), rng.integers(0, 4, (6, 22))
    together = forward(Lattice(reads, loci), T)[0]
    alone = [forward(Lattice(reads[i : i + 1], loci[i : i + 1]), T)[0][0] for i in range(6)]
    assert np.allclose(together, alone)


def test_model_rows_sum_to_one_and_start_as_surveyed():
    model = initial_model()
    assert np.allclose(model.reshape(256, 256).sum(1), 1)
    assert abs(model[0] - 0.0043) < 1e-4
    again = reestimate(np.zeros(65536), model)
    assert np.allclose(again.reshape(256, 256).sum(1), 1)


def test_codes_take_any_case_and_other_letters_as_n():
    assert codes_of(["ACGTNacgtx"]).tolist() == [[0, 1, 2, 3, 4, 0, 1, 2, 3, 4]]


def col(r, g):
    return 16 * "ACGTN-".index(r) + "ACGTN-".index(g)


def test_rendering():
    flank = [col("-", "A"), col("-", "C")]
    assert render([*flank, col("A", "A"), col("C", "G"), col("T", "T"), *flank]) == (2, "3M", "1G1", 1)
    assert render([col("A", "A"), col("G", "-"), col("C", "C")]) == (0, "1M1I1M", "2", 1)
    assert render([col("A", "A"), col("-", "G"), col("-", "T"), col("C", "C")]) == (0, "1M2D1M", "1^GT1", 2)
    assert render([col("A", "A"), col("-", "G"), col("C", "T")]) == (0, "1M1D1M", "1^G0T0", 2)
    assert render(flank) == (0, "*", "0", 0)
    assert render([col("A", "A")] * 200) == (0, "200M", "200", 0)


def test_long_pairs_keep_their_scale():
    rng = np.random.default_rng(11)
    T = np.log(initial_model())
    read = rng.integers(0, 4, 300)
    locus = np.concatenate([rng.integers(0, 4, 5), read, rng.integers(0, 4, 5)])
    lattice = Lattice(read[None], locus[None])
    score, f = forward(lattice, T)
    assert np.isfinite(score[0]) and np.isclose(score[0], backward(lattice, T)[0][0])
    counts = expected_counts(lattice, T, f, score, np.ones(1))
    assert 300 < counts.sum() < 330
    best, paths = viterbi(lattice, T)
    assert best[0] <= score[0] and render([16 * r + g for r, g in paths[0]])[:2] == (5, "300M")


def test_pieces_hold_reads_of_one_length_and_fit_in_memory(monkeypatch):
    import pyarrow as pa

    from seqlattice.operators import em

    monkeypatch.setattr(em, "TABLE_BYTES", 3 << 20)
    rng = random.Random(2)
    rows = [("A" * rng.choice((20, 30, 75, 400)), [1] * rng.randint(1, 10)) for _ in range(200)]
    parts = list(em._pieces(pa.RecordBatch.from_pydict({"seq": [s for s, _ in rows], "hits": [h for _, h in rows]})))
    assert sorted((r["seq"], r["hits"]) for p in parts for r in p.to_pylist()) == sorted(rows)
    assert sum(len({len(s) for s in p["seq"].to_pylist()}) > 1 for p in parts) <= 3
    assert all(p.num_rows == 1 or sum(em.CELL_BYTES * (len(r["seq"]) + 3) * (2 * len(r["seq"]) + 13) * len(r["hits"]) for r in p.to_pylist()) <= 3 << 20 for p in parts)
