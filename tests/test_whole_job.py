"""Queries that must look at all reads, and at all of a read."""

import random

import duckdb
import pytest
from test_intervals_and_reports import last_row

from seqlattice.operators import em, seeding
from seqlattice.plans import queries_align, queries_model, queries_sim, realign


@pytest.mark.parametrize("query", [queries_model.realigned_sam, queries_model.em_sequence_model, queries_sim.closed_loop])
def test_the_model_is_fitted_on_all_reads(spark, small, monkeypatch, query):
    prepared, given, fitted = realign._prepared, [], []

    def prepare(*a):
        given.append(prepared(*a))
        return given[-1]

    def fit(gathered, *_):
        fitted.append(gathered)
        raise StopIteration

    monkeypatch.setattr(realign, "_prepared", prepare)
    monkeypatch.setattr(em, "training_sample", lambda gathered, most: gathered.limit(1))
    monkeypatch.setattr(em, "sequence_em", fit)
    with pytest.raises(StopIteration):
        query(spark, small)
    assert fitted[0] is given[0][0]


def test_whole_reads_are_verified_by_seeds_of_all_their_bases(spark, tmp_path):
    rnd = random.Random(12)
    text = "".join(rnd.choices("ACGT", k=400))
    wrong = lambda s: "".join("ACGT"["ACGT".index(c) - (i % 9 == 4)] for i, c in enumerate(s))
    # read 1 errs after its 64 bases; of read 2 the seeds that fit come after them; read 3 lies on the other strand
    own = [(1, text[20:84] + wrong(text[84:110])), (2, "".join(rnd.choices("ACGT", k=66)) + text[200:230]), (3, text[300:380][::-1].translate(str.maketrans("ACGT", "TGCA")))]
    spark.createDataFrame([(5, text)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(own, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = queries_align.verify_edit_distance(spark, str(tmp_path)).collect()
    sides = {(i, k): s if k == "+" else s[::-1].translate(str.maketrans("ACGT", "TGCA")) for i, s in own for k in "+-"}
    for r in rows:
        read, begin = sides[r.read_id, r.strand], max(r.diagonal, 0)
        window = text[begin : max(begin, r.diagonal + len(read) + 10)]
        assert (r.error, -r.start) == min((min(last_row(read, window[i:])), -(begin + i)) for i in range(len(window)))
    best = {(r.read_id, r.strand): r.error for r in sorted(rows, key=lambda r: -r.error)}
    assert best[1, "+"] == 3 and (2, "+") in best and best[3, "-"] == 0
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(queries_align.ORACLE_SQL["verify_edit_distance"]).fetchall()
    assert sorted(map(tuple, rows)) == sorted(want)


def test_patterns_of_any_length_match_alike(monkeypatch):
    rnd = random.Random(13)
    pairs = [(p, "".join(c for c in p if rnd.random() > 0.1) + "".join(rnd.choices("ACGT", k=rnd.choice((0, 7))))) for n in (1, 64, 65, 128, 129, 300) for p in ["".join(rnd.choices("ACGT", k=n)) for _ in range(3)]]
    want = [x.tolist() for x in seeding.best_matches_whole(*map(list, zip(*pairs, strict=True)))]
    for words, held in ((8, 1 << 26), (2, 1), (1, 1)):
        monkeypatch.setattr(seeding, "MANY_WORDS", words)
        monkeypatch.setattr(seeding, "MASK_BYTES", held)
        assert [x.tolist() for x in seeding._whole_matches(*zip(*pairs, strict=True))] == want
