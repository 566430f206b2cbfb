"""The registered queries against their SQL, and the pipeline stage by stage."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from test_operators import brute_lines, brute_near

pytest.importorskip("seqlattice.llm")
from seqlattice.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    found = QUERIES[name](spark, small)
    cur = con.execute(ORACLE_SQL[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(found.columns)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in found.collect()))) == sorted(map(str, cur.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_covers_every_document(spark, small, name):
    want = {r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r.doc_id for r in QUERIES[name](spark, small).collect()} == want


def test_pipeline_stages_keep_the_columns_and_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == columns
        assert 0 < docs.count() <= rows, name
        rows = docs.count()
    ids = {r.doc_id for r in docs.collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in last} == ids and len(last) == len(ids)
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).collect()} == ids


def test_pipeline_stages_take_empty_and_odd_rows(spark, small):
    empty = spark.read.parquet(f"{small}/documents.parquet").where("false")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", "en", "a", 3), (3, "a b c d e f", "en", "a", 11), (3, "a b c d e f", "en", "a", 11)], empty.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0
        assert stage(spark, odd, small).count() >= 3


def test_pipeline_stages_leave_columns_of_any_name_alone(spark, small):
    """Columns named as those that operators add, columns of maps, and tables without n_chars, source and lang."""
    names = ["selected", "expected_grade", "removed", "n_lines", "kept", "n_tokens", "topic", "probability", "row", "gone", "unit"]
    line = " ".join(f"w{i}" for i in range(60))
    texts = ["one two three", f"own\n{line}", f"{line}\nother words here", None, ""]
    rows = [(i, t, *[f"mine{i}"] * len(names), {"a": i}) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names) + ", extra map<string,int>")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, small)
        assert left.columns == docs.columns and left.dtypes == docs.dtypes, name
        for r in left.collect():
            assert {r[n] for n in names} == {f"mine{r.doc_id}"} and r.extra == {"a": r.doc_id}, name
    freed = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, small).collect()}
    assert freed == {0: texts[0], 1: texts[1], 2: "other words here", 3: None, 4: ""}
    assert corpus_pipeline.encode(spark, docs, small).count() == len(rows) + 1


def test_near_dedup_stage_leaves_one_of_each_group(spark, small):
    base = " ".join(f"word{i}" for i in range(100))
    rows = [(9, base, "en", "a", 1), (4, base + " more", "en", "b", 1), (7, base.upper(), "en", "c", 1), (8, "quite another text of its own", "en", "a", 1), (8, "quite another text of its own", "en", "a", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{small}/documents.parquet").schema)
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, small).collect()) == [4, 8]


def test_pipeline_stages_match_brute_force(spark, small):
    """Every stage after the first against plain Python on the rows that the stage before it left."""
    rnd = random.Random(31)
    lines = [" ".join(rnd.choices([f"w{i}" for i in range(300)], k=12)) for _ in range(30)]
    rows = []
    for i in range(1, 90):
        body = rows[rnd.randrange(len(rows))][1].split("\n") if rows and rnd.random() < 0.3 else [" ".join(rnd.choices([f"v{j}" for j in range(900)], k=9)) for _ in range(6)]
        if rnd.random() < 0.4:
            body = body + lines[(at := rnd.randrange(20)) : at + rnd.randint(2, 8)]
        if rnd.random() < 0.5:
            body[0] = body[0] + f" own{i}"
        rows.append((i, "\n".join(body), rnd.choice(["en", "de", None]), rnd.choice("abc"), len("\n".join(body))))
    rows += [(200, None, "en", "a", None), (201, "", None, None, 0), (None, "no id", "en", "a", 5), rows[3]]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{small}/documents.parquet").schema)

    freed = corpus_pipeline.drop_repeated_lines(spark, docs, small)
    gone = brute_lines([(i, t or "") for i, t, *_ in rows if i is not None], 50)
    want = []
    for i, t, lang, source, n in rows:
        drop = gone.get((i, t or ""), [])
        left = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in drop) if drop else t
        if not drop or left.strip():
            want.append((i, left, lang, source, len(left) if drop else n))
    assert sorted(map(str, map(tuple, freed.collect()))) == sorted(map(str, want))
    assert any(gone.values())

    one = corpus_pipeline.keep_one_of_each_group(spark, freed, small)
    groups = brute_near([(i, t) for i, t, *_ in want if i is not None], 5, 80)
    expected = [*{r for r in want if r[0] is not None and groups[r[0]][1] == r[0]}, *(r for r in want if r[0] is None)]
    assert sorted(map(str, map(tuple, one.collect()))) == sorted(map(str, expected))
    assert len(expected) < len(want)

    kept = corpus_pipeline.mix_to_targets(spark, one, small)
    chances = {(r.doc_id, r.text_key): (r.probability, r.kept) for r in corpus_pipeline.mixing.mix_sources(spark, one).collect()}
    assert kept.count() == sum(k for _, k in chances.values())
    assert all(k for p, k in chances.values() if p == 1)

    coded = corpus_pipeline.encode(spark, kept, small).collect()
    texts = {r.doc_id: r.text or "" for r in kept.collect()}
    assert sorted(str(r.doc_id) for r in coded) == sorted(map(str, texts))
    ranks = corpus_pipeline.bpe.read_ranks(corpus_pipeline.public_tokenizers.path(corpus_pipeline.bpe.VOCABULARY))
    for r in coded:
        ids = np.frombuffer(r.token_ids, "<u4")
        assert b"".join(ranks[i] for i in ids).decode() == texts[r.doc_id] and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(r.token_ids).hexdigest()
