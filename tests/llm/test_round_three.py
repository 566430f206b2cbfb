"""Importance resampling, substring dedup and vector codes against plain Python, and over odd rows."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("seqlattice.llm")
from seqlattice.llm import codebooks, importance, quality, radix_sort, simhash, substrings, topk  # noqa: E402
from seqlattice.llm.scratch import Scratch  # noqa: E402

DOCS = "doc_id long, text string"


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_sample(docs, bench):
    f = [(i, *brute_features(t)) for i, t in docs]
    s, t = Counter(b for *_, x in f for b in x), Counter(b for x in bench for b in brute_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for i, n, x in f:
        weight, score = sum(gain[b] for b in x), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, n, len(x), weight, score, None])
    able = sorted((r for r in rows if r[1] >= 20 and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = k + 1
    return rows


def test_importance_sample_matches_brute_force(spark, small):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    want = brute_sample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    got = importance.op11_importance(spark, small).collect()
    assert sorted(map(tuple, got)) == sorted((i, n, w, s, k) for i, _, n, w, s, k in want)
    assert sum(r.rank is not None for r in got) == 5 * sum(r[1] >= 20 for r in want) // 100 > 0


def test_importance_sample_takes_odd_rows(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["a", "Bé", "x" * 63, "y" * 64, "z" * 65, "long" * 500, "7", "日本"])
    texts = [rnd.choice([" ", "-", "\n\t", "_"]).join(word() for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (None, texts[3]), (7, texts[7]), (8, texts[9]), (102, "w " * 200_000)]
    docs = spark.createDataFrame([(i, t, 1, "r", 2.0) for i, t in rows], f"{DOCS}, weight int, row string, score double")
    target = spark.createDataFrame([(None,), ("",), ("a Bé 7",)], "text string")
    got = importance.importance_sample(spark, docs, target).collect()
    want = brute_sample(rows, [None, "", "a Bé 7"])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    none = docs.where("false")
    assert importance.importance_sample(spark, none, target).count() == 0
    assert {r.rank for r in importance.importance_sample(spark, docs.limit(5), target.where("false")).collect()} == {None}


def test_checksums_of_long_and_joined_spans():
    parts = [b"a", b"b" * 63, b"c" * 64, b"d" * 65, b"e" * 66, b"f" * 5_000, b"1"]
    words, found = importance.features(pa.array([b" ".join(parts).decode(), "a"]), 1 << 32 >> 1)
    assert words.tolist() == [7, 1]
    for n, (owner, bucket) in enumerate(found, 1):
        want = [zlib.crc32(b" ".join(parts[i : i + n])) % (1 << 31) for i in range(len(parts) - n + 1)]
        assert bucket[owner == 0].tolist() == want
    assert [(o == 1).sum() for o, _ in found] == [1, 0, 0]


@pytest.mark.parametrize("low,high", [(-5, 5), (0, 0), (-(1 << 63), (1 << 63) - 1), (1 << 40, (1 << 40) + 5_000)])
def test_radix_sort_ranks_several_keys(spark, low, high):
    rnd = random.Random(low & 7)
    rows = [(i, rnd.randint(low, high), rnd.randint(-(1 << 63), 9)) for i in range(6_000)] + [(i, low, 3) for i in range(6_000, 9_000)]
    df = spark.createDataFrame(rows, "row long, a long, b long").repartition(7)
    got = {r.place: (r.a, r.b) for r in radix_sort.ranked(Scratch(spark), df, [("a", True), ("b", False)]).collect()}
    assert [got[i] for i in range(len(rows))] == sorted(((a, b) for _, a, b in rows), key=lambda x: (-x[0], x[1]))
    assert radix_sort.ranked(Scratch(spark), df.where("false"), [("a", True)]).count() == 0


def brute_repeats(rows, size=20):
    """Rows of one id don't come before each other, null ids are last."""
    seen: dict[tuple, list] = {}
    key = lambda i: float("inf") if i is None else i
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for r, (i, _) in enumerate(rows):
        for a in range(len(words[r]) - size + 1):
            seen.setdefault(tuple(words[r][a : a + size]), []).append((key(i), r, a))
    out = []
    for r, (i, _) in enumerate(rows):
        gone = set()
        for a in range(len(words[r]) - size + 1):
            if any(k < key(i) or (q == r and b < a) for k, q, b in seen[tuple(words[r][a : a + size])]):
                gone |= set(range(a, a + size))
        kept = [w for p, w in enumerate(words[r]) if p not in gone]
        spans = [(p, next(q for q in range(p, len(words[r]) + 1) if q not in gone)) for p in sorted(gone) if p - 1 not in gone]
        out.append((i, len(words[r]), len(gone), str(spans), " ".join(kept)))
    return sorted(map(str, out))


def test_substring_dedup_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE_CHARS", 20_000)
    monkeypatch.setattr(substrings, "BUCKET_CHARS", 5_000)
    rnd = random.Random(8)
    passages = [[f"p{k}_{j}" for j in range(rnd.randint(19, 70))] for k in range(6)]
    rows = []
    for i in rnd.sample(range(-500, 500), 150):
        words = [f"v{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            words[(at := rnd.randint(0, len(words))) : at] = p[rnd.randint(0, 2) :]
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(words)))
    rows += [(600 + k, rows[3][1]) for k in range(20)] + [(900, "same " * 300), (901, "same " * 19), (902, "é b " * 50)]
    rows += [(None, rows[5][1]), (None, rows[5][1]), (None, None), (903, None), (904, ""), (905, " \n\t "), rows[7], (rows[8][0], rows[9][1])]
    docs = spark.createDataFrame([(i, t, "x", 4, [1]) for i, t in rows], f"{DOCS}, slice string, n_words int, removed array<int>").repartition(5)
    found = substrings.remove_repeats(spark, docs).collect()
    got = sorted(str((r.doc_id, r.n_words, r.n_removed, str([(x.start, x.end) for x in r.removed]), r.text)) for r in found)
    assert got == brute_repeats(rows)
    assert substrings.remove_repeats(spark, docs.where("false")).count() == 0


def test_substring_dedup_of_one_long_text_and_one_hot_passage(spark):
    passage = " ".join(f"hot{i}" for i in range(60))
    rows = [(i, f"own{i} {passage} end{i}") for i in range(2_000)] + [(5_000, " ".join(f"w{i}" for i in range(300_000)))]
    got = {r.doc_id: r for r in substrings.remove_repeats(spark, spark.createDataFrame(rows, DOCS).repartition(9)).collect()}
    assert got[0].n_removed == 0 and got[5_000].n_removed == 0
    assert all(got[i].n_removed == 60 and got[i].text == f"own{i} end{i}" and got[i].removed[0][:] == (1, 61) for i in range(1, 2_000))


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, label, [math.floor(x * scale) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(kept[0][2])
    edges = [d * p // parts for p in range(parts + 1)]
    cut = lambda q: [q[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    alike = [(i, label, cut(q)) for i, label, q in kept if len(q) == d]
    book = [[q[p] for _, _, q in alike[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    best = lambda p, x: min(range(len(book[p])), key=lambda e: (far(x, book[p][e]), e))
    for _ in range(rounds):
        chosen = [[best(p, q[p]) for p in range(parts)] for *_, q in alike]
        new = []
        for p in range(parts):
            mine = [[q[p] for (*_, q), c in zip(alike, chosen, strict=True) if c[p] == e] for e in range(len(book[p]))]
            new.append([[sum(x) // len(x) for x in zip(*m, strict=True)] if m else old for m, old in zip(mine, book[p], strict=True)])
        book = new
    out = []
    for i, label, q in alike:
        c = [best(p, q[p]) for p in range(parts)]
        error = sum(far(q[p], book[p][e]) for p, e in enumerate(c))
        out.append((i, label, "".join(f"{e:02x}" for e in c), error if error < 1 << 63 else None))
    out += [(i, label, None, None) for i, label, q in kept if len(q) != d]
    text = ",".join(str(x) for b in book for e in b for x in e)
    return sorted(map(str, out)), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("dim,spread", [(16, 1.0), (11, 0.01), (8, 1e6), (3, 0.5)])
def test_codes_match_brute_force(spark, dim, spread, monkeypatch):
    monkeypatch.setattr(codebooks, "BLOCK", 50)
    rnd = np.random.default_rng(dim)
    rows = [(int(i), (rnd.normal(size=dim) * spread).tolist(), int(i) % 4 or None) for i in rnd.permutation(400)]
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1], 1), (None, rows[6][1], 2), (900, None, 1), (901, [None] * dim, 1), (902, [float("nan")] * dim, 1), (903, [float("inf")] * dim, 1), (904, [1.0] * (dim + 2), 2), (905, [], 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(5)
    coded, book, edges = codebooks.compress(spark, df)
    want, sha = brute_codes(rows)
    assert sorted(str((r.vec_id, r.label, r.code, r.error)) for r in coded.collect()) == want
    assert codebooks.digest(book, edges) == sha
    sums: dict = {}
    for r in coded.collect():
        sums[r.label] = sums.get(r.label, 0) + (r.error or 0)
    assert {(r.label, r.label_error) for r in codebooks.with_label_errors(coded).collect()} == {(k, x if x < 1 << 63 else None) for k, x in sums.items()}


def test_codes_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 8, None), (2, [0.25] * 8, "b"), (3, [1e300] * 8, "c")], "vec_id long, embedding array<double>, label string")
    coded, book, edges = codebooks.compress(spark, df)
    assert {(r.vec_id, r.code, r.error) for r in coded.collect()} == {(1, "00" * 8, 0), (2, "01" * 8, 0)}
    coded, book, edges = codebooks.compress(spark, df.where("false"))
    assert coded.count() == 0 and codebooks.with_label_errors(coded).count() == 0
    assert codebooks.digest(book, edges) == hashlib.sha256(b"").hexdigest()
    bare, _, _ = codebooks.compress(spark, spark.createDataFrame([(1, [], "a"), (2, [], "a")], df.schema))
    assert {(r.code, r.error) for r in bare.collect()} == {("00" * 8, 0)}


def test_documents_find_their_stretch_of_ids(spark):
    for n in (0, 1, 2, 7, 50, 600):
        cuts = sorted(random.Random(n).sample(range(-1000, 1000), n))
        ids = spark.range(-1100, 1100).select("id", simhash.cut_number(F.col("id"), cuts).alias("n"))
        assert all(r.n == bisect.bisect_left(cuts, r.id) for r in ids.collect())


def test_a_common_fingerprint_and_clashing_names(spark):
    rows = [(i, "same words in all of them" if i % 3 else f"own text number {i}", "x", 1.0, 2) for i in range(300)]
    docs = spark.createDataFrame(rows, f"{DOCS}, fp string, n_near double, bucket int")
    got = {r.doc_id: r for r in simhash.document_fingerprints(spark, docs).collect()}
    assert len(got) == 300 and {got[i].class_id for i in range(300) if i % 3} == {1}


def test_the_sample_of_the_classifier_is_bounded_by_features(spark):
    rows = [(i, ("bad junk " if i % 2 else "good text ") + " ".join(f"w{i}_{j}" for j in range(50))) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1 - i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    whole, none = quality.fit(spark, docs, labels), quality.fit(spark, docs, labels, most=10)
    some = quality.fit(spark, docs, labels, most=100 * 160)
    assert (none.weights == 0).all() and (whole.weights != 0).any() and (some.weights != 0).any()
    tails = quality.Model.tails(some, pa.array(["good text w", "bad junk w"]))[:, -1]
    assert tails[0] > tails[1]


def test_the_longest_block_is_sent_by_many_keys(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rnd = np.random.default_rng(2)
    x = np.floor(rnd.normal(size=(500, 6)) * 1000) / 256
    got = topk.top_k(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    q = np.floor(x * 256).astype(int)
    for i in range(0, 500, 50):
        s = q @ q[i]
        want = sorted(((-int(s[j]), j) for j in range(500) if j != i))[:5]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i) == [(k + 1, j, -n) for k, (n, j) in enumerate(want)]
