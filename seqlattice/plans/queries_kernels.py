"""Forward sums, expected counts and best alignments of the starting model over the search's hits, and the SQL that works them out cell by cell."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import em, hmm
from .queries_align import RENDER_SQL, TOP_SQL
from .queries_model import gathered_hits


def hmm_expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step of the sequence model's EM: how often the starting model expects each transition, over all reads and hits, weighted by posterior and locus; code -1 is the log-likelihood."""
    counts = em.expectation(gathered_hits(spark, sf_dir), hmm.initial_model(), ignore_unaligned=True)
    return counts.select("code", F.round("count", 4).alias("count")).where("count <> 0")


QUERIES = {"hmm_expected_counts": hmm_expected_counts}

# the search's hits with padded loci, weights and background scores, as em.gather() has them
GATHERED_SQL = f"""{TOP_SQL},
tops AS MATERIALIZED (SELECT read_id, CAST(rank - 1 AS INTEGER) AS hit_idx, chrom_idx, start, start + len AS stop, strand, count(*) OVER (PARTITION BY read_id) AS num_hits FROM r WHERE rank <= 10),
depths AS (SELECT chrom_idx, start, stop, strand, sum(1.0::DOUBLE / num_hits) AS depth FROM tops GROUP BY ALL),
spans AS (SELECT t.*, CASE WHEN depth < 10 THEN 1.0 WHEN depth < 10000 THEN 1 / log10(depth) ELSE 0.25 END AS weight, q.seq, g.seq AS chrom_seq, greatest(t.start - 5, 0) AS la, least(t.stop + 5, g.seq_len) AS lb
  FROM tops t JOIN depths d ON d.chrom_idx = t.chrom_idx AND d.start = t.start AND d.stop = t.stop AND d.strand = t.strand JOIN reads q ON q.read_id = t.read_id JOIN genome g ON g.chrom_idx = t.chrom_idx),
bare AS MATERIALIZED (SELECT *, CASE WHEN strand = '-' THEN reverse(translate(plus, 'ACGT', 'TGCA')) ELSE plus END AS bare, greatest(5 - (start - la), 0) AS pad_a, greatest(5 - (lb - stop), 0) AS pad_b
  FROM (SELECT *, substr(chrom_seq, la + 1, greatest(lb - la, 0)) AS plus FROM spans)),
padded AS MATERIALIZED (SELECT *, CASE WHEN strand = '-' THEN repeat('N', pad_b) || bare || repeat('N', pad_a) ELSE repeat('N', pad_a) || bare || repeat('N', pad_b) END AS locus FROM bare),
units AS (SELECT 'genome' AS model, bare AS s, weight FROM padded UNION ALL SELECT 'read', any_value(seq), max(weight) FROM padded GROUP BY read_id),
dinucs AS (SELECT model, (instr('ACGT', substr(s, i, 1)) - 1) * 5 + instr('ACGT', substr(s, i + 1, 1)) - 1 AS code, sum(weight) AS count FROM (SELECT model, s, weight, unnest(range(1, length(s))) AS i FROM units) GROUP BY ALL),
backgrounds AS MATERIALIZED (SELECT model, code, ln(count / sum(count) OVER (PARTITION BY model, code // 5)) AS l
  FROM (SELECT m.model, c.code, coalesce(dinucs.count, 0) + 10 AS count FROM (SELECT DISTINCT model FROM dinucs) m CROSS JOIN range(25) c(code) LEFT JOIN dinucs ON dinucs.model = m.model AND dinucs.code = c.code)),
g_scores AS (SELECT read_id, hit_idx, sum(l) AS g FROM (SELECT read_id, hit_idx, (instr('ACGTN', substr(locus, i, 1)) - 1) * 5 + instr('ACGTN', substr(locus, i + 1, 1)) - 1 AS code FROM (SELECT *, unnest(range(1, length(locus))) AS i FROM padded)) x
  JOIN backgrounds b ON b.model = 'genome' AND b.code = x.code GROUP BY ALL),
gathered AS MATERIALIZED (SELECT p.read_id, p.hit_idx, seq, locus, weight, g, 0.5::DOUBLE / num_hits AS prior FROM padded p JOIN g_scores s ON s.read_id = p.read_id AND s.hit_idx = p.hit_idx
  WHERE length(bare) >= 11 AND length(seq) >= 11),
pairs AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY seq, locus) AS INTEGER) AS p, seq, locus, CAST(length(seq) AS INTEGER) AS n, CAST(length(locus) AS INTEGER) AS m FROM (SELECT DISTINCT seq, locus FROM gathered))"""

# Before any read is seen a transition's chance depends on the column it leads to alone; this table is hmm_mstep's start, held to SQL there.
LOGS_SQL = "[" + ", ".join(repr(math.log(x)) for x in hmm.initial_model()[:112].tolist()) + "]::DOUBLE[]"


def _letter(text: str, at: str) -> str:
    return f"(instr('ACGTN', substr({text}, {at}, 1)) - 1)"


def _log(read: str, genome: str) -> str:
    return f"list_extract({LOGS_SQL}, CAST(16 * {read} + {genome} + 1 AS BIGINT))"


def _both(i: str, j: str) -> str:
    return f"({i} >= 1 AND {i} <= n AND {j} BETWEEN 2 AND m - 2)"


def _into_gap(i: str, j: str) -> str:
    return f"({_both(i, j)} OR {i} = n AND {j} = m - 1)"


def _gaps(i: str, j: str) -> str:
    return f"({j} BETWEEN 2 AND m - 2 OR {i} = n AND {j} BETWEEN 2 AND m)"


GAP_SQL = "CASE WHEN i = 0 OR i = n THEN 6 ELSE 5 END"
UNIT = 16.0  # what sums are multiplied by on each anti-diagonal, so that they stay in range
KINDS = ("mm", "xm", "ym", "mx", "xx", "yx", "my", "xy", "yy")

# Sums up to each cell, an anti-diagonal d of all pairs a step: m1, x1, y1 stand on d, m2, x2, y2 on the one before; mm to yy are the parts that each pair of states gives.
FORWARD_SQL = f"""forward_cells AS (
  SELECT p, seq, locus, n, m, CAST(unnest(range(0, n + 1)) AS INTEGER) AS i, 1 AS d, {", ".join(f"0.0::DOUBLE AS {c}" for c in ("m1", "x1", "y1", "m2", "x2", "y2", *KINDS))} FROM pairs
  UNION ALL
  SELECT p, seq, locus, n, m, i, d + 1, mm + xm + ym, mx + xx + yx, my + xy + yy, m1, x1, y1, {", ".join(KINDS)}
  FROM (SELECT p, seq, locus, n, m, i, d, m1, x1, y1, tm * coalesce(am2, 0) AS mm, tm * coalesce(ax2, 0) AS xm, tm * coalesce(ay2, 0) AS ym, tx * coalesce(am1, 0) AS mx, tx * coalesce(ax1, 0) AS xx, tx * coalesce(ay1, 0) AS yx,
      tg * m1 AS my, tg * x1 AS xy, ty * (y1 + CASE WHEN i = 0 AND d = 1 THEN 1 ELSE 0 END) AS yy
    FROM (SELECT *, CASE WHEN {_both("i", "j")} THEN {UNIT * UNIT} * exp({_log(_letter("seq", "i"), _letter("locus", "j"))}) ELSE 0 END AS tm, CASE WHEN {_both("i", "j")} THEN {UNIT} * exp({_log(_letter("seq", "i"), "5")}) ELSE 0 END AS tx,
        CASE WHEN {_into_gap("i", "j")} THEN {UNIT} * exp({_log(GAP_SQL, _letter("locus", "j"))}) ELSE 0 END AS tg, CASE WHEN {_gaps("i", "j")} THEN {UNIT} * exp({_log(GAP_SQL, _letter("locus", "j"))}) ELSE 0 END AS ty
      FROM (SELECT *, d + 1 - i AS j, lag(m1) OVER w AS am1, lag(x1) OVER w AS ax1, lag(y1) OVER w AS ay1, lag(m2) OVER w AS am2, lag(x2) OVER w AS ax2, lag(y2) OVER w AS ay2 FROM forward_cells WHERE d < n + m WINDOW w AS (PARTITION BY p ORDER BY i))))),
totals AS MATERIALIZED (SELECT p, seq, locus, y1 AS z, ln(y1) - (n + m - 1) * ln({UNIT}) AS a FROM forward_cells WHERE i = n AND d = n + m)"""

# Sums from each cell to the end: b those of M and X, which are equal, as the start's chances don't look at the column before; b_y those of Y, b2 the b of the next anti-diagonal.
BACKWARD_SQL = f"""backward_cells AS (
  SELECT p, seq, locus, n, m, i, n + m AS d, 0.0::DOUBLE AS b, CASE WHEN i = n THEN 1.0::DOUBLE ELSE 0.0 END AS b_y, 0.0::DOUBLE AS b2 FROM (SELECT *, CAST(unnest(range(0, n + 1)) AS INTEGER) AS i FROM pairs)
  UNION ALL
  SELECT p, seq, locus, n, m, i, d - 1, tm * coalesce(cb2, 0) + tx * coalesce(cb, 0) + tg * b_y, tm * coalesce(cb2, 0) + tx * coalesce(cb, 0) + ty * b_y, b
  FROM (SELECT *, CASE WHEN {_both("(i + 1)", "(j + 1)")} THEN {UNIT * UNIT} * exp({_log(_letter("seq", "i + 1"), _letter("locus", "j + 1"))}) ELSE 0 END AS tm, CASE WHEN {_both("(i + 1)", "j")} THEN {UNIT} * exp({_log(_letter("seq", "i + 1"), "5")}) ELSE 0 END AS tx,
      CASE WHEN {_into_gap("i", "(j + 1)")} THEN {UNIT} * exp({_log(GAP_SQL, _letter("locus", "j + 1"))}) ELSE 0 END AS tg, CASE WHEN {_gaps("i", "(j + 1)")} THEN {UNIT} * exp({_log(GAP_SQL, _letter("locus", "j + 1"))}) ELSE 0 END AS ty
    FROM (SELECT *, d - 1 - i AS j, lead(b) OVER w AS cb, lead(b2) OVER w AS cb2 FROM backward_cells WHERE d > 2 WINDOW w AS (PARTITION BY p ORDER BY i))))"""

FROM_ROW, FROM_GAP = f"CASE WHEN i = 1 THEN 6 ELSE {_letter('seq', 'i - 1')} END", "CASE WHEN i = 1 THEN 6 ELSE 5 END"
OWN, BASE, FROM_BASE = _letter("seq", "i"), _letter("locus", "d - i"), _letter("locus", "d - i - 1")
CODES = {  # read symbols, then genome symbols, of the column before and the cell's own
    "mm": (FROM_ROW, OWN, FROM_BASE, BASE), "xm": (FROM_ROW, OWN, "5", BASE), "ym": (FROM_GAP, OWN, FROM_BASE, BASE),
    "mx": (FROM_ROW, OWN, BASE, "5"), "xx": (FROM_ROW, OWN, "5", "5"), "yx": (FROM_GAP, OWN, BASE, "5"),
    "my": (OWN, GAP_SQL, FROM_BASE, BASE), "xy": (OWN, GAP_SQL, "5", BASE), "yy": (GAP_SQL, GAP_SQL, FROM_BASE, BASE),
}
USED_SQL = " UNION ALL ".join(f"SELECT p, ({r1}) * 4096 + ({r2}) * 16 + ({g1}) * 256 + ({g2}) AS code, {k} * {'b_y' if k[1] == 'y' else 'b'} / z AS used FROM met WHERE {k} * {'b_y' if k[1] == 'y' else 'b'} > 0" for k, (r1, r2, g1, g2) in CODES.items())
COUNTS_SQL = f"""WITH RECURSIVE {GATHERED_SQL}, {FORWARD_SQL}, {BACKWARD_SQL},
chances AS (SELECT g.read_id, t.p, g.weight, t.a - g.g + ln(prior / sum(prior) OVER (PARTITION BY read_id) * 0.5) AS x FROM gathered g JOIN totals t ON t.seq = g.seq AND t.locus = g.locus),
tops_of AS (SELECT *, max(x) OVER (PARTITION BY read_id) AS top FROM chances),
sums AS MATERIALIZED (SELECT *, sum(exp(x - top)) OVER (PARTITION BY read_id) AS e FROM tops_of),
weights_of AS (SELECT p, sum(weight * exp(x - top) / e) AS w FROM sums GROUP BY p),
met AS MATERIALIZED (SELECT f.*, b.b, b.b_y, t.z FROM forward_cells f JOIN backward_cells b ON b.p = f.p AND b.i = f.i AND b.d = f.d JOIN totals t ON t.p = f.p WHERE f.d >= 2),
used AS ({USED_SQL})
SELECT * FROM (SELECT CAST(code AS INTEGER) AS code, round(sum(used * w), 4) AS count FROM used JOIN weights_of USING (p) GROUP BY code) WHERE count <> 0
UNION ALL SELECT -1, round(sum(l), 4) FROM (SELECT read_id, any_value(ln(e) + top) AS l FROM sums GROUP BY read_id)"""

DEAD = "'-Infinity'::DOUBLE"


def _add(live: str, log: str, value: str) -> str:
    return f"CASE WHEN {live} THEN {log} + coalesce({value}, {DEAD}) ELSE {DEAD} END"


def _first_best(*choices: tuple[str, str]) -> str:
    """The text of the first choice (value, text) whose value is the largest."""
    (a, one), (b, two), (c, three) = choices
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN {one} WHEN {b} >= {c} THEN {two} ELSE {three} END"


# The best score and the text of the best path, two letters a column, of each cell and state: m1 and m1s on anti-diagonal d, m2 and m2s on the one before.
BEST_SQL = f"""best_cells AS (
  SELECT p, seq, locus, n, m, CAST(unnest(range(0, n + 1)) AS INTEGER) AS i, 1 AS d, {", ".join(f"{DEAD} AS {c}, '' AS {c}s" for c in ("m1", "x1", "y1", "m2", "x2", "y2"))} FROM pairs
  UNION ALL
  SELECT p, seq, locus, n, m, i, d + 1, greatest(mm, xm, ym), {_first_best(("mm", "am2s"), ("xm", "ax2s"), ("ym", "ay2s"))} || substr(seq, i, 1) || substr(locus, j, 1),
    greatest(mx, xx, yx), {_first_best(("xx", "ax1s"), ("mx", "am1s"), ("yx", "ay1s"))} || substr(seq, i, 1) || '-',
    greatest(my, xy, yy), {_first_best(("yy", "CASE WHEN i = 0 AND d = 1 THEN '-' || substr(locus, 1, 1) ELSE y1s END"), ("my", "m1s"), ("xy", "x1s"))} || '-' || substr(locus, j, 1), m1, m1s, x1, x1s, y1, y1s
  FROM (SELECT *, {", ".join(_add(_both("i", "j"), "tm", f"a{k}2") + f" AS {k}m" for k in "mxy")}, {", ".join(_add(_both("i", "j"), "tx", f"a{k}1") + f" AS {k}x" for k in "mxy")},
      {", ".join(_add(_into_gap("i", "j"), "ty", f"{k}1") + f" AS {k}y" for k in "mx")}, {_add(_gaps("i", "j"), "ty", "CASE WHEN i = 0 AND d = 1 THEN 0 ELSE y1 END")} AS yy
    FROM (SELECT *, {_log(_letter("seq", "i"), _letter("locus", "j"))} AS tm, {_log(_letter("seq", "i"), "5")} AS tx, {_log(GAP_SQL, _letter("locus", "j"))} AS ty
      FROM (SELECT *, d + 1 - i AS j, {", ".join(f"lag({k}{e}) OVER w AS a{k}{e}, lag({k}{e}s) OVER w AS a{k}{e}s" for k in "mxy" for e in (1, 2))} FROM best_cells WHERE d < n + m WINDOW w AS (PARTITION BY p ORDER BY i))))),
best_paths AS MATERIALIZED (SELECT seq, locus, y1 AS v, y1s AS path FROM best_cells WHERE i = n AND d = n + m),
path_columns AS (SELECT read_id, hit_idx, k, substr(path, 2 * k - 1, 1) AS r, substr(path, 2 * k, 1) AS b FROM (SELECT g.read_id, g.hit_idx, path, unnest(range(1, length(path) // 2 + 1)) AS k FROM gathered g JOIN best_paths t ON t.seq = g.seq AND t.locus = g.locus)),
plus AS (SELECT read_id, hit_idx, row_number() OVER (PARTITION BY read_id, hit_idx ORDER BY k) AS p, r, CASE WHEN b = 'N' THEN '-' ELSE b END AS b FROM path_columns WHERE NOT (r = '-' AND b = 'N'))"""

ORACLE_SQL = {
    "hmm_forward_score": f"""WITH RECURSIVE {GATHERED_SQL}, {FORWARD_SQL} SELECT read_id, hit_idx, round(a, 5) AS a_score, round(g, 5) AS g_score FROM gathered g JOIN totals t ON t.seq = g.seq AND t.locus = g.locus""",
    "hmm_expected_counts": COUNTS_SQL,
    "hmm_viterbi_path": f"""WITH RECURSIVE {GATHERED_SQL}, {BEST_SQL}, {RENDER_SQL}
SELECT read_id, hit_idx, round(v, 5) AS v_score, add, cigar, md, nm FROM nms JOIN cigars USING (read_id, hit_idx) JOIN mds USING (read_id, hit_idx) JOIN gathered USING (read_id, hit_idx) JOIN best_paths USING (seq, locus)""",
}
