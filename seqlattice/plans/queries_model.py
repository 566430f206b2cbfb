"""Queries of the probabilistic model: backgrounds, posteriors, priors, kernels and EM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import mapq, sam_flag, temperature
from ..operators import alignments, em, hmm, loci, posterior, random_model, seeding
from ..sources.fixtures import GENOME_SQL, READS_SQL, genome, reads, training_reads
from . import realign
from .queries_align import LOCI_SQL, PATHS_SQL, exact_hits, longest_read, paths_of_hits


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loci.with_weights(loci.locus_sequences(genome(spark, sf_dir), exact_hits(spark, sf_dir), longest=longest_read(spark, sf_dir)))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return random_model.dinucleotide_counts(_located(spark, sf_dir), reads(spark, sf_dir))


def dinuc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("model", "code", F.round("count", 4).alias("count"))


def dinuc_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return random_model.background_model(_counts(spark, sf_dir)).select("model", "code", F.round("prob", 8).alias("prob"))


def random_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = random_model.background_model(_counts(spark, sf_dir))
    return random_model.background_scores(reads(spark, sf_dir), "seq", ["read_id"], model, "read", "score").select("read_id", F.round("score", 5).alias("score"))


def scored_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with scores made from their ids, so that SQL can follow the steps after the kernels."""
    h = exact_hits(spark, sf_dir).join(reads(spark, sf_dir).select("read_id", "name"), "read_id")
    number = lambda m, n: ((F.col("start") * m + F.col("chrom_idx") * 13 + F.col("hit_idx") * 5) % n).cast("double")
    return h.select("read_id", "name", "hit_idx", "chrom_idx", "start", "stop", "strand", "num_hits", (-40 - number(7, 9) / 4).alias("a_score"), (-45 - number(3, 8) / 4).alias("g_score"), F.lit(-47.0).alias("r_score"), (F.lit(0.5) / F.col("num_hits")).alias("prior"))


def posterior_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posterior.posteriors(scored_hits(spark, sf_dir))
    alone = posterior.posteriors(scored_hits(spark, sf_dir), ignore_unaligned=True).select("read_id", "hit_idx", F.round("posterior", 6).alias("posterior_aligned"))
    return p.select("read_id", "hit_idx", F.round("posterior", 6).alias("posterior"), F.round("unaligned", 6).alias("unaligned")).join(alone, ["read_id", "hit_idx"])


def tempered_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors as the annealing schedule tempers them in the second of five steps."""
    p = posterior.posteriors(scored_hits(spark, sf_dir), heat=em.heat_of(2, 5))
    return p.select("read_id", "hit_idx", F.round("posterior", 6).alias("posterior"), F.round("unaligned", 6).alias("unaligned"))


def em_genome_prior_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locus priors after the default number of EM iterations."""
    final = posterior.genome_prior_em(scored_hits(spark, sf_dir))
    return final.select("read_id", "hit_idx", F.round("prior", 7).alias("prior"), F.round("posterior", 6).alias("posterior"))


def prior_reestimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posterior.locus_priors(posterior.posteriors(scored_hits(spark, sf_dir)))
    return p.select(*loci.LOCUS, F.round("prior", 8).alias("prior"))


def best_hit_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = posterior.best_hits(posterior.posteriors(scored_hits(spark, sf_dir)))
    return b.select("read_id", "hit_idx", F.col("ties").cast("long").alias("ties"), "aligned")


def mapping_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posterior.posteriors(scored_hits(spark, sf_dir)).withColumn("p", F.round("posterior", 6))
    flag = sam_flag(F.col("hit_idx") == 0, F.col("strand") == "-", F.col("unaligned") <= F.col("posterior"))
    heat = F.round(temperature(F.col("hit_idx"), 10), 6)
    return p.select("read_id", "hit_idx", mapq(F.col("p")).alias("mapq"), flag.alias("flag"), heat.alias("temperature"))


def hmm_mstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions counted along paths, and the probabilities that one step of re-estimation gives them from the starting model."""
    pairs = paths_of_hits(spark, sf_dir).select(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b")).alias("t"))
    steps = pairs.select(F.explode("t").alias("t")).groupBy((F.col("t.a") * 256 + F.col("t.b")).cast("int").alias("code")).agg(F.count("*").alias("count"))
    counts = np.zeros(65536)
    for row in steps.toLocalIterator():  # 65,536 rows at most
        counts[row.code] = row["count"]
    model = hmm.reestimate(counts, hmm.initial_model())
    rows = [(int(i), int(counts[i]), round(float(model[i]), 10)) for i in np.flatnonzero(counts)]
    return spark.createDataFrame(rows, "code int, count long, prob double")


def sam_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAM lines of all reads from scores and paths made from ids: best hits with the input's quality, and reads that belong nowhere."""
    located = loci.locus_sequences(genome(spark, sf_dir), exact_hits(spark, sf_dir), longest=longest_read(spark, sf_dir)).select("read_id", "hit_idx", "locus_start")
    paths = paths_of_hits(spark, sf_dir).select("read_id", "hit_idx", "path")
    scored = posterior.posteriors(scored_hits(spark, sf_dir).drop("num_hits")).join(located, ["read_id", "hit_idx"]).join(paths, ["read_id", "hit_idx"])
    r = reads(spark, sf_dir).withColumn("mapq", (F.col("read_id") * 11 % 60).cast("int")).withColumn("qual", F.translate("seq", "ACGT", "!5?I"))
    return realign.records(scored, genome(spark, sf_dir), r)


def length_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of any length, and loci cut short by five bases on both sides, that the model doesn't take."""
    located = loci.locus_sequences(genome(spark, sf_dir), exact_hits(spark, sf_dir), -5, longest_read(spark, sf_dir))
    return em.rejected(located, reads(spark, sf_dir, 1))


def training_reads_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads that the model is trained on."""
    return training_reads(spark, sf_dir)


def gathered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, r = genome(spark, sf_dir), reads(spark, sf_dir)
    return realign.prepare(g, r, loci.hits_of(seeding.search(g, r)))


def hmm_forward_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward and background scores of all hits under the starting model."""
    return em.score_hits(spark, gathered_hits(spark, sf_dir), hmm.initial_model()).select("read_id", "hit_idx", F.round("a_score", 5).alias("a_score"), F.round("g_score", 5).alias("g_score"))


def hmm_viterbi_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best alignments of all hits under the starting model, rendered."""
    s = em.score_hits(spark, gathered_hits(spark, sf_dir), hmm.initial_model(), paths=True)
    return s.select("read_id", "hit_idx", F.round("v_score", 5).alias("v_score"), alignments.rendered("path").alias("r")).select("read_id", "hit_idx", "v_score", "r.*")


def em_sequence_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits scored and weighed after the sequence model is fitted."""
    g, r = genome(spark, sf_dir), training_reads(spark, sf_dir)
    done = realign.realign(spark, g, r, loci.hits_of(seeding.search(g, r)), realign.Settings(genome_priors=False))["scored_alone"]
    return done.select("read_id", "hit_idx", F.round("a_score", 4).alias("a_score"), F.round("posterior", 5).alias("posterior"), F.round("unaligned", 5).alias("unaligned"))


def em_genome_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locus priors after EM over the hits with scores made from ids."""
    final = posterior.genome_prior_em(scored_hits(spark, sf_dir), 2)
    return final.select("read_id", "hit_idx", F.round("prior", 7).alias("prior"), F.round("posterior", 6).alias("posterior"))


def realigned_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAM lines of all reads after search, both models and the choice of the best hit."""
    g, r = genome(spark, sf_dir), training_reads(spark, sf_dir)
    done = realign.realign(spark, g, r, loci.hits_of(seeding.search(g, r)))
    return realign.lines_of(done["best"], g, r)


PAIRS_SQL = f"""{LOCI_SQL},
located AS (SELECT l.*, w.weight FROM loci l JOIN weights w USING (chrom_idx, start, stop, strand)),
units AS (SELECT 'genome' AS model, locus AS s, weight FROM located UNION ALL
  SELECT 'read', any_value(seq), max(weight) FROM located GROUP BY read_id),
counts AS (SELECT model, CAST((instr('ACGT', substr(s, CAST(i AS BIGINT), 1)) - 1) * 5 + instr('ACGT', substr(s, CAST(i + 1 AS BIGINT), 1)) - 1 AS INTEGER) AS code, sum(weight) AS count
  FROM (SELECT model, s, weight, unnest(range(1, length(s))) AS i FROM units) GROUP BY ALL),
model AS (SELECT model, code, count / sum(count) OVER (PARTITION BY model, code // 5) AS prob
  FROM (SELECT m.model, CAST(c.code AS INTEGER) AS code, coalesce(counts.count, 0) + 10 AS count FROM (SELECT DISTINCT model FROM counts) m CROSS JOIN range(25) c(code) LEFT JOIN counts ON counts.model = m.model AND counts.code = c.code))"""
SCORED_TAIL = """scored AS (SELECT read_id, name, hit_idx, chrom_idx, start, stop, strand, num_hits, -40 - ((start * 7 + chrom_idx * 13 + hit_idx * 5) % 9) / 4.0::DOUBLE AS a, -45 - ((start * 3 + chrom_idx * 13 + hit_idx * 5) % 8) / 4.0::DOUBLE AS g FROM exact)"""
SCORED_SQL = f"{LOCI_SQL},\n{SCORED_TAIL}"


def _posterior_sql(name: str, source: str, prior: str, heat: str = "1", how: str = "") -> str:
    return f"""{name}_x AS {how} (SELECT *, {heat} * (a - g + ln({prior} / sum({prior}) OVER (PARTITION BY read_id) * 0.5)) AS x, {heat} * (-47 + ln(0.5::DOUBLE)) AS u FROM {source}),
{name}_e AS (SELECT *, exp(x - greatest(max(x) OVER (PARTITION BY read_id), u)) AS e, exp(u - greatest(max(x) OVER (PARTITION BY read_id), u)) AS n FROM {name}_x),
{name} AS {how} (SELECT *, e / (sum(e) OVER (PARTITION BY read_id) + n) AS posterior, n / (sum(e) OVER (PARTITION BY read_id) + n) AS unaligned, e / sum(e) OVER (PARTITION BY read_id) AS posterior_aligned FROM {name}_e)"""


POSTERIOR_SQL = f"{SCORED_SQL}, {_posterior_sql('p0', 'scored', '(0.5::DOUBLE / num_hits)')}"


def _prior_em_sql(rounds: int, how: str = "") -> str:
    parts = [POSTERIOR_SQL]
    for i in range(rounds):
        parts.append(f"m{i} AS (SELECT chrom_idx, start, stop, strand, (sum(posterior) + 10) / sum(sum(posterior) + 10) OVER () AS prior FROM p{i} GROUP BY ALL)")
        parts.append(f"s{i} AS (SELECT s.*, m.prior FROM scored s JOIN m{i} m USING (chrom_idx, start, stop, strand))")
        parts.append(_posterior_sql(f"p{i + 1}", f"s{i}", "prior", how=how))
    return ", ".join(parts)


DIGEST_SQL = """t AS (SELECT read_id, hit_idx, hit_idx || name || start || stop || chr(10) AS t FROM exact),
c AS (SELECT read_id, hit_idx, length(t) AS n, i, ascii(substr(t, CAST(i AS BIGINT), 1)) AS b FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM t)),
adler AS (SELECT read_id, hit_idx, ((max(n) + sum((n - i + 1) * b)) % 65521) * 65536 + (1 + sum(b)) % 65521 AS adler FROM c GROUP BY read_id, hit_idx)"""

QUERIES = {
    f.__name__: f
    for f in (dinuc_counts, dinuc_model, random_score, posterior_softmax, prior_reestimate, best_hit_tiebreak, mapping_quality, hmm_forward_score, hmm_viterbi_path, em_sequence_model, em_genome_prior, realigned_sam, hmm_mstep, sam_records, length_rejects, training_reads_places, tempered_posterior, em_genome_prior_whole)
}

BEST_SQL = """n AS (SELECT *, max(posterior) OVER (PARTITION BY read_id) - posterior < 1e-4 AS tied FROM p0 JOIN adler USING (read_id, hit_idx)),
k AS (SELECT *, sum(CAST(tied AS INTEGER)) OVER (PARTITION BY read_id) AS ties FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY CASE WHEN ties >= 3 AND tied THEN 1 ELSE 0 END DESC, CASE WHEN ties >= 3 AND tied THEN adler ELSE 0 END DESC, posterior DESC, hit_idx) AS i FROM k)"""
START_SQL = ", ".join(f"({16 * i + j}, {float(v)}::DOUBLE)" for i, row in enumerate(hmm.START) for j, v in enumerate(row))
MSTEP_SQL = f"""WITH {PATHS_SQL},
symbols AS (SELECT read_id, hit_idx, row_number() OVER (PARTITION BY read_id, hit_idx ORDER BY o, d) AS p, CASE WHEN r = '-' THEN 5 ELSE instr('ACGT', r) - 1 END * 16 + CASE WHEN b = '-' THEN 5 ELSE instr('ACGT', b) - 1 END AS s FROM cols),
moves AS (SELECT s AS c1, lead(s) OVER (PARTITION BY read_id, hit_idx ORDER BY p) AS c2 FROM symbols),
counts AS (SELECT c1, c2, count(*) AS n FROM moves WHERE c2 IS NOT NULL GROUP BY c1, c2),
firsts(c2, w) AS (VALUES {START_SQL}),
ends AS (SELECT CAST(range AS INTEGER) AS c2, coalesce(w, 1.0) AS w FROM range(256) LEFT JOIN firsts ON firsts.c2 = range),
begins AS (SELECT c2, (1 + 2570 * w) / sum(1 + 2570 * w) OVER () AS p FROM ends)
SELECT CAST(c1 * 256 + c2 AS INTEGER) AS code, n AS count, round((n + 2570 * p) / (sum(n) OVER (PARTITION BY c1) + 2570), 10) AS prob FROM counts JOIN begins USING (c2)"""
RECORDS_SQL = f"""WITH {PATHS_SQL}, {SCORED_TAIL}, {_posterior_sql("p0", "scored", "(0.5::DOUBLE / num_hits)")}, {DIGEST_SQL}, {BEST_SQL},
quals AS (SELECT *, translate(seq, 'ACGT', '!5?I') AS q FROM reads),
best AS (SELECT r.*, l.locus_start, g.chrom, q.seq, q.q, nms.add, nms.nm, cigar, md, CAST(floor(-10 * log10(greatest(1 - posterior, 1e-4)) + 0.5) AS INTEGER) AS mapq
  FROM r JOIN loci l USING (read_id, hit_idx) JOIN genome g ON g.chrom_idx = r.chrom_idx JOIN quals q ON q.read_id = r.read_id JOIN nms ON nms.read_id = r.read_id AND nms.hit_idx = r.hit_idx
  JOIN cigars ON cigars.read_id = r.read_id AND cigars.hit_idx = r.hit_idx JOIN mds ON mds.read_id = r.read_id AND mds.hit_idx = r.hit_idx WHERE i = 1 AND unaligned <= posterior)
SELECT chrom_idx, CAST(locus_start + add + 1 AS BIGINT) AS pos, concat_ws(chr(9), name, CASE WHEN strand = '-' THEN '16' ELSE '0' END, chrom, CAST(locus_start + add + 1 AS VARCHAR), CAST(CASE WHEN num_hits = 1 THEN least(mapq, read_id * 11 % 60) ELSE mapq END AS VARCHAR), cigar, '*', '0', '0',
  CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END, CASE WHEN strand = '-' THEN reverse(q) ELSE q END, 'NM:i:' || nm, 'MD:Z:' || md) AS line FROM best
UNION ALL SELECT NULL, NULL, concat_ws(chr(9), name, '4', '*', '0', '0', '*', '*', '0', '0', seq, q) FROM quals WHERE read_id NOT IN (SELECT read_id FROM best)"""

ORACLE_SQL = {
    "hmm_mstep": MSTEP_SQL,
    "sam_records": RECORDS_SQL,
    "length_rejects": f"""WITH {LOCI_SQL}, own AS (SELECT item_id AS read_id, length(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS n FROM benchmark),
short AS (SELECT read_id, hit_idx, greatest(least(stop - 5, length(chrom_seq)) - greatest(start + 5, 0), 0) AS n FROM cut)
SELECT read_id, CAST(NULL AS INTEGER) AS hit_idx, CAST(n AS INTEGER) AS length, 'read of fewer than 11 bases' AS reason FROM own WHERE n BETWEEN 1 AND 10
UNION ALL SELECT read_id, CAST(hit_idx AS INTEGER), CAST(n AS INTEGER), 'locus of fewer than 11 bases' FROM short WHERE n < 11""",
    "training_reads_places": f"""WITH {GENOME_SQL}, {READS_SQL}, w AS (SELECT chrom_idx, seq, unnest(range(0, (seq_len - 30) // 200 + 1)) AS i FROM genome WHERE seq_len >= 30)
SELECT read_id, name, seq, qual FROM reads
UNION ALL SELECT (chrom_idx + 1) * 16777216 + i, 'DOC' || chrom_idx || '_' || i * 200 || CASE WHEN i % 2 = 1 THEN '_-' ELSE '_+' END,
  CASE WHEN i % 2 = 1 THEN reverse(translate(substr(seq, i * 200 + 1, 30), 'ACGT', 'TGCA')) ELSE substr(seq, i * 200 + 1, 30) END, '*' FROM w""",
    "dinuc_counts": f"WITH {PAIRS_SQL} SELECT model, code, round(count, 4) AS count FROM counts",
    "dinuc_model": f"WITH {PAIRS_SQL} SELECT model, code, round(prob, 8) AS prob FROM model",
    "random_score": f"""WITH {PAIRS_SQL}, q AS (SELECT read_id, CAST((instr('ACGT', substr(seq, CAST(i AS BIGINT), 1)) - 1) * 5 + instr('ACGT', substr(seq, CAST(i + 1 AS BIGINT), 1)) - 1 AS INTEGER) AS code FROM (SELECT read_id, seq, unnest(range(1, length(seq))) AS i FROM reads))
SELECT read_id, round(sum(ln(prob)), 5) AS score FROM q JOIN model ON model.model = 'read' AND model.code = q.code GROUP BY read_id""",
    "posterior_softmax": f"WITH {POSTERIOR_SQL} SELECT read_id, hit_idx, round(posterior, 6) AS posterior, round(unaligned, 6) AS unaligned, round(posterior_aligned, 6) AS posterior_aligned FROM p0",
    "tempered_posterior": f"WITH {SCORED_SQL}, {_posterior_sql('p0', 'scored', '(0.5::DOUBLE / num_hits)', 'log10(2 / 5.0::DOUBLE * 9 + 1)')} SELECT read_id, hit_idx, round(posterior, 6) AS posterior, round(unaligned, 6) AS unaligned FROM p0",
    "em_genome_prior_whole": f"WITH {_prior_em_sql(6, 'MATERIALIZED')} SELECT read_id, hit_idx, round(s5.prior, 7) AS prior, round(posterior, 6) AS posterior FROM p6 JOIN s5 USING (read_id, hit_idx)",
    "prior_reestimate": f"WITH {_prior_em_sql(1)} SELECT chrom_idx, start, stop, strand, round(prior, 8) AS prior FROM m0",
    "best_hit_tiebreak": f"""WITH {POSTERIOR_SQL}, {DIGEST_SQL}, {BEST_SQL}
SELECT read_id, hit_idx, CAST(ties AS BIGINT) AS ties, unaligned <= posterior AS aligned FROM r WHERE i = 1""",
    "mapping_quality": f"""WITH {POSTERIOR_SQL} SELECT read_id, hit_idx, CAST(floor(-10 * log10(greatest(1 - round(posterior, 6), 1e-4)) + 0.5) AS INTEGER) AS mapq,
  CASE WHEN unaligned > posterior THEN 4 ELSE (CASE WHEN hit_idx = 0 THEN 0 ELSE 256 END) + (CASE WHEN strand = '-' THEN 16 ELSE 0 END) END AS flag, round(log10(hit_idx / 10.0::DOUBLE * 9 + 1), 6) AS temperature FROM p0""",
    "em_genome_prior": f"WITH {_prior_em_sql(3)} SELECT read_id, hit_idx, round(s2.prior, 7) AS prior, round(posterior, 6) AS posterior FROM p3 JOIN s2 USING (read_id, hit_idx)",
}
