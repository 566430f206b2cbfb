"""Queries of the simulator and of the evaluation against the truth in names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import error_rate
from ..operators import evaluate, loci, posterior, seeding, simulate
from ..session import scratch_path, stored
from ..sources.fixtures import GENOME_SQL, genome
from ..sources.formats import parse_sam_lines, parse_truth, placements, with_dcode
from . import realign

EACH = 4  # simulated reads for each chromosome on average


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chromosome as a region, strands in turn."""
    return genome(spark, sf_dir).select("chrom_idx", "chrom", F.lit(0).cast("long").alias("start"), F.col("seq_len").cast("long").alias("stop"), F.when(F.col("chrom_idx") % 2 == 0, "+").otherwise("-").alias("strand"))


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.draw(_regions(spark, sf_dir).withColumn("n", F.lit(EACH).cast("long")), genome=genome(spark, sf_dir))


def sim_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = _regions(spark, sf_dir).select("chrom_idx")
    return simulate.abundances(regions, 10_000).select("chrom_idx", F.col("rank").cast("long").alias("rank"), F.round("weight", 6).alias("weight"), "n")


def sim_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = genome(spark, sf_dir).select("chrom_idx", F.col("seq_len").alias("len"))
    at = rows.select("chrom_idx", "len", F.explode(F.sequence(F.lit(1), F.col("len"))).alias("j"))
    return at.select("chrom_idx", "j", F.round(error_rate(F.col("j"), F.col("len"), 0.02, 0.03), 12).alias("rate"))


def sim_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.mutate(_drawn(spark, sf_dir), first=0.1, last=0.3).select("read_id", "name", "seq", "errors")


def truth_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = simulate.mutate(_drawn(spark, sf_dir), first=0.1, last=0.3).select("read_id", "name")
    return names.select("read_id", *[c.alias(k) for k, c in parse_truth(F.col("name")).items()])


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated reads with placements made from their ids: some shifted, some elsewhere, some unmapped."""
    s = simulate.mutate(_drawn(spark, sf_dir), first=0.1, last=0.3)
    shift = F.col("read_id") % 13 - 6
    chrom = F.when(F.col("read_id") % 11 == 0, F.lit(None)).when(F.col("read_id") % 17 == 0, "doc_x").otherwise(F.col("chrom"))
    return s.select("name", chrom.alias("chrom"), (F.col("start") + shift).alias("start"), (F.col("stop") + shift).alias("stop"), F.when(F.col("read_id") % 19 == 0, "+").otherwise(F.col("strand")).alias("strand"), ((F.col("read_id") * 7) % 70).cast("int").alias("mapq"))


def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_placed(spark, sf_dir))


def eval_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_quality(_placed(spark, sf_dir))


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(_placed(spark, sf_dir))


def eval_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_bucket(_placed(spark, sf_dir))


def eval_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mapped_above(_placed(spark, sf_dir))


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide row under a file name that carries the settings, appended twice to a folder of tab-separated files and read again."""
    file = "aln.DCODE0000000805050A0A.sam"
    label = with_dcode(spark.range(1).select(F.lit(file).alias("file")), "file")
    row, path = stored(evaluate.report(_placed(spark, sf_dir), label)), scratch_path(spark)  # judged once, appended twice
    for _ in range(2):
        evaluate.append_report(row, path)
    return spark.read.option("header", True).option("sep", "\t").schema(row.schema).csv(path)


def eval_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placements as SAM lines of three runs, whose names tell their settings, written by run and judged in one scan: a wide row a run."""
    run = parse_truth(F.col("name"))["n"] % 3
    file = F.concat(F.lit("aln"), run.cast("string"), F.lit(".DCODE000000080505"), F.lpad(F.hex(run), 2, "0"), F.lit("0A.sam"))
    mapped, text = F.col("chrom").isNotNull(), lambda c: c.cast("string")
    flag = F.when(~mapped, "4").when(F.col("strand") == "-", "16").otherwise("0")
    pos = F.when(mapped, text(F.col("start") + 1)).otherwise("0")
    cigar = F.when(mapped, F.concat(text(F.col("stop") - F.col("start")), F.lit("M"))).otherwise("*")
    line = F.concat_ws("\t", "name", flag, F.coalesce("chrom", F.lit("*")), pos, text(F.col("mapq")), cigar, F.lit("*\t0\t0\t*\t*"))
    path = scratch_path(spark)
    _placed(spark, sf_dir).select(line.alias("value"), file.alias("file")).write.partitionBy("file").text(path)
    placed = placements(parse_sam_lines(spark.read.text(path), "file"), "file")
    return with_dcode(evaluate.file_reports(placed), "file")


def closed_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulate, search, re-align and evaluate: the accuracy of best hits by quality."""
    g = genome(spark, sf_dir)
    r = realign.stored(simulate.mutate(_drawn(spark, sf_dir)).select("read_id", "name", "seq", "qual"))
    done = realign.realign(spark, g, r, loci.hits_of(seeding.search(g, r)))
    best = posterior.best_hits(done.get("with_priors_alone", done["with_priors"])).join(g.select("chrom_idx", "chrom"), "chrom_idx")
    from ..functions.scores import mapq

    placed = best.select("name", F.when(F.col("aligned"), F.col("chrom")).alias("chrom"), "start", "stop", "strand", mapq(F.col("posterior")).alias("mapq"))
    return evaluate.by_quality(placed)


def _chance(*counters: str) -> str:
    h = "CAST(17 AS BIGINT)"
    for c in counters:
        h = f"((({h} + ({c}) % 2147483647) % 2147483647 * 48271 + 11) % 2147483647)"
    return f"({h} * 16807 % 2147483647)"


DRAWN_SQL = f"""{GENOME_SQL},
places AS (SELECT chrom_idx, chrom, seq AS chrom_seq, seq_len, CASE WHEN chrom_idx % 2 = 0 THEN '+' ELSE '-' END AS strand, unnest(range(1, {EACH + 1})) AS i FROM genome WHERE seq_len >= 30),
drawn AS (SELECT *, start + 30 AS stop, CASE WHEN strand = '-' THEN reverse(translate(substr(chrom_seq, start + 1, 30), 'ACGT', 'TGCA')) ELSE substr(chrom_seq, start + 1, 30) END AS seq
  FROM (SELECT *, {_chance("chrom_idx", "i")} % (seq_len - 30 + 1) AS start FROM places))"""
MUTATED_SQL = f"""{DRAWN_SQL},
u AS (SELECT chrom_idx, chrom, i, start, stop, strand, j, substr(seq, CAST(j AS BIGINT), 1) AS base,
   {_chance("chrom_idx", "i", "j", "1")} / 2147483647.0::DOUBLE <= 0.1::DOUBLE + (0.3::DOUBLE - 0.1::DOUBLE) / 29 * (j - 1) AS wrong, {_chance("chrom_idx", "i", "j", "2")} / 2147483647.0::DOUBLE AS u2,
   {_chance("chrom_idx", "i", "j", "3")} % 3 AS k3, {_chance("chrom_idx", "i", "j", "4")} / 2147483647.0::DOUBLE AS u4, {_chance("chrom_idx", "i", "j", "5")} % 4 AS k5
   FROM (SELECT *, unnest(range(1, 31)) AS j FROM drawn)),
pieces AS (SELECT *, CASE WHEN NOT wrong THEN base WHEN u2 <= 0.8 THEN substr('ACGT', (instr('ACGT', base) + k3) % 4 + 1, 1) WHEN u4 <= 0.5 THEN substr('ACGT', k5 + 1, 1) || base ELSE '' END AS s FROM u),
sim AS (SELECT chrom_idx * 1000000 + i AS read_id, chrom, start, stop, strand, string_agg(s, '' ORDER BY j) AS seq, CAST(sum(CAST(wrong AS INTEGER)) AS INTEGER) AS errors FROM pieces GROUP BY chrom_idx, i, chrom, start, stop, strand),
named AS (SELECT *, concat_ws('_', 'ORG' || read_id, chrom, start, stop, strand, errors) AS name FROM sim)"""
JUDGED_SQL = f"""{MUTATED_SQL},
placed AS (SELECT *, CASE WHEN read_id % 11 = 0 THEN NULL WHEN read_id % 17 = 0 THEN 'doc_x' ELSE chrom END AS chrom2, read_id % 13 - 6 AS shift, CASE WHEN read_id % 19 = 0 THEN '+' ELSE strand END AS strand2, (read_id * 7) % 70 AS mapq FROM named),
judged AS (SELECT read_id, CAST(least(mapq // 10, 5) AS INTEGER) AS q, least(errors, 5) AS e, chrom2 IS NOT NULL AS mapped, CASE WHEN chrom2 IS NOT NULL THEN chrom2 = chrom AND strand2 = strand AND abs(shift) < 5 END AS correct FROM placed)"""

QUERIES = {f.__name__: f for f in (sim_abundance, sim_error_rate, sim_reads, truth_parse, eval_confusion, eval_by_quality, eval_summary, eval_buckets, eval_above, eval_report, eval_folder, closed_loop)}

ORACLE_SQL = {
    "sim_abundance": f"""WITH {GENOME_SQL}, r AS (SELECT chrom_idx, row_number() OVER (ORDER BY {_chance("chrom_idx")} % 1009, chrom_idx) AS rank, count(*) OVER () AS regions FROM genome),
w AS (SELECT *, rank / pow(rank::DOUBLE, 1.2 + (rank % (regions + 1)) / regions::DOUBLE) AS weight FROM r),
n AS (SELECT *, CAST(floor(weight / sum(weight) OVER () * 10000) AS BIGINT) AS n0 FROM w)
SELECT chrom_idx, rank, round(weight, 6) AS weight, CAST(n0 + CASE WHEN rank <= 10000 - sum(n0) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n FROM n""",
    "sim_error_rate": f"""WITH {GENOME_SQL}, l AS (SELECT chrom_idx, seq_len AS len FROM genome)
SELECT chrom_idx, CAST(j AS INTEGER) AS j, round(0.02::DOUBLE + (0.03::DOUBLE - 0.02::DOUBLE) / (len - 1) * (j - 1), 12) AS rate FROM (SELECT chrom_idx, len, unnest(range(1, len + 1)) AS j FROM l)""",
    "sim_reads": f"WITH {MUTATED_SQL} SELECT read_id, name, seq, errors FROM named",
    "truth_parse": f"WITH {MUTATED_SQL} SELECT read_id, read_id AS n, chrom, start, stop, strand, errors FROM named",
    "eval_confusion": f"WITH {JUDGED_SQL} SELECT q, e, correct, count(*) AS n FROM judged WHERE mapped GROUP BY ALL",
    "eval_by_quality": f"""WITH {JUDGED_SQL}, s AS (SELECT q, count(*) FILTER (correct) AS n_correct, count(*) FILTER (NOT correct) AS n_wrong FROM judged WHERE mapped GROUP BY q)
SELECT q, n_correct, n_wrong, CAST(CASE WHEN n_wrong = 0 THEN 100 ELSE floor(-10 * log10(n_wrong / (n_correct + n_wrong)::DOUBLE)) END AS INTEGER) AS empirical FROM s""",
    "eval_buckets": f"""WITH {JUDGED_SQL}, s AS (SELECT q, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct) AS wrong, {", ".join(f"count(*) FILTER (e = {i}) AS errors_{i}" for i in range(6))} FROM judged WHERE mapped GROUP BY q),
b AS (SELECT CAST(range AS INTEGER) AS bucket, * FROM range(6) LEFT JOIN s ON s.q = range)
SELECT bucket, CAST(bucket * 10 AS INTEGER) AS quality, coalesce(correct, 0) AS correct, coalesce(wrong, 0) AS wrong, CAST(CASE WHEN coalesce(wrong, 0) = 0 THEN 100 ELSE floor(-10 * log10(wrong / (correct + wrong)::DOUBLE)) END AS INTEGER) AS estimate, {", ".join(f"coalesce(errors_{i}, 0) AS errors_{i}" for i in range(6))} FROM b""",
    "eval_above": f"""WITH {JUDGED_SQL}, s AS (SELECT count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct) AS wrong FROM judged WHERE mapped AND q >= 1)
SELECT correct, wrong, round(1e4::DOUBLE * wrong / correct) / 100 AS percent_wrong FROM s""",
    "eval_report": f"""WITH {JUDGED_SQL} SELECT 'aln.DCODE0000000805050A0A.sam' AS file, 8 AS threads, 5 AS siter, 5 AS giter, 10 AS spseudo, 10 AS gpseudo,
{", ".join(f"count(*) FILTER (mapped AND q = {i} AND correct) AS correct_Q{i}, count(*) FILTER (mapped AND q = {i} AND NOT correct) AS wrong_Q{i}" for i in range(6))},
{", ".join(f"count(*) FILTER (mapped AND q = {i} AND e = {j}) AS Q{i}_E{j}" for i in range(6) for j in range(6))} FROM judged, range(2) GROUP BY range""",
    "eval_folder": f"""WITH {JUDGED_SQL} SELECT 'aln' || run || '.DCODE000000080505' || printf('%02X', run) || '0A.sam' AS file, 8 AS threads, 5 AS siter, 5 AS giter, CAST(run AS INTEGER) AS spseudo, 10 AS gpseudo, count(*) AS total, count(*) FILTER (mapped) AS mapped,
{", ".join(f"count(*) FILTER (mapped AND q = {i} AND correct) AS correct_Q{i}, count(*) FILTER (mapped AND q = {i} AND NOT correct) AS wrong_Q{i}" for i in range(6))},
{", ".join(f"count(*) FILTER (mapped AND q = {i} AND e = {j}) AS Q{i}_E{j}" for i in range(6) for j in range(6))} FROM (SELECT *, read_id % 3 AS run FROM judged) GROUP BY run""",
    "eval_summary": f"""WITH {JUDGED_SQL}, s AS (SELECT count(*) AS total, count(*) FILTER (mapped) AS mapped, count(*) FILTER (mapped AND NOT correct) AS wrong FROM judged)
SELECT total, mapped, total - mapped AS unmapped, round(100.0::DOUBLE * mapped / total) AS percent_mapped, round(1e4::DOUBLE * wrong / total) / 100 AS percent_wrong FROM s""",
}
