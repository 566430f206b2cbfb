"""A genome and reads derived from the given tables: documents are chromosomes, benchmark passages are reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import reverse_complement
from ..operators.tiles import cut
from ..session import spread


def _bases(text: str, least: int):
    """The upper-cased bases of a text as an array of one, or of none if there are fewer than ``least``; exploding it evaluates the text once."""
    seq = F.upper(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^ACGTacgt]+", ""))
    return F.filter(F.array(seq), lambda s: F.length(s) >= least)


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom_idx, chrom, seq, seq_len of the documents that hold 32 bases or more; shorter ones are no chromosomes."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chrom_idx"), "text"))
    rows = docs.select("chrom_idx", F.explode(_bases("text", 32)).alias("seq"))
    return rows.select("chrom_idx", F.concat(F.lit("doc"), F.col("chrom_idx").cast("string")).alias("chrom"), "seq", F.length("seq").alias("seq_len"))


def reads(spark: SparkSession, sf_dir: str, least: int = 15) -> DataFrame:
    """read_id, name, seq, qual of the benchmark passages that hold ``least`` bases or more; shorter ones are no reads."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("read_id"), F.explode(_bases("text", least)).alias("seq"))
    return rows.select("read_id", F.concat(F.lit("READ"), F.col("read_id").cast("string")).alias("name"), "seq", F.lit("*").alias("qual"))


def training_reads(spark: SparkSession, sf_dir: str, length: int = 30, step: int = 200) -> DataFrame:
    """reads(), and ``length`` bases of every chromosome from each ``step``-th base on, of both strands in turn: enough for the model to learn from.

    Names of the latter are DOC<chromosome>_<start>_<strand>.
    """
    cuts = genome(spark, sf_dir).select("chrom_idx", "chrom", F.posexplode(cut("seq", step, length)).alias("i", "part"))
    cuts = cuts.where(F.length("part") >= length).withColumn("minus", F.col("i") % 2 == 1)
    plus = F.substring("part", F.lit(1), F.lit(length))
    seq = F.when(F.col("minus"), reverse_complement(plus)).otherwise(plus)
    number = (F.col("chrom_idx") + 1) * (1 << 24) + F.col("i")
    name = F.concat(F.lit("DOC"), F.col("chrom_idx").cast("string"), F.lit("_"), (F.col("i") * step).cast("string"), F.when(F.col("minus"), "_-").otherwise("_+"))
    return reads(spark, sf_dir).unionByName(cuts.select(number.alias("read_id"), name.alias("name"), seq.alias("seq"), F.lit("*").alias("qual")))


GENOME_SQL = """genome AS (SELECT doc_id AS chrom_idx, 'doc' || doc_id AS chrom, seq, length(seq) AS seq_len
  FROM (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM documents) WHERE length(seq) >= 32)"""
READS_SQL = """reads AS (SELECT item_id AS read_id, 'READ' || item_id AS name, seq, '*' AS qual
  FROM (SELECT item_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM benchmark) WHERE length(seq) >= 15)"""
