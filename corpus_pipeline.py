"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the rows are written and read again, so every stage has plain stored input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.llm import bpe, line_dedup, mixing, near_dedup, quality
from seqlattice.llm.scratch import Scratch
from seqlattice.session import ship


def _nested(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` as one column __row and a copy of each of ``names`` (null where it lacks one), so that operators' columns meet none of the caller's."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), *[docs[n] if n in docs.columns else F.lit(None).cast("string").alias(n) for n in names])


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade reaches one half.

    Null and empty texts have no warning signs and get what the thresholds
    alone say. Repeated rows are judged alike and stay; an empty table stays
    empty; without labels all documents stay. All columns of ``docs`` and no
    others come out, whatever their names.
    """
    rated = quality.classify(ship(spark), _nested(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rated.where("selected").select("__row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without blocks of lines that an earlier one (smaller doc_id) holds; those of which nothing is left go.

    n_chars, where there is such a column, follows the text. Null and empty texts stay as they are, and so
    do rows without doc_id. Rows repeated with one id and text lose the same
    lines; unlike texts under one id are documents of their own.
    """
    freed = line_dedup.dedup_lines(ship(spark), _nested(docs, "doc_id", "text"))
    left = freed.where((F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("__row.n_chars") if "n_chars" in docs.columns else None)}
    return left.select(*[new[c].alias(c) if c in new else F.col(f"__row.`{c}`") for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (that of the smallest doc_id) of each group of near-duplicates (five words, similarity 0.8).

    Null and wordless texts are in no group and stay, and so do rows without
    doc_id. Rows repeated with one id and text become one, the smallest by
    their other columns; unlike texts under one id stay or go together.
    """
    found = near_dedup.near_duplicates(ship(spark), docs.select("doc_id", "text"), k=5, percent=80)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    left = _nested(docs, "doc_id", "text").join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    others = F.to_json(F.struct(*[F.col(f"__row.`{c}`") for c in docs.columns if c != "text"]))  # maps have no order of their own
    named = left.where("doc_id IS NOT NULL").groupBy("doc_id", F.xxhash64("text").alias("__text")).agg(F.min_by("__row", others).alias("__row"))
    return named.select("__row.*").unionByName(left.where("doc_id IS NULL").select("__row.*"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics meet their target shares.

    Null source and language are kinds of their own, and so is a missing
    column; null and wordless texts weigh nothing and stay. Each row falls by its id and text: rows without id
    by their text alone, repeated rows alike.
    """
    rows = _nested(docs, "doc_id", "text", "source", "lang")
    chosen = mixing.mix_sources(ship(spark), rows.drop("__row")).where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__key")).distinct()
    return rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("__gone")) & (F.xxhash64("text") == F.col("__key")), "left_anti").select("__row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of what they decode to.

    One row for each row of ``docs``, repeated ones too; null text counts as
    empty and has no tokens.
    """
    coded = bpe.encode_texts(ship(spark), _nested(docs, "doc_id", "lang", "source", "text"), public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", reject_poor),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", keep_one_of_each_group),
    ("mixing", mix_to_targets),
    ("byte-level BPE", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents table under ``sf_dir``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
