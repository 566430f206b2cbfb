"""SimHash fingerprints, edits against the next document, and permuted block tables; DataFrame functions only.

Terms are pairs of neighbouring words, weighted by the length of their first
word. Each term's 64-bit hash votes with its weight for or against every bit.
Two counters of 32 bits share a long, so 32 sums hold all 64 votes and stay in
generated code; words are exploded straight into a partial aggregation that
ends with one row a text. Documents meet their successor in one range-bucketed
window; only the first document of a bucket is sent twice.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

BITS, BLOCKS, RADIUS, TABLE_CHUNK = 64, 6, 3, 128
LOWEST = -(1 << 63)
SEPARATORS = r"[\x20\x09-\x0D]+"


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """The bits of each table's key: every choice of ``blocks - radius`` of the blocks; two fingerprints within the radius agree on one of them."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [_signed(sum(x)) for x in itertools.combinations(block, blocks - radius)]


def fingerprints(texts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``keys`` and ``fp`` (long), one row for each distinct ``keys``; equal texts have equal fingerprints. Texts must not be null."""
    words = texts.select(*keys, F.split(F.lower(column), SEPARATORS).alias("__words"))
    # generated code splits and explodes in one loop and keeps the words for the look at the next one; pairs made before, by zip_with, cost half as much again
    words = words.select(*keys, F.posexplode("__words").alias("__pos", "__word"), "__words")
    weight = F.length("__word").cast("long")
    hashed = F.xxhash64("__word", F.get("__words", F.col("__pos") + 1))
    terms = words.select(*keys, weight.alias("__w"), hashed.alias("__h"))
    pair = F.lit((1 << 32) + 1)
    votes = [F.sum(F.shiftrightunsigned("__h", i).bitwiseAND(pair) * F.col("__w")).alias(f"__v{i}") for i in range(32)]
    voted = terms.groupBy(*keys).agg(F.sum("__w").alias("__all"), *votes)
    fp = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"__v{i}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"__v{i}", 32)
        for count, bit in ((low, i), (high, i + 32)):
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("__all"), F.lit(_signed(1 << bit))).otherwise(F.lit(0).cast("long")))
    return voted.select(*keys, fp.alias("fp"))


def cut_number(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are smaller than ``key``: first among every so many of them, then inside one stretch, so that a row meets about twice their root."""
    step = max(1, math.isqrt(len(cuts)))
    longs = lambda x: F.array(*[F.lit(c) for c in x]).cast("array<bigint>")
    stretches = F.array(*[longs(cuts[i : i + step]) for i in range(0, max(1, len(cuts)), step)])
    smaller = lambda x: F.size(F.filter(x, lambda c: c < key))
    whole = smaller(longs(cuts[step - 1 :: step]))  # stretches whose last cut is smaller
    return whole * step + smaller(F.coalesce(F.get(stretches, whole), longs([])))


def with_next(docs: DataFrame) -> DataFrame:
    """Each document with the text of the next one by descending doc_id; the first follows the last.

    Columns: bucket, pos, guest, doc_id, text, next. Ids are cut into as many
    ranges as three times the shuffle partitions, each a window of its own;
    guest rows repeat the first document of the range that follows. Null ids
    come last; rows of one id go by text.
    """
    spark = docs.sparkSession
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"))
    parts = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = df.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 10 * parts).alias("q")).first().q or []
    cuts = sorted(set(at))
    df = df.withColumn("bucket", cut_number(F.col("key"), cuts))
    heads = df.groupBy("bucket").agg(F.max("key").alias("key")).orderBy(F.desc("bucket")).collect()  # as many rows as ranges
    guests = [(heads[(i + 1) % len(heads)].key, heads[i].bucket) for i in range(len(heads))]
    guests = spark.createDataFrame(guests, "head long, host int")
    twice = df.join(F.broadcast(guests), F.col("key") == F.col("head"), "left")
    own, other = F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    sent = F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, other)))
    dealt = twice.select("doc_id", "key", "text", sent.alias("to")).select("doc_id", "key", "text", "to.*")
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), "text")
    return dealt.select("bucket", F.row_number().over(order).alias("pos"), "guest", "doc_id", "text", F.lead("text").over(order).alias("next"))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n / 3) code points replaced by the first as many of ``following``."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(F.coalesce(following, F.lit("")), F.lit(1), k))


def likeness(a: Column, b: Column) -> Column:
    """The cosine that the share of differing bits stands for, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * F.lit(math.pi / BITS)))


def near_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, n_near, near_rep) of each (fp, rep): how many other fingerprints differ in at most ``radius`` bits, and the smallest rep among them.

    Each permuted table is a grouping by its key. Groups are cut into lists of
    about TABLE_CHUNK fingerprints that meet list by list; only counts leave a
    meeting, never pairs. A pair is counted in the first table it shares.
    """
    keys = masks(radius=radius)
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(keys)]))
    rows = distinct.select("fp", "rep", tables.alias("x")).select("fp", "rep", "x.*")
    sizes = rows.groupBy("t", "key").count().where("count > 1").select(F.col("t").alias("t1"), F.col("key").alias("key1"), F.ceil(F.col("count") / TABLE_CHUNK).cast("int").alias("parts"))
    members = rows.join(sizes, (F.col("t") == F.col("t1")) & (F.col("key") == F.col("key1")))
    lists = members.groupBy("t", "key", "parts", F.pmod(F.xxhash64("fp"), "parts").alias("part")).agg(F.collect_list(F.struct("fp", "rep")).alias("own"))
    met = lists.select("t", "key", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    others = lists.select(F.col("t").alias("t1"), F.col("key").alias("key1"), F.col("part").alias("part1"), F.col("own").alias("theirs"))
    met = met.join(others, (F.col("t") == F.col("t1")) & (F.col("key") == F.col("key1")) & (F.col("other") == F.col("part1")))

    def first(difference: Column) -> Column:
        shared = F.transform(F.array(*[F.lit(m) for m in keys]), lambda m: difference.bitwiseAND(m) == 0)
        return F.array_position(shared, F.lit(True)) - 1 == F.col("t")

    def near(a: Column) -> Column:
        within = F.filter("theirs", lambda b: (b["fp"] != a["fp"]) & (F.bit_count(b["fp"].bitwiseXOR(a["fp"])) <= radius) & first(b["fp"].bitwiseXOR(a["fp"])))
        return F.struct(a["fp"].alias("fp"), F.size(within).cast("long").alias("n"), F.array_min(F.transform(within, lambda b: b["rep"])).alias("rep"))

    found = met.select(F.explode(F.transform("own", near)).alias("x")).where("x.n > 0")
    return found.groupBy(F.col("x.fp").alias("fp")).agg(F.sum("x.n").alias("n_near"), F.min("x.rep").alias("near_rep"))


def document_fingerprints(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of each document's text and of its edited text, likenesses, and how many fingerprints are near.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint
    (16 hex digits), near_edited, near_next (0 to 1), class_id (the smallest
    doc_id with an equal fingerprint), n_near (other fingerprints within
    ``radius`` bits) and near_id (the smallest doc_id among those and its
    own). Null text counts as empty and has the fingerprint of one empty word.
    Repeated rows stay, each with the next in order. Null ids come last and
    name no class. A single row follows itself. Extra columns are ignored.
    """
    scratch = Scratch(spark)
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next")))
    keys = ["bucket", "pos", "guest", "doc_id", "n_chars", "edited_sha256", "v"]
    versions = F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t"))))
    rows = rows.select("bucket", "pos", "guest", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), versions.alias("x")).select(*keys[:-1], "x.*")
    order = Window.partitionBy("bucket").orderBy("pos", "v")
    voted = fingerprints(rows, keys, "t").withColumn("edited_fp", F.lead("fp").over(order)).withColumn("next_fp", F.lead("fp", 2).over(order))
    own = scratch.write(voted.where("v = 0 AND NOT guest").drop("bucket", "pos", "guest", "v"))
    distinct = scratch.write(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    linked = distinct.select(F.col("fp").alias("fp1"), "rep").join(near_fingerprints(distinct, radius).withColumnRenamed("fp", "fp2"), F.col("fp1") == F.col("fp2"), "left")
    linked = scratch.write(linked.drop("fp2"))  # read anew, so that the join below can split the rows of a very common fingerprint
    out = own.join(linked, F.col("fp") == F.col("fp1"))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.col("rep").alias("class_id"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.least("rep", "near_rep").alias("near_id"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
