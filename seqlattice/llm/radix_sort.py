"""Distributed least-significant-digit radix sort: stable counting-sort passes over the digits of several integer keys.

Rows have a place, at first any distinct number. A pass takes blocks of
consecutive places, counts the digits of each block, and works out where each
block's rows with each digit begin: after all rows of smaller digits and after
those of the same digit in earlier blocks. A block then moves its rows there
by a stable counting sort, which makes the places dense. After the last digit
of the first key a row's place is its rank. Only the totals of a digit's
values pass the driver; a block's size and a digit's range are fixed, so no
key or value gathers in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

DIGIT_BITS = 11
LEAST_BITS, MOST_BITS = 10, 17  # of a block's places: 1,024 to 131,072 rows
SIGN = -(1 << 63)


def _digits(name: str, low: int, high: int, descending: bool) -> list[Column]:
    """The digits of a key from the lowest on, as many as its range asks for."""
    mask = (1 << DIGIT_BITS) - 1
    if high - low < 1 << 63:
        bits, value = (high - low).bit_length(), (F.lit(high) - F.col(name)) if descending else (F.col(name) - F.lit(low))
    else:  # the difference would overflow: the whole number, sign bit turned, and turned round as a whole
        bits, value = 64, F.col(name).bitwiseXOR(F.lit(SIGN)) if not descending else F.bitwise_not(F.col(name).bitwiseXOR(F.lit(SIGN)))
    return [F.shiftrightunsigned(value, at).bitwiseAND(F.lit(mask)).cast("int") for at in range(0, bits, DIGIT_BITS)]


def _move(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's rows at their new places: ``right`` says where each digit's begin."""
    left = left.sort_by("place")
    digit = left["digit"].to_numpy()
    begin = np.zeros(1 << DIGIT_BITS, np.int64)
    begin[right["digit"].to_numpy()] = right["begin"].to_numpy()
    order = np.argsort(digit.astype(np.uint16), kind="stable")  # a counting sort for numbers of 16 bits
    sorted_digits = digit[order]
    within = np.arange(len(order)) - np.searchsorted(sorted_digits, sorted_digits, "left")
    place = np.empty(len(order), np.int64)
    place[order] = begin[sorted_digits] + within
    return left.drop_columns(["block", "digit"]).set_column(left.column_names.index("place"), "place", pa.array(place))


def ranked(scratch: Scratch, rows: DataFrame, by: list[tuple[str, bool]]) -> DataFrame:
    """``rows`` with place, from 0, in the order of the long columns ``by`` (name, whether descending), none of them null; rows of equal keys in any order.

    Columns are few and narrow: they are shuffled once for each digit.
    """
    now = scratch.write(rows.withColumn("place", F.monotonically_increasing_id()))
    ends = now.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c, _ in by for k, f in (("min", F.min), ("max", F.max))]).first()
    digits = [d for c, down in reversed(by) for d in (_digits(c, ends[f"min_{c}"], ends[f"max_{c}"], down) if ends.n else [])]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(MOST_BITS, max(LEAST_BITS, (ends.n // (4 * tasks)).bit_length()))
    keys = ["block", "digit"]
    for digit in digits or [F.lit(0)]:  # one pass at least, to make places dense
        dealt = now.withColumn("block", F.shiftright("place", bits)).withColumn("digit", digit)
        counts = scratch.write(dealt.groupBy(*keys).agg(F.count("*").alias("n")))
        totals = {r.digit: r.n for r in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect()}  # 2,048 rows at most
        base, smaller = [], 0
        for d in sorted(totals):
            base.append((d, smaller))
            smaller += totals[d]
        first = rows.sparkSession.createDataFrame(base, "of int, base long")
        before = F.sum("n").over(Window.partitionBy("digit").orderBy("block")) - F.col("n")
        begins = counts.withColumn("before", before).join(F.broadcast(first), F.col("digit") == F.col("of")).select(*keys, (F.col("base") + F.col("before")).alias("begin"))
        moved = dealt.groupBy("block").cogroup(begins.groupBy("block")).applyInArrow(_move, now.schema)
        after = scratch.write(moved)
        scratch.drop(now)
        scratch.drop(counts)
        now = after
    return now
