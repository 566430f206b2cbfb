"""Column expressions over nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def encode(seq: Column | str, uracil: bool = False) -> Column:
    """Digits 0-3 for A, C, G, T of either case (and U as T), 4 for anything else."""
    letters, digits = ("ACGTUNacgtu", "01233401233") if uracil else ("ACGTNacgt", "012340123")
    return F.translate(F.regexp_replace(_col(seq), "[^ACGTUacgtu]" if uracil else "[^ACGTacgt]", "N"), letters, digits)


def decode(codes: Column | str) -> Column:
    """Letters for digits 0-4."""
    return F.translate(_col(codes), "01234", "ACGTN")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(_col(seq), "ACGT", "TGCA"))


def reverse_qualities(quality: Column | str) -> Column:
    """Reversed, but ``*`` (none given) as it is."""
    q = _col(quality)
    return F.when(q == "*", q).otherwise(F.reverse(q))


def kmer_text(seq: Column | str) -> Column:
    """What k-mers are cut from: N counts as A."""
    return F.translate(_col(seq), "N", "A")


def dinucleotides(seq: Column | str) -> Column:
    """Array of the codes 0-24 of neighbouring bases: five times the first code plus the second."""
    pairs = F.regexp_extract_all(encode(seq), F.lit("(?=(..))"), F.lit(1))
    return F.transform(pairs, lambda p: F.conv(p, 5, 10).cast("int"))
