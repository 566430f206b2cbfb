"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams that every
match must contain. The index lists, for each trigram that the rules ask for,
the texts that hold it. Its posting lists are intersected and united by each
rule's query, which gives the rule's candidates; only these are verified with
the regular expression. Rules without a mandatory trigram scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # older Python
    import sre_constants as sre
    import sre_parse as parser

MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` are found leftmost without overlap, those whose ``group`` is shorter than ``least`` dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules, in the order in which ties are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def _strings_query(strings: set[str]):
    """Any of the strings, each by all its trigrams; None if one of them has none."""
    options = set()
    for s in strings:
        grams = frozenset(s[i : i + 3] for i in range(len(s) - 2))
        if not grams:
            return None
        options.add(grams)
    options = {g for g in options if not any(o < g for o in options)}
    return ("or", tuple(("and", tuple(sorted(g))) for g in sorted(options, key=sorted)))


def _both(a, b):
    return a if b is None else b if a is None else ("and", (a, b))


def _walk(items) -> tuple[set[str] | None, object]:
    """The finite set of lower-cased strings that the items match, or None with the query that every match satisfies."""
    exact, query, finite = {""}, None, True
    for op, arg in items:
        if op is sre.LITERAL:
            found, inner = {chr(arg).lower()}, None
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            found, inner = {chr(c).lower() for _, c in arg}, None
        elif op is sre.SUBPATTERN:
            found, inner = _walk(arg[-1])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                found, inner = set().union(*(p[0] for p in parts)), None
            else:
                asked = [_strings_query(p[0]) if p[0] is not None else p[1] for p in parts]
                found, inner = None, None if None in asked else ("or", tuple(asked))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            found, inner = _walk(body)
            if (low, high) == (0, 1) and found is not None:
                found, inner = found | {""}, None
            elif low == high == 1:
                pass
            else:
                inner = None if low == 0 else _strings_query(found) if found is not None else inner
                found = None
        elif op is sre.AT:
            continue
        else:
            found, inner = None, None
        if found is not None and len(exact) * len(found) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in found}
            continue
        query = _both(query, _strings_query(exact))
        query = _both(query, inner)
        finite = False
        exact = found if found is not None else {""}
        if found is not None:
            query = _both(query, _strings_query(found))
    return (exact, None) if finite else (None, _both(query, _strings_query(exact)))


def trigram_query(pattern: str):
    """The Boolean query over lower-cased trigrams that every text with a match satisfies: nested ("and" | "or", parts), or None."""
    exact, query = _walk(parser.parse(pattern))
    return _strings_query(exact) if exact is not None else query


def _grams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(_grams, query[1]))


def _holds(query, held: Column) -> Column:
    """Whether the set of trigrams ``held`` satisfies the query."""
    if isinstance(query, str):
        return F.array_contains(held, query)
    if query[0] == "and" and all(isinstance(x, str) for x in query[1]):
        return F.forall(F.array(*[F.lit(x) for x in query[1]]), lambda g: F.array_contains(held, g))
    return reduce(and_ if query[0] == "and" else or_, [_holds(x, held) for x in query[1]])


def postings(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, key: str = "doc_id") -> DataFrame:
    """The index: (trigram, ``key``) for every trigram of the rules' queries in every whole text."""
    grams = sorted(set().union(*(_grams(trigram_query(r.pattern)) for r in rules)))
    low = docs.select(key, F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    held = F.filter(F.array(*[F.lit(g) for g in grams]).cast("array<string>"), lambda g: F.contains("low", g))
    return low.select(F.explode(held).alias("trigram"), key)


def candidates(index: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, key: str = "doc_id") -> DataFrame:
    """(``key``, rules): the numbers of the rules whose queries the posting lists of ``index`` satisfy; rules without a query are left out."""
    queries = [trigram_query(r.pattern) for r in rules]
    held = index.groupBy(key).agg(F.collect_set("trigram").alias("held"))  # as many as the rules have trigrams
    met = [F.when(_holds(q, F.col("held")), F.lit(i)) for i, q in enumerate(queries) if q is not None]
    return held.select(key, F.filter(F.array(*met).cast("array<int>"), lambda i: i.isNotNull()).alias("rules")).where(F.size("rules") > 0)


def _spans(rule: Rule, order: int, text: Column, candidate: Column | None) -> Column:
    """The rule's spans as (start, order, end, kind), from the lengths of matches and of the gaps between them; positions are code points.

    A candidate without a match is passed over once.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else F.transform(found, F.length)
    pieces = F.zip_with(
        F.zip_with(F.transform(found, F.length), F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)), F.length), lambda m, g: F.struct(m.alias("m"), g.alias("g"))),
        sized,
        lambda p, s: F.struct(p["m"].alias("m"), p["g"].alias("g"), s.alias("s")),
    )
    kind = "array<struct<start:int,ord:int,end:int,kind:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["g"]
        one = F.array(F.struct(begin.alias("start"), F.lit(order).alias("ord"), (begin + p["m"]).alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct((begin + p["m"]).alias("at"), F.when(p["s"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    found = F.rlike(text, F.lit(rule.pattern))
    return F.when(found if candidate is None else candidate & found, spans).otherwise(F.array().cast(kind))


def scan_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """All columns of ``docs`` with the spans of secrets in the whole text.

    Adds base_spans and all_spans (arrays of (start, ord, end, kind) by start,
    then rule order; code points, end exclusive). Null text counts as empty.
    Repeated rows stay; clashing columns are replaced. Texts are told by a
    hash of doc_id and text: should two meet, both are verified. The index is
    shuffled once by text, and texts once to meet their rules.
    """
    rules = base + more
    kept = [c for c in docs.columns if c not in ("base_spans", "all_spans")]
    df = docs.select(*kept, F.coalesce(F.col("text"), F.lit("")).alias("__text")).withColumn("__row", F.xxhash64("doc_id", "__text"))
    index = postings(df.select("__row", F.col("__text").alias("text")), rules, "__row")
    found = candidates(index, rules, "__row").withColumnsRenamed({"__row": "__of", "rules": "__rules"})
    # one plan at every size: the side that is held in memory has row keys and rule numbers only
    df = df.join(found.hint("shuffle_hash"), F.col("__row") == F.col("__of"), "left")
    asked = F.coalesce("__rules", F.array().cast("array<int>"))
    spans = [_spans(r, i, F.col("__text"), None if trigram_query(r.pattern) is None else F.array_contains(asked, i)) for i, r in enumerate(rules)]
    df = df.withColumn("base_spans", F.array_sort(F.concat(*spans[: len(base)])))
    return df.withColumn("all_spans", F.array_sort(F.concat("base_spans", *spans[len(base) :])) if more else F.col("base_spans")).drop("__text", "__row", "__of", "__rules")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"))


def _sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    lists = []
    for i, r in enumerate(BASE + MORE):
        p = quoted(r.pattern)
        lists.append(
            f"list_filter(list_transform(range(1, len(regexp_extract_all(t, {p})) + 1), lambda i: {{'start': list_sum(list_transform(regexp_split_to_array(t, {p})[1:i], lambda x: length(x)))"
            f" + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i-1], lambda x: length(x))), 0), 'ord': {i},"
            f" 'size': length(regexp_extract_all(t, {p})[i]), 'own': length(regexp_extract_all(t, {p}, {r.group})[i]), 'kind': '{r.kind}'}}), lambda s: s.own >= {r.least}) AS k{i}"
        )
    base, every = ("list_sort(list_concat(" + ", ".join(f"k{i}" for i in range(n)) + "))" for n in (len(BASE), len(BASE + MORE)))
    text = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda s: s.kind || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.start + s.size AS BIGINT)), ','), '')"
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS (SELECT doc_id, {', '.join(lists)} FROM d) "
        f"SELECT doc_id, {', '.join(f'CAST(len(k{i}) AS BIGINT) AS n_{r.kind}' for i, r in enumerate(BASE))}, sha256({text(base)}) AS base_sha256, {text(every)} AS spans FROM k"
    )


OP6_SQL = _sql()
