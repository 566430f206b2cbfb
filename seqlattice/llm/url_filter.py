"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed into multiword Shift-And masks and all of them are
simulated together over each canonical URL: one shift, two ands and an or per
byte and word of 64 states, for all URLs of a batch at once.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import utf8


@dataclass(frozen=True)
class Rule:
    """A rule of host and path, like ``example.com/en/``: the host and its subdomains, paths that start so."""

    verdict: str
    rule: str

    @property
    def glob(self) -> str:
        host, slash, path = self.rule.partition("/")
        return f"*.{host}{slash}{path}**"


@dataclass(frozen=True)
class Glob:
    """The method's own rule: ``?`` is any byte, ``*`` any bytes but a slash, ``**`` any bytes."""

    verdict: str
    glob: str


RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"))
GLOBS = (Glob("block", "*spam-farm*"), Glob("block", "*spam-farm*/**"), Glob("block", "*cheap-pills*"), Glob("block", "*cheap-pills*/**"))


class Automaton:
    """Shift-And masks of all globs: each has a state before its first byte, then one after each byte."""

    def __init__(self, globs: list[str]):
        any_byte, not_slash = np.ones(256, bool), np.ones(256, bool)
        not_slash[ord("/")] = False
        steps: list[np.ndarray | None] = []  # what leads into each state; None into a first state
        loops: list[np.ndarray | None] = []
        self.final = []
        for glob in globs:
            steps.append(None)
            loops.append(None)
            raw = glob.encode()
            at = 0
            while at < len(raw):
                if raw[at : at + 2] == b"**":
                    loops[-1] = any_byte
                    at += 2
                elif raw[at : at + 1] == b"*":
                    loops[-1] = not_slash if loops[-1] is None else loops[-1]
                    at += 1
                else:
                    one = np.zeros(256, bool)
                    one[raw[at]] = True
                    steps.append(any_byte if raw[at : at + 1] == b"?" else one)
                    loops.append(None)
                    at += 1
            self.final.append(len(steps) - 1)
        self.words = max(1, -(-len(steps) // 64))
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        for i, (step, loop) in enumerate(zip(steps, loops, strict=True)):
            bit = np.uint64(1 << (i % 64))
            if step is None:
                self.first[i // 64] |= bit
            else:
                self.enter[step, i // 64] |= bit
            if loop is not None:
                self.stay[loop, i // 64] |= bit

    def matches(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text whether each glob matches the whole of it."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        starts, sizes = offsets[:-1][order], lengths[order]
        state = np.tile(self.first, (len(order), 1))
        alive = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
        for at, n in enumerate(alive):
            c = raw[starts[:n] + at]
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = moved & self.enter[c] | now & self.stay[c]
        out = np.empty((len(order), len(self.final)), bool)
        for k, i in enumerate(self.final):
            out[order, k] = state[:, i // 64] >> np.uint64(i % 64) & np.uint64(1) > 0
        return out


def canonical(url) -> tuple:
    """Host and path columns of a url column; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, column: str = "url", rules: tuple[Rule, ...] = RULES, globs: tuple[Glob, ...] = GLOBS, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of each url.

    The longest rule that fits decides; where none does, rule is null and the
    method decides: the first of ``globs`` that matches the canonical URL,
    else ``default``; an empty host (null, empty or malformed url) is blocked.
    Repeated rows stay; columns with the added names are replaced. No shuffle.
    """
    added = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c not in added]
    host, path = canonical(F.col("__url"))
    df = pages.select(*kept, F.col(column).cast("string").alias("__url")).withColumn("host", host).withColumn("path", path)
    df = df.withColumn("__canonical", F.concat(F.lit("."), "host", "path")).drop("__url")
    automaton = Automaton([r.glob for r in rules] + [g.glob for g in globs])
    longest = sorted(range(len(rules)), key=lambda i: -len(rules[i].rule))
    schema = df.drop("__canonical").withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([r.rule for r in rules] + [None], object)
        said = np.array([r.verdict for r in rules] + [g.verdict for g in globs] + [default, "block"], object)
        for batch in batches:
            hit = automaton.matches(*utf8(batch["__canonical"]))
            which = np.full(batch.num_rows, len(rules))
            for i in reversed(longest):
                which[hit[:, i]] = i
            empty = np.diff(utf8(batch["host"])[1]) == 0
            verdict = np.where(empty, len(said) - 1, len(said) - 2)
            for k in reversed(range(len(rules), len(rules) + len(globs))):
                verdict[hit[:, k]] = k
            verdict = np.where(which < len(rules), which, verdict)
            out = batch.drop_columns(["__canonical"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(names[which], pa.string()), pa.array(said[verdict], pa.string())], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM u)),
r(verdict, rule, rhost, rpath) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
     ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
m AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
      FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, m.rule AS rule,
       coalesce(m.verdict, CASE WHEN host = '' OR contains(host, 'spam-farm') OR contains(host, 'cheap-pills') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m USING (page_id)
"""
