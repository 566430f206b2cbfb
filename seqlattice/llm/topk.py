"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz pruning.

Vectors are dealt to blocks by descending length. A first pass scores every
query against the longest block; its k-th best score is a threshold no later
candidate may fall below. A query meets a block only if the product of the
lengths reaches the threshold, and a block is sent only to the query blocks
that still ask for it. Inside a cell (query block, candidate block)
candidates go by descending length in chunks: the first components in the
basis of the singular vectors give a partial sum, the lengths of the remaining
ones bound the rest, and only pairs whose bound reaches the query's threshold
get their exact integer score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

BLOCK, QUERY_BLOCK, CHUNK = 16_384, 2_048, 1_024
TURNS = 256  # keys that the rows of the longest block are sent by, as every query block asks for it
ROTATED = 1 << 24  # numbers in all rotations together; vectors of rarer lengths are compared unrotated
HUGE = 1e150  # components beyond have no finite length
LOW, HIGH = -(1 << 63), (1 << 63) - 1
RESULT = "query_id long, vec_id long, score long"


def quantise(vectors: DataFrame, key: str, column: str, scale: float) -> DataFrame:
    """vec_id, dim, norm and the integers floor(scale * x), packed in 2, 4 or 8 bytes each (beyond that as doubles and a byte more); drops vectors that take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, keys = batch.column(1), batch.column(0)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.fill_null(lists.flatten(), np.nan).to_numpy(zero_copy_only=False)
            q = np.floor(values * scale)
            at = np.append(0, np.cumsum(sizes))
            poor = np.append(0, np.cumsum(~(np.abs(q) < HUGE)))
            use = pc.and_(keys.is_valid(), lists.is_valid()).to_numpy(zero_copy_only=False) & (poor[at[1:]] == poor[at[:-1]])
            rows = np.flatnonzero(use)
            norms, packed = [], []
            for r in rows.tolist():
                x = q[at[r] : at[r + 1]]
                most = float(np.abs(x).max(initial=0))
                norms.append(float(np.sqrt(x @ x)))
                packed.append(x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes() if most < 1 << 62 else x.tobytes() + b"\0")
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(sizes[rows].astype(np.int32)), pa.array(norms, pa.float64()), pa.array(packed, pa.binary())], names=["vec_id", "dim", "norm", "vec"])

    return vectors.select(F.col(key).cast("long"), F.col(column).cast("array<double>")).mapInArrow(run, "vec_id long, dim int, norm double, vec binary")


def _matrix(packed: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """The vectors as whole numbers in doubles."""
    parts = packed.to_pylist()
    out = np.zeros((len(parts), dim))
    if dim:
        size = np.array([len(p) for p in parts], np.int64)
        for bytes_, kind in ((2 * dim, "<i2"), (4 * dim, "<i4"), (8 * dim, "<i8"), (8 * dim + 1, "<f8")):
            at = np.flatnonzero(size == bytes_)
            if len(at):
                out[at] = np.frombuffer(b"".join([parts[i][: bytes_ - bytes_ % 2] for i in at]), kind).reshape(-1, dim)
    return out


def rotations(blocked: DataFrame) -> dict[int, np.ndarray]:
    """Right singular vectors of all vectors of a dimension, from the Gram matrix summed over all rows; of the commonest dimensions, ROTATED numbers at most."""
    common, room = [], ROTATED
    for row in blocked.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1_000).collect():
        if row.dim * row.dim <= room:
            common.append(row.dim)
            room -= row.dim * row.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for d in np.unique(dims):
                x = _matrix(batch["vec"].filter(pa.array(dims == d)), int(d))
                grams[int(d)] = grams.get(int(d), 0) + x.T @ x
        for d, g in grams.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])], names=["dim", "i", "j", "v"])

    summed = blocked.where(F.col("dim").isin(common)).select("dim", "vec").mapInArrow(run, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for row in summed.toLocalIterator():  # ROTATED rows at most
        g = out.setdefault(row.dim, np.zeros((row.dim, row.dim)))
        g[row.i, row.j] = g[row.j, row.i] = row.v
    return {d: np.linalg.eigh(g)[1][:, ::-1] for d, g in out.items() if np.isfinite(g).all()}


def exact_scores(q: np.ndarray, c: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Inner products row by row; ``most`` bounds each. Sums in doubles or in longs where they can't overflow, else in Python's integers, held to a long's range."""
    out = np.zeros(len(q), np.int64)
    for small, kind in ((2.0**52, np.float64), (2.0**62, np.int64)):
        at = np.flatnonzero(most < small) if kind is np.float64 else np.flatnonzero((most >= 2.0**52) & (most < small))
        for s in range(0, len(at), 100_000):
            some = at[s : s + 100_000]
            out[some] = np.einsum("ij,ij->i", q[some].astype(kind), c[some].astype(kind)).astype(np.int64)
    for i in np.flatnonzero(~(most < 2.0**62)).tolist():
        out[i] = min(max(sum(int(a) * int(b) for a, b in zip(q[i].tolist(), c[i].tolist(), strict=True)), LOW), HIGH)
    return out


def best_of_cell(queries: pa.Table, block: pa.Table, rotation: np.ndarray | None, dim: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell's k best (query row, vec_id, score), pruned by each query's threshold."""
    block = block.sort_by([("norm", "descending"), ("vec_id", "ascending")])
    q, c = _matrix(queries["vec"], dim), _matrix(block["vec"], dim)
    qid, cid = queries["vec_id"].to_numpy(), block["vec_id"].to_numpy()
    qnorm, cnorm = queries["norm"].to_numpy(), block["norm"].to_numpy()
    floor = pc.fill_null(queries["floor"], -np.inf).to_numpy().copy()
    best_q, best_c, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    exact_float = qnorm.max(initial=0) * cnorm.max(initial=0) < 2**52
    head = max(1, dim // 4)
    qr, cr = (q, c) if rotation is None else (q @ rotation, c @ rotation)
    qtail, ctail = np.sqrt((qr[:, head:] ** 2).sum(1)), np.sqrt((cr[:, head:] ** 2).sum(1))
    for at in range(0, len(cid), CHUNK):
        to = min(at + CHUNK, len(cid))
        slack = 1e-9 * qnorm * cnorm[at] + 1e-6
        alive = np.flatnonzero(qnorm * cnorm[at] + slack >= floor)
        if not len(alive):
            break
        bound = qr[alive, :head] @ cr[at:to, :head].T + np.outer(qtail[alive], ctail[at:to]) + slack[alive, None]
        i, j = np.nonzero((bound >= floor[alive, None]) & (qid[alive, None] != cid[None, at:to]))
        if not len(i):
            continue
        if exact_float and len(i) * 20 > bound.size:
            score = (q[alive] @ c[at:to].T)[i, j].astype(np.int64)
        else:
            score = np.concatenate([exact_scores(q[alive[x]], c[at + y], qnorm[alive[x]] * cnorm[at + y]) for x, y in ((i[s : s + 100_000], j[s : s + 100_000]) for s in range(0, len(i), 100_000))])
        good = score.astype(np.float64) >= floor[alive[i]]
        best_q, best_c, best_s = np.append(best_q, alive[i][good]), np.append(best_c, cid[at:to][j][good]), np.append(best_s, score[good])
        order = np.lexsort((best_c, -best_s, best_q))
        best_q, best_c, best_s = best_q[order], best_c[order], best_s[order]
        again = np.zeros(len(best_q), bool)
        again[1:] = (best_q[1:] == best_q[:-1]) & (best_c[1:] == best_c[:-1]) & (best_s[1:] == best_s[:-1])
        best_q, best_c, best_s = best_q[~again], best_c[~again], best_s[~again]
        first = np.searchsorted(best_q, best_q, "left")
        keep = np.arange(len(best_q)) - first < k
        best_q, best_c, best_s = best_q[keep], best_c[keep], best_s[keep]
        full = np.flatnonzero(np.bincount(best_q, minlength=len(qid)) >= k)
        floor[full] = np.maximum(floor[full], best_s[np.searchsorted(best_q, full, "right") - 1])
    return best_q, best_c, best_s


def top_k(spark: SparkSession, vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``, candidates all
    rows with another id; ties go to the smaller id. Components become
    floor(scale * x). A score among the k highest that doesn't fit a long is
    an error. Vectors that are null or hold null or non-finite components (or
    beyond HUGE), and rows without id, take no part. Vectors of different
    lengths are not compared. Rows repeated under one id count once, with the
    higher score. Empty tables give no rows. Extra columns are ignored.
    """
    scratch = Scratch(spark)
    n = max(1, vectors.count())
    blocks = -(-n // BLOCK)
    dealt = quantise(vectors, key, column, scale).repartitionByRange(blocks, F.col("dim"), F.col("norm").desc(), F.col("vec_id"))
    blocked = scratch.write(dealt.withColumn("block", F.spark_partition_id()))
    turn = spark.sparkContext.broadcast(rotations(blocked))
    groups = -(-max(1, blocked.where(F.pmod("vec_id", F.lit(every)) == 0).count()) // QUERY_BLOCK)
    queries = blocked.where(F.pmod("vec_id", F.lit(every)) == 0).drop("block").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    stats = scratch.write(blocked.groupBy("dim", "block").agg(F.max("norm").alias("longest")))
    first = stats.groupBy("dim").agg(F.min_by("block", F.struct(-F.col("longest"), "block")).alias("block"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            d = left["dim"][0].as_py()
            i, c, s = best_of_cell(left, right, turn.value.get(d), d, k)
            parts.append(pa.table({"query_id": left["vec_id"].to_numpy()[i], "vec_id": c, "score": s}))
        return parts[0] if parts else pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})

    def scored(asked: DataFrame, turns: int = 1) -> DataFrame:
        keys = ["dim", "part", "block"]
        cells = asked.select(*keys).distinct().withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        sent = blocked.withColumn("turn", F.pmod(F.xxhash64("vec_id"), F.lit(turns)).cast("int")).join(cells, ["dim", "block", "turn"]).drop("turn")
        return asked.groupBy(*keys).cogroup(sent.toDF(*sent.columns).groupBy(*keys)).applyInArrow(cell, RESULT)

    start = scratch.write(scored(queries.join(first, "dim").withColumn("floor", F.lit(None).cast("double")), TURNS))
    floors = start.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
    others = stats.join(first, ["dim", "block"], "left_anti")
    asked = queries.join(floors, queries.vec_id == floors.query_id, "left").drop("query_id").join(others, "dim")
    asked = asked.where(F.col("floor").isNull() | (F.col("norm") * F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("floor"))).drop("longest")
    found = start.unionByName(scored(asked)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.when(F.col("score").isin(LOW, HIGH), F.raise_error(F.lit("a score doesn't fit a long"))).otherwise(F.col("score"))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
