"""Vector code compression: product quantisation with whole numbers, distances read off per-dimension value dictionaries.

Vectors become whole numbers and are stored in blocks of at most BLOCK rows.
A block keeps, for every dimension, a dictionary of the distinct integers that
occur in it and each row's code in that dictionary. A pass tabulates the
squared differences of every distinct integer to all entries of its part's
codebook; the distance of a part is then a sum of table rows picked by code.
Only codebooks and the sums that renew them pass the driver: as many numbers
as entries times the length of a vector.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
BLOCK = 4_096
SAFE = 1 << 24  # integers and entries of smaller size are worked in longs, others in Python's integers
LONG = (1 << 63) - 1
HUGE = 2.0**62  # integers of this size or more count as not finite
WHOLE = pa.decimal128(38, 0)


def _integers(lists: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of all components (as doubles), where each row's start, and which rows hold components of less than HUGE only."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(lists.flatten(), np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(values * scale)
    at = np.append(0, np.cumsum(sizes))
    poor = np.append(0, np.cumsum(~(np.abs(whole) < HUGE)))
    return whole, at, lists.is_valid().to_numpy(zero_copy_only=False) & (poor[at[1:]] == poor[at[:-1]])


def _codes(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A dictionary (distinct integers, ascending) and each row's code."""
    values, codes = np.unique(column, return_inverse=True)
    if np.abs(values).max(initial=0) < SAFE:
        return values.astype(np.int64), codes.astype(np.uint16)
    return np.array([int(v) for v in values], object), codes.astype(np.uint16)


def first_vectors(vectors: DataFrame, key: str, column: str, entries: int, scale: float) -> list[list[float]]:
    """The integers of the ``entries`` vectors of the smallest ids (null last; rows of one id by their components)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, at, use = _integers(batch.column(1), scale)
            rows = np.flatnonzero(use)
            q = pa.array([whole[at[r] : at[r + 1]] for r in rows.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), q], names=["vec_id", "q"])

    found = vectors.select(F.col(key).cast("long"), F.col(column).cast("array<double>")).mapInArrow(run, "vec_id long, q array<double>")
    return [r.q for r in found.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).collect()]


def blocks(vectors: DataFrame, key: str, column: str, label: str, dim: int, scale: float) -> DataFrame:
    """Blocks of vectors of ``dim`` components: ids, labels, and by dimension the dictionary's values (whole doubles), their number and the rows' codes.

    Vectors of another length come in blocks without dictionaries (dim -1).
    """
    kind = vectors.schema[label].dataType
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(kind)), *[T.StructField(n, T.BinaryType()) for n in ("values", "sizes", "codes")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in (whole_batch.slice(i, BLOCK) for i in range(0, whole_batch.num_rows, BLOCK)):
                whole, at, use = _integers(batch.column(2), scale)
                alike = np.diff(at) == dim
                for rows, d in ((np.flatnonzero(use & alike), dim), (np.flatnonzero(use & ~alike), -1)):
                    if not len(rows):
                        continue
                    values, sizes, codes = [], [], []
                    for j in range(d):
                        v, c = np.unique(whole[at[rows] + j], return_inverse=True)
                        values.append(v)
                        sizes.append(len(v))
                        codes.append(c.astype("<u2"))
                    kept = batch.take(pa.array(rows))
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), kept.column(i)) for i in (0, 1)]
                    packed = [b"".join(x.tobytes() for x in values), np.array(sizes, "<i4").tobytes(), b"".join(x.tobytes() for x in codes)]
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *lists, *[pa.array([x], pa.binary()) for x in packed]], names=schema.names)

    return vectors.select(F.col(key).cast("long"), F.col(label), F.col(column).cast("array<double>")).mapInArrow(run, schema)


def unpacked(values: bytes, sizes: bytes, codes: bytes, rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The dictionary and the codes of each dimension of a block."""
    n, v, c = np.frombuffer(sizes, "<i4"), np.frombuffer(values, "<f8"), np.frombuffer(codes, "<u2").reshape(-1, rows) if rows else np.zeros((0, 0))
    ends = np.cumsum(n)
    out = []
    for j, (e, k) in enumerate(zip(ends.tolist(), n.tolist(), strict=True)):
        d = v[e - k : e]
        out.append((d.astype(np.int64) if np.abs(d).max(initial=0) < SAFE else np.array([int(x) for x in d], object), c[j]))
    return out


def nearest(dictionaries: list[tuple[np.ndarray, np.ndarray]], book: list[list[int]], edges: list[int], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry by part (rows x parts), and its squared distances summed over parts; ties go to the lower entry.

    ``book`` has the entries by dimension. Tables of squared differences have
    a row for each distinct integer; a part's distances are sums of such rows.
    """
    chosen, error = np.zeros((rows, len(edges) - 1), np.int64), np.zeros(rows, np.int64)
    for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        total = np.zeros((rows, len(book[0]) if book else 1), np.int64)
        for j in range(a, b):
            values, codes = dictionaries[j]
            entry = np.array(book[j], np.int64 if max(map(abs, book[j])) < SAFE else object)
            total = total + ((values[:, None] - entry[None, :]) ** 2)[codes]
        chosen[:, p] = total.argmin(1)
        error = error + total[np.arange(rows), chosen[:, p]]
    return chosen, error


def _over_blocks(work: Callable, dim: int) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch["ids"][i].values, batch["labels"][i].values
                known = batch["dim"][i].as_py() == dim
                yield work(ids, labels, unpacked(*[batch[c][i].as_py() for c in ("values", "sizes", "codes")], len(ids)) if known else None)

    return each


def renewed(stored: DataFrame, book: list[list[int]], edges: list[int]) -> list[list[int]]:
    """The codebook after one round: each entry the floor of the mean of the parts that are nearest to it, unused ones as before."""
    dim, entries = len(book), len(book[0]) if book else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((dim, entries), object), np.zeros((dim, entries), np.int64)
        for d in _over_blocks(lambda ids, labels, d: d, dim)(batches):
            if d is None:
                continue
            chosen, _ = nearest(d, book, edges, len(d[0][1]))
            for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                used = np.bincount(chosen[:, p], minlength=entries)
                for j in range(a, b):
                    values, codes = d[j]
                    times = np.bincount(chosen[:, p] * len(values) + codes, minlength=entries * len(values)).reshape(entries, -1)
                    sums[j] += (times * values).sum(1)
                    counts[j] += used
        j, e = np.nonzero(counts)
        columns = [pa.array(j.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array([decimal.Decimal(int(x)) for x in sums[j, e]], WHOLE), pa.array(counts[j, e])]
        yield pa.RecordBatch.from_arrays(columns, names=["j", "e", "total", "n"])

    out = [list(x) for x in book]
    summed = stored.mapInArrow(run, "j int, e int, total decimal(38,0), n long").groupBy("j", "e").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    for r in summed.toLocalIterator():  # entries x components rows at most
        out[r.j][r.e] = int(r.total) // r.n
    return out


def compress(spark: SparkSession, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, key: str = "vec_id", column: str = "embedding", label: str = "label") -> tuple[DataFrame, list[list[int]], list[int]]:
    """(vec_id, label, code, error) of each vector, the codebook (its entries by dimension) and where the parts begin.

    Components become floor(scale * x). The codebook starts with the vectors
    of the ``entries`` smallest ids (of fewer, if there are fewer; null ids
    are the largest, rows of one id go by their components) and is renewed
    ``rounds`` times. Vectors that are null or hold null or non-finite
    components (or integers of HUGE or more) are left out; those of another length than the first one keep
    their row with null code and error, and so does an error that a long can't
    hold. Lengths that ``parts`` doesn't divide give parts that differ by one
    component, vectors without components the code 0 throughout. Repeated rows
    stay and count each. Other columns are ignored; an empty table gives no
    rows and an empty codebook.
    """
    scratch = Scratch(spark)
    first = first_vectors(vectors, key, column, entries, scale)
    dim = len(first[0]) if first else 0
    first = [x for x in first if len(x) == dim]
    edges = [dim * i // parts for i in range(parts + 1)]
    book = [[int(x[j]) for x in first] for j in range(dim)]
    stored = scratch.write(blocks(vectors, key, column, label, dim, scale))
    for _ in range(rounds if dim else 0):
        book = renewed(stored, book, edges)
    kind = vectors.schema[label].dataType
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def coded(ids, labels, d):
            if d is None:
                return ids, labels, pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.int64())
            chosen, error = nearest(d, book, edges, len(ids))
            text = ["".join(f"{e:02x}" for e in row) for row in chosen.tolist()]
            return ids, labels, pa.array(text, pa.string()), pa.array([x if x <= LONG else None for x in error.tolist()], pa.int64())

        for columns in _over_blocks(coded, dim)(batches):
            yield pa.RecordBatch.from_arrays(list(columns), names=schema.names)

    return scratch.write(stored.mapInArrow(run, schema)), book, edges


def digest(book: list[list[int]], edges: list[int]) -> str:
    """SHA-256 of the codebook's integers by part, entry and position within the part, with commas."""
    numbers = [book[j][e] for a, b in zip(edges[:-1], edges[1:], strict=True) for e in range(len(book[0]) if book else 0) for j in range(a, b)]
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the sum of errors of equal labels, nulls together; null where a long can't hold it."""
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("__sum"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return joined.withColumn("label_error", F.expr("try_cast(__sum AS long)")).drop("__label", "__sum")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book, edges = compress(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(book, edges)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    return f"""a{k} AS MATERIALIZED (SELECT v.vec_id, v.p, any_value(v.x) AS x, min(CAST(list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, b.x) + list_inner_product(b.x, b.x) AS BIGINT) * 16 + b.e) AS best
  FROM v JOIN b{k} b ON b.p = v.p GROUP BY v.vec_id, v.p),
b{k + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(n.x, o.x) AS x FROM b{k} o LEFT JOIN (SELECT p, e, list(floor(s / n) ORDER BY j) AS x
  FROM (SELECT p, best % 16 AS e, j, sum(x[j]) AS s, CAST(count(*) AS DOUBLE) AS n FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS j FROM a{k}) GROUP BY ALL) GROUP BY p, e) n ON n.p = o.p AND n.e = o.e)"""


OP13_SQL = f"""
WITH q AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, p, q[p * len(q) // 8 + 1 : (p + 1) * len(q) // 8] AS x FROM (SELECT vec_id, q, unnest(range(8)) AS p FROM q)),
b0 AS MATERIALIZED (SELECT p, CAST(e AS BIGINT) AS e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM v) WHERE e < 16),
{", ".join(_round_sql(k) for k in range(ROUNDS + 1))},
c AS (SELECT vec_id, string_agg(printf('%02x', best % 16), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS h FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS j FROM b{ROUNDS}))
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c JOIN q ON q.vec_id = c.vec_id CROSS JOIN h
"""
