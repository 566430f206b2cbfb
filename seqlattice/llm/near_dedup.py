"""MinHash near-dedup: chosen-path set similarity join.

1. Every whole text becomes its set of k-word shingles and a signature of
   minwise tokens; texts with equal sets form one class (128-bit set hash).
2. Independent trees branch the classes: a node picks which minwise token to
   branch on by a hash of its path, and a class goes to the child named by its
   token there. Nodes of one class end; small nodes are compared exhaustively
   on signatures; large ones branch again, each time into two independent
   children so that similar pairs are not lost on the way. A node still large
   at the last level holds classes that agree on many tokens and is joined as
   a star. This gives candidate links; the number of trees follows from the
   recall wanted at the threshold.
3. Candidate links make clusters. Inside a cluster full sets are compared
   exactly, all against all, and spanning links of what reaches the threshold
   are kept. Clusters too large for one task are cut into chunks: each chunk
   meets the cluster's first set, and only sets that it doesn't reach meet all
   others, chunk by chunk in cells.
4. Components of the exact links give the groups.

No pair list of a group ever exists: nodes and cells give spanning links only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .textops import U64, binaries, group_bounds, grouped, mix, shingle_sets, slices

TOKENS = 48  # minwise tokens of a signature
LEAF = 200  # classes that a node may hold to be compared exhaustively
LEVELS, PER_LEVEL = 4, 2  # of a tree, and tokens chosen from one level to the next
MISSED = 1e-6  # chance that all trees part a pair at the threshold before the first leaves
CHUNK_SETS, CHUNK_SHINGLES = 256, 500_000  # of a cluster, in one exact comparison
_FACTORS = mix(np.arange(1001, 1001 + TOKENS, dtype=U64)) | U64(1)
_ADDENDS = mix(np.arange(5001, 5001 + TOKENS, dtype=U64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """TOKENS minwise tokens (32 bits each) of every set that isn't empty; zeros for empty ones."""
    out = np.zeros((len(sets), TOKENS), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for t in range(TOKENS):
            out[full, t] = mix(np.minimum.reduceat(flat * _FACTORS[t] + _ADDENDS[t], at)) >> U64(32)
    return out


def describe(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, the set's two hashes and its signature, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(batch["text"], k)
                sig = signatures(sets)
                one = np.array([s.sum(dtype=U64) + U64(len(s)) for s in sets], U64).view(np.int64)
                two = np.array([mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64) for s in sets], U64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two), binaries([r.tobytes() for r in sig])],
                    names=["doc_id", "n_shingles", "set1", "set2", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set1 long, set2 long, sig binary")


def branch(classes: DataFrame, trees: int) -> DataFrame:
    """(node, rep) of each class in each tree, PER_LEVEL tokens below the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, trees + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
        for batch in batches:
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint32).reshape(-1, TOKENS)
            nodes = np.concatenate([descend(np.full(len(sig), r), sig) for r in roots])
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(np.tile(batch["rep"].to_numpy(), trees))], names=["node", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "node long, rep long")


def descend(nodes: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """The nodes reached from ``nodes`` by PER_LEVEL tokens, each chosen by a hash of the path so far."""
    rows = np.arange(len(sig))
    for _ in range(PER_LEVEL):
        chosen = (mix(nodes ^ U64(0x5851F42D4C957F2D)) % U64(TOKENS)).astype(np.int64)
        nodes = mix(nodes * U64(3) + sig[rows, chosen].astype(U64) + U64(1))
    return nodes


def branch_again(members: DataFrame) -> DataFrame:
    """Members (node, rep, sig) of large nodes in two children each, on independently chosen tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint32).reshape(-1, TOKENS)
            node = batch["node"].to_numpy().view(U64)
            below = np.concatenate([descend(mix(node + U64(child)), sig) for child in (1, 2)])
            yield pa.RecordBatch.from_arrays([pa.array(below.view(np.int64)), pa.array(np.tile(batch["rep"].to_numpy(), 2))], names=["node", "rep"])

    return members.select("node", "rep", "sig").mapInArrow(run, "node long, rep long")


class Forest:
    """Union-find over 0 to n-1; a tree's root is its smallest number."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def links(self) -> list[tuple[int, int]]:
        """Each tree's root with every other member: as few links as possible, and one for each member."""
        return [(self.find(x), x) for x in range(len(self.parent)) if self.parent[x] != x]


def compare_leaves(members: DataFrame, least: int) -> DataFrame:
    """Spanning links (a, b) of the classes in each small node whose signatures agree on ``least`` tokens or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["node"]):
            bounds = group_bounds(table, ["node"])
            rep = table["rep"].to_numpy()
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, TOKENS)
            sizes = np.diff(bounds)
            twos = bounds[:-1][sizes == 2]
            good = twos[(sig[twos] == sig[twos + 1]).sum(1) >= least]
            a, b = [rep[good]], [rep[good + 1]]
            for at, to in zip(bounds[:-1][sizes > 2], bounds[1:][sizes > 2], strict=True):
                own, forest = sig[at:to], Forest(to - at)
                for i in range(to - at - 1):
                    for j in np.flatnonzero((own[i + 1 :] == own[i]).sum(1) >= least) + i + 1:
                        forest.join(i, int(j))
                if found := forest.links():
                    pairs = np.array(found) + at
                    a.append(rep[pairs[:, 0]])
                    b.append(rep[pairs[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return members.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(run, "a long, b long")


def _alike(common, p, q, percent: int):
    return 100 * common >= percent * (p + q - common)


def reached(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each set has 100 * intersection >= percent * union with the first one."""
    n = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    at = np.minimum(np.searchsorted(sets[0], flat), len(sets[0]) - 1)
    common = np.bincount(owner[sets[0][at] == flat], minlength=len(sets))
    return _alike(common, n[0], n, percent)


def exact_links(sets: list[np.ndarray], percent: int, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of all pairs with 100 * intersection >= percent * union, by counting every pair's common shingles.

    Sets ``asked`` (by default those that the first set doesn't reach) are
    compared with every other one, by products of incidence matrices.
    """
    n = np.array([len(s) for s in sets])
    forest = Forest(len(sets))
    if asked is None:
        near = reached(sets, percent)
        for j in np.flatnonzero(near)[1:]:
            forest.join(0, int(j))
        rest = np.flatnonzero(~near)
    else:
        rest = np.flatnonzero(asked)
    if len(rest):
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        code = np.cumsum(np.append(0, flat[1:] != flat[:-1])) if len(flat) else flat
        shared = np.bincount(code)[code] > 1
        code, owner = np.unique(code[shared], return_inverse=True)[1], owner[shared]
        inter = np.zeros((len(rest), len(sets)), np.float32)
        width = max(256, 4_000_000 // len(sets))
        edges = np.searchsorted(code, np.arange(0, (code[-1] if len(code) else -1) + 1 + width, width))
        for step, (p, q) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            x = np.zeros((len(sets), width), np.float32)
            x[owner[p:q], code[p:q] - step * width] = 1
            inter += x[rest] @ x.T
        inter = inter.astype(np.int64)
        i, j = np.nonzero(_alike(inter, n[rest][:, None], n[None, :], percent))
        for a, b in zip(rest[i].tolist(), j.tolist(), strict=True):
            if a != b:
                forest.join(a, b)
    return forest.links()


def with_sets(members: DataFrame, k: int) -> DataFrame:
    """``members`` (with a column text) with set, the sorted hashes of distinct shingles, in the text's place."""
    schema = members.withColumn("set", F.lit(b"")).drop("text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = binaries([s.tobytes() for s in shingle_sets(batch["text"], k)])
                yield pa.RecordBatch.from_arrays([sets if f.name == "set" else batch[f.name] for f in schema], names=[f.name for f in schema])

    return members.mapInArrow(run, schema)


WHOLE, STAR, REST, ALL = 0, 1, 2, 3  # roles of a row in a cell


def verify(cells: DataFrame, percent: int) -> DataFrame:
    """Exact spanning links (a, b) of each (cluster, cell) of rows (cluster, cell, role, rep, set).

    Rows of a WHOLE cell meet each other, rows of a STAR cell the cluster's
    first set, REST rows of the other cells all rows of their cell.
    """
    keys = ["cluster", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            bounds = group_bounds(table, keys)
            cluster, role, rep = (table[c].to_numpy() for c in ("cluster", "role", "rep"))
            sets = [np.frombuffer(s, U64) for s in table["set"].to_pylist()]
            links = [np.zeros((0, 2), np.int64)]
            for at, to in zip(bounds[:-1], bounds[1:], strict=True):
                own = sets[at:to]
                if role[at] == WHOLE:
                    found = exact_links(own, percent)
                elif role[at] == STAR:
                    hub = int(np.flatnonzero(rep[at:to] == cluster[at])[0])
                    near = reached([own[hub], *own], percent)[1:]
                    found = [(hub, int(j)) for j in np.flatnonzero(near)]
                else:
                    found = exact_links(own, percent, role[at:to] == REST)
                links.append(np.array(found, np.int64).reshape(-1, 2) + at)
            pairs = np.concatenate(links)
            a, b = rep[pairs[:, 0]], rep[pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return cells.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(run, "a long, b long")


def links_in_clusters(scratch: Scratch, members: DataFrame, percent: int) -> DataFrame:
    """Exact spanning links (a, b) inside clusters of rows (cluster, rep, chunk, chunks, set)."""
    columns = ["cluster", "cell", "role", "rep", "set"]
    role = lambda x: F.lit(x).alias("role")
    cell = F.when((F.col("chunks") > 1) & (F.col("rep") == F.col("cluster")), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    first = members.select("cluster", "rep", "set", "chunks", F.explode(cell.cast("array<bigint>")).alias("cell")).withColumn("role", F.when(F.col("chunks") > 1, STAR).otherwise(WHOLE))
    links = scratch.write(verify(first.select(*columns), percent))
    large = members.where("chunks > 1")
    rest = large.where("rep <> cluster").join(links.select(F.col("b").alias("rep")), "rep", "left_anti")
    rest = scratch.write(rest)
    parts = rest.groupBy("cluster").agg(F.ceil(F.count("*") / CHUNK_SETS).cast("int").alias("parts"), F.first("chunks").alias("n"))
    if rest.isEmpty():
        return links
    parts = scratch.write(parts.withColumnRenamed("cluster", "of"))
    at = lambda p, q: (p.cast("long") * F.col("n") + q).alias("cell")
    part = F.pmod(F.xxhash64("rep", F.lit(1)), "parts")
    asking = rest.join(parts, F.col("cluster") == F.col("of")).select("cluster", "rep", "set", "n", part.alias("p"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("q"))
    others = large.join(parts, F.col("cluster") == F.col("of")).select("cluster", "rep", "set", "n", "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    cells = asking.select("cluster", at(F.col("p"), F.col("q")), role(REST), "rep", "set").unionByName(others.select("cluster", at(F.col("p"), F.col("chunk")), role(ALL), "rep", "set"))
    return links.unionByName(verify(cells, percent))


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id and kept of every row of ``docs`` (doc_id, text).

    Texts are lower-cased in A-Z and cut at ASCII white space; a text's set is
    its distinct k-word shingles (the whole sequence where there are fewer
    words). Documents whose sets have 100 * intersection >= percent * union
    are linked. class_id is the smallest doc_id with an equal set,
    component_id the smallest one reachable over links, kept tells whether
    that is the row's own. Null and wordless texts have no shingles and link
    with nothing. Rows without doc_id are not linked: their class and
    component are null and they are kept. Rows repeated under one id are one
    document. Empty tables give no rows; extra columns are ignored.
    """
    scratch = Scratch(spark)
    threshold = percent / 100
    trees = math.ceil(math.log(MISSED) / math.log(1 - threshold**PER_LEVEL))
    least = math.floor(TOKENS * threshold - 5.5 * math.sqrt(TOKENS * threshold * (1 - threshold)))
    rows = scratch.write(describe(docs, k))
    full = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = scratch.write(full.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))

    links = []
    members = branch(classes, trees)
    for level in range(LEVELS):
        members = scratch.write(members)
        # a second key deals the counts anew beside the members, so that the join can split large nodes
        sizes = members.groupBy("node").count().where("count > 1").withColumn("h", F.xxhash64("node"))
        inside = members.withColumn("h", F.xxhash64("node")).join(sizes, ["node", "h"]).select("node", "rep", (F.col("count") > LEAF).alias("large")).distinct()
        inside = scratch.write(inside)
        scratch.drop(members)
        signed = inside.join(classes.select(F.col("rep").alias("r"), "sig"), F.col("rep") == F.col("r")).drop("r")
        links.append(compare_leaves(signed.where("NOT large"), least))
        large = inside.where("large")
        if large.isEmpty():
            break
        if level == LEVELS - 1:
            hub = large.groupBy("node").agg(F.min("rep").alias("a")).withColumnRenamed("node", "at")
            links.append(large.join(hub, F.col("node") == F.col("at")).select("a", F.col("rep").alias("b")))
        members = branch_again(signed.where("large"))
    clusters = connected_components(scratch, reduce(DataFrame.unionByName, links))

    sized = classes.join(clusters, F.col("rep") == F.col("id")).select("rep", "n", F.col("component").alias("cluster"))
    total = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / CHUNK_SHINGLES), F.ceil(F.count("*") / CHUNK_SETS)).cast("int").alias("chunks"))
    total = total.withColumnRenamed("cluster", "of")
    chunked = sized.join(total, F.col("cluster") == F.col("of")).select("rep", "cluster", "chunks", F.pmod(F.xxhash64("rep"), "chunks").cast("int").alias("chunk"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    members = scratch.write(with_sets(chunked.join(texts, F.col("rep") == F.col("id")).drop("id"), k).where(F.length("set") > 0))
    groups = connected_components(scratch, links_in_clusters(scratch, members, percent))

    known = classes.join(groups, F.col("rep") == F.col("id"), "left").select(F.col("set1").alias("s1"), F.col("set2").alias("s2"), "rep", "component")
    own = rows.join(known, (F.col("set1") == F.col("s1")) & (F.col("set2") == F.col("s2")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
    class_id, component = F.coalesce("rep", "doc_id"), F.coalesce("component", "rep", "doc_id")
    return own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), class_id).alias("class_id"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(spark, docs, k=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id AS start, doc_id AS id FROM s UNION SELECT start, b FROM r JOIN l ON a = id),
k AS (SELECT start AS doc_id, min(id) AS component_id FROM r GROUP BY start),
y AS (SELECT doc_id, list_sort(s) AS s FROM s),
z AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY s) ELSE doc_id END AS class_id FROM y)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept, class_id FROM n JOIN k USING (doc_id) JOIN z USING (doc_id)
"""
