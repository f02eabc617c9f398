"""Approximate nearest neighbours by inner product, with a forest of hash prefixes.

A vector's *hash string* in a tree is the signs of its products with random
directions.  Vectors are shifted by their mean (which changes no ranking of a query)
and get one more component that makes their norms equal, so strings that share a
long prefix have a large inner product.  A tree is the sorted array of its strings,
cut at prefixes of variable length into leaves of at most ``LEAF`` rows; the
table of all leaves has at most some hundred thousand rows and is known everywhere.

A query descends in each tree to the leaf of its own string.  Then all trees
ascend together: the level x is lowered until the subtrees under its prefixes
of length x (or its leaf, where that is shorter) hold ``m`` rows in all.  The
leaves of these subtrees are its candidates; each is scored with the original vectors.

``m`` is fitted: the true neighbours of a bounded sample of queries are found
by brute force, in one pass, and m is the smallest number with which the
sample's recall is the one asked for.  Where vectors have no structure that is
a large share of all rows; where they have clusters it is a small one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from .common import cut_lineage
from .simhash import by_group

#: Length of a hash string; rows of a leaf; most leaves there may be about.
BITS, LEAF, MOST_LEAVES = 62, 2048, 1 << 16
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and their dimension: rows with an id and a
    vector of the most frequent length (ties: the longer), whose components are
    finite and not all zero.  Repeated rows count once; of several vectors
    with one id the smallest stays."""
    v = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = size[0] if size else 0
    rows = rows.where(F.size("v") == d)
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    return rows, d


def without_copies(rows: DataFrame, keep: int) -> DataFrame:
    """``rows`` (id, v) with the ``keep`` smallest ids of each vector.  Only
    vectors that are repeated more often are shuffled."""
    key = F.xxhash64("v")
    many = cut_lineage(rows.groupBy(key.alias("key")).count().where(F.col("count") > keep).select("key"))
    n = many.count()
    if not n:
        return rows
    many = F.broadcast(many) if n * 16 <= 16 << 20 else many
    keyed = rows.withColumn("key", key)
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    hot = keyed.join(many, "key", "left_semi").withColumn("_k", place).where(F.col("_k") <= keep)
    return keyed.join(many, "key", "left_anti").select("id", "v").unionByName(hot.select("id", "v"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of a list or binary column as doubles."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        flat = b"".join(column.to_pylist())
        return np.frombuffer(flat, np.float32 if len(flat) == 4 * d * len(column) else np.float64).astype(np.float64).reshape(-1, d)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def centre(rows: DataFrame, d: int) -> tuple[np.ndarray, float, int]:
    """Mean, largest distance from it, and number of the vectors."""

    def sums(batches):
        total, n = np.zeros(d), 0
        for b in batches:
            v = matrix(b.column(0), d)
            total, n = total + v.sum(0), n + len(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1)), pa.array(np.append(total, n))], names=["k", "x"])

    got = dict(tuple(r) for r in rows.select("v").mapInArrow(sums, "k long, x double").groupBy("k").agg(F.sum("x")).collect())
    n = int(got.get(d, 0))
    mean = np.array([got[k] for k in range(d)]) / max(n, 1)

    def furthest(batches):
        far = 0.0
        for b in batches:
            if b.num_rows:
                far = max(far, float(np.linalg.norm(matrix(b.column(0), d) - mean, axis=1).max()))
        yield pa.RecordBatch.from_arrays([pa.array([far])], names=["far"])

    return mean, rows.select("v").mapInArrow(furthest, "far double").agg(F.max("far")).first()[0] or 0.0, n


class Hashes:
    """Hash strings, as non-negative longs, a column for each tree."""

    def __init__(self, mean: np.ndarray, far: float, trees: int, seed: int):
        self.mean, self.far, self.trees = mean, far or 1.0, trees
        self.planes = np.random.default_rng(seed).standard_normal((len(mean) + 1, trees * BITS))

    def _signs(self, x: np.ndarray) -> np.ndarray:
        bit = (x @ self.planes > 0).reshape(len(x), self.trees, BITS)
        bit = np.concatenate([np.zeros((len(x), self.trees, 64 - BITS), bool), bit], axis=2)
        return np.packbits(bit, axis=2).view(">u8").reshape(len(x), self.trees).astype(np.int64)

    def of_rows(self, v: np.ndarray) -> np.ndarray:
        x = (v - self.mean) / self.far
        return self._signs(np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))]))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return self._signs(np.hstack([q / np.abs(q).max(1, keepdims=True), np.zeros((len(q), 1))]))


def hashed(rows: DataFrame, d: int, hashes: Hashes, queries: bool) -> DataFrame:
    """(id, v, h): v as bytes (of floats, if they were floats)."""
    kind = np.float32 if isinstance(rows.schema["v"].dataType, ArrayType) and isinstance(rows.schema["v"].dataType.elementType, FloatType) else np.float64

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                v = matrix(b.column(1), d)
                h = hashes.of_queries(v) if queries else hashes.of_rows(v)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * h.shape[1]), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v.astype(kind)], pa.binary()), lists], names=["id", "v", "h"])

    return cut_lineage(rows.mapInArrow(run, "id long, v binary, h array<long>"))


class Leaves:
    """The leaves of all trees: where each starts, how long its prefix is, how many rows it has."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int):
        self.start = [t[0] for t in trees]
        self.length = [t[1] for t in trees]
        self.count = [t[2] for t in trees]
        self.below = [np.concatenate([[0], np.cumsum(c)]) for c in self.count]
        self.blocks = [np.maximum(1, -(-c // most)) for c in self.count]
        first = np.cumsum([0, *(int(b.sum()) for b in self.blocks)])
        #: number of a leaf's first block
        self.number = [first[t] + np.cumsum(b) - b for t, b in enumerate(self.blocks)]

    def leaf(self, tree: int, h: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start[tree], h, "right") - 1

    def under(self, tree: int, h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves [a, b) under the prefix of ``level`` bits of h, or h's leaf if its prefix is shorter."""
        own = self.leaf(tree, h)
        shift = (BITS - np.minimum(level, self.length[tree][own])).astype(np.int64)
        low = h >> shift << shift
        a = np.searchsorted(self.start[tree], low, "left")
        return a, np.searchsorted(self.start[tree], low + (np.int64(1) << shift), "left")

    def held(self, h: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Rows in all subtrees at a level for each query's strings."""
        out = np.zeros(len(h), np.int64)
        for t in range(h.shape[1]):
            a, b = self.under(t, h[:, t], level)
            out += self.below[t][b] - self.below[t][a]
        return out

    def level(self, h: np.ndarray, m: int) -> np.ndarray:
        """The deepest level at which the subtrees hold m rows; 0 if none does."""
        level = np.max([self.length[t][self.leaf(t, h[:, t])] for t in range(h.shape[1])], axis=0)
        open_ = np.flatnonzero(level > 0)
        while len(open_):
            few = self.held(h[open_], level[open_]) < m
            open_ = open_[few]
            level[open_] -= 1
            open_ = open_[level[open_] > 0]
        return level


def find_leaves(index: DataFrame, n: int, trees: int, leaf: int) -> Leaves:
    """Count prefixes of the strings, and those with too many rows again with more bits.

    The driver gets counts only: some eight for each leaf."""
    most = max(leaf, -(-n * trees // MOST_LEAVES))
    depth = min(BITS, max(0, int(np.ceil(np.log2(max(1, n / most))))))
    strings = index.select(F.posexplode("h").alias("tree", "h"))

    def counts(rows: DataFrame, bits: int) -> dict:
        return {(r[0], r[1]): r[2] for r in rows.groupBy("tree", F.shiftright("h", BITS - bits).alias("p")).agg(F.count("*")).collect()}

    found = [dict() for _ in range(trees)]  # start -> (length, count)
    level = counts(strings, depth)
    whole = [(t, p) for t in range(trees) for p in range(1 << depth)]
    while True:
        hot = []
        for t, p in whole:
            n_here = level.get((t, p), 0)
            if n_here > most and depth < BITS:
                hot.append((t, p))
            else:
                found[t][p << (BITS - depth)] = (depth, n_here)
        if not hot:
            break
        more = min(3, BITS - depth)
        few = index.sparkSession.createDataFrame(hot, "tree int, p long")
        level = counts(strings.withColumn("p", F.shiftright("h", BITS - depth)).join(F.broadcast(few), ["tree", "p"], "left_semi"), depth + more)
        whole = [(t, (p << more) + k) for t, p in hot for k in range(1 << more)]
        depth += more
    made = []
    for f in found:
        start = np.array(sorted(f), np.int64)
        made.append((start, np.array([f[s][0] for s in start.tolist()], np.int64), np.array([f[s][1] for s in start.tolist()], np.int64)))
    return Leaves(made, most)


def best(ids: np.ndarray, v: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, positions, scores) of the k nearest of v for each query, without the query's own id; ties to smaller ids.

    The product of the matrices chooses; products summed alike for each pair are the scores."""
    rough = q @ v.T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    last = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
    slack = 1e-12 * v.shape[1] * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max(initial=0)
    for i in range(len(q)):
        at = np.flatnonzero((rough[i] >= last[i] - slack[i]) & (rough[i] > -np.inf))
        score = (v[at] * q[i]).sum(1)
        order = np.lexsort((ids[at], -score))[:k]
        yield i, at[order], score[order]


def fit(index: DataFrame, queries: DataFrame, d: int, leaves: Leaves, k: int, recall: float, sample: int) -> int:
    """The smallest m with which the sampled queries find a share ``recall`` of their k true neighbours."""
    some = queries.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    q = matrix(pa.array([bytes(r.v) for r in some], pa.binary()), d)
    q_ids, q_h = np.array([r.id for r in some]), np.array([r.h for r in some], np.int64)

    def near(batches):
        held = [[] for _ in q_ids]
        for b in batches:
            if not b.num_rows:
                continue
            ids, h = b.column(0).to_numpy(), b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            for i, at, score in best(ids, matrix(b.column(1), d), q_ids, q, k):
                held[i] = sorted([*held[i], *zip(-score, ids[at].tolist(), h[at].tolist())], key=lambda x: x[:2])[:k]
        rows = [(i, -s, v, h) for i, x in enumerate(held) for s, v, h in x]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
            names=["q", "score", "id", "h"],
        )

    top = index.mapInArrow(near, "q long, score double, id long, h array<long>")
    true = top.withColumn("_k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("_k") <= k).select("q", "h").collect()
    if not true:
        return 1
    own = q_h[[r.q for r in true]]
    other = np.array([r.h for r in true], np.int64)
    length = np.stack([leaves.length[t][leaves.leaf(t, own[:, t])] for t in range(own.shape[1])], axis=1)
    diff = own ^ other
    shared = np.where(diff == 0, BITS, BITS - 1 - np.floor(np.log2(np.maximum(diff, 1).astype(np.longdouble))).astype(np.int64))
    deepest = np.where(shared >= length, BITS, shared).max(1)  # the deepest level at which it is found
    need = np.where(deepest == BITS, 1, leaves.held(own, deepest + 1) + 1)
    return int(np.sort(need)[int(np.ceil(recall * len(need))) - 1])


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 10, leaf: int = LEAF, recall: float = 0.96, sample: int = 128, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest of ``vectors`` for each row of ``queries``, by inner product in double precision.

    Returns query_id, rank (from 1), vec_id and score, nearest first, ties to
    the smaller vec_id; all others if there are fewer than k.  A query's own id is no
    candidate.  Every row is indexed; ``sample`` queries fit how many
    candidates are looked at, for a share ``recall`` of the true neighbours.

    Rows without an id or vector, with null or non-finite components, all zeros or another length than
    most take no part.  Repeated rows count once; of several vectors with
    one id the smallest counts.  A vector that more than k rows share is indexed
    with its k + 1 smallest ids, as no others can be among the k nearest.  An empty
    table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, d = usable(vectors, id_col, vec_col)
    rows = cut_lineage(rows)
    asked, dq = usable(queries, id_col, vec_col)
    if not d or dq != d and not (asked := asked.where(F.size("v") == d)).limit(1).count():
        return spark.createDataFrame([], RESULT)
    mean, far, _ = centre(rows, d)
    hashes = Hashes(mean, far, trees, seed)
    index = hashed(without_copies(rows, k + 1), d, hashes, False)
    asking = hashed(asked, d, hashes, True)
    n = index.count()
    leaves = find_leaves(index, n, trees, leaf)
    # a level with so many rows has k others in one of its trees
    m = max(trees * (k + 1), fit(index, asking, d, leaves, k, recall, sample))

    def place(batches):
        for b in batches:
            h = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            ids = b.column(0).to_numpy()
            for t in range(trees):
                own = leaves.leaf(t, h[:, t])
                node = leaves.number[t][own] + (ids * np.int64(0x9E3779B97F4A7C1)) % leaves.blocks[t][own]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.zeros(b.num_rows, np.int64)), b.column(0), b.column(1)], names=["node", "kind", "id", "v"])

    def visit(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                b = whole.slice(s, 500)
                h = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
                level = leaves.level(h, m)
                for t in range(trees):
                    a, z = leaves.under(t, h[:, t], level)
                    if t:  # at the root every tree has all rows
                        z = np.where(level == 0, a, z)
                    last = leaves.number[t][np.maximum(z - 1, 0)] + leaves.blocks[t][np.maximum(z - 1, 0)]
                    first = leaves.number[t][np.minimum(a, len(leaves.number[t]) - 1)]
                    many = np.where(z > a, last - first, 0)
                    row = np.repeat(np.arange(b.num_rows), many)
                    node = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
                    for at in range(0, len(row), 5000):
                        r = pa.array(row[at : at + 5000])
                        yield pa.RecordBatch.from_arrays([pa.array(node[at : at + 5000]), pa.array(np.ones(len(r), np.int64)), b.column(0).take(r), b.column(1).take(r)], names=["node", "kind", "id", "v"])

    schema = "node long, kind long, id long, v binary"
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.mapInArrow(place, schema).unionByName(asking.mapInArrow(visit, schema)).repartition(n_parts, "node").sortWithinPartitions("node", "kind", "id")

    def score(batches):
        at, held, ids, v = None, [], None, None
        for b in batches:
            node, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(node) != 0) | (np.diff(kind) != 0)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for s, e in zip(edges, edges[1:]):
                if node[s] != at:
                    at, held, v = node[s], [], None
                if kind[s] == 0:
                    held.append((b.column(2)[s:e].to_numpy(), matrix(b.column(3)[s:e], d)))
                    continue
                if not held and v is None:
                    continue  # an empty leaf
                if v is None:
                    ids, v, held = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), []
                for p in range(s, e, 256):
                    part = b.slice(p, min(256, e - p))
                    q_ids = part.column(2).to_numpy()
                    got = [(q_ids[i], ids[x], y) for i, x, y in best(ids, v, q_ids, matrix(part.column(3), d), k)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"]
                    )

    found = dealt.mapInArrow(score, "query_id long, ids array<long>, scores array<double>")

    def merged(key, columns):
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        for x, y in zip(*columns):  # the k best so far and a leaf's: never more
            ids, scores = np.append(ids, x), np.append(scores, y)
            order = np.lexsort((ids, -scores))
            ids, scores = ids[order], scores[order]
            _, first = np.unique(ids, return_index=True)
            first = np.sort(first)[:k]
            ids, scores = ids[first], scores[first]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key[0])), pa.array(np.arange(1, len(ids) + 1, dtype=np.int32)), pa.array(ids), pa.array(scores)], names=["query_id", "rank", "vec_id", "score"])

    def merge(batches):
        yield from by_group(batches, 1, merged)

    return found.repartition(n_parts, "query_id").sortWithinPartitions("query_id").mapInArrow(merge, RESULT)
