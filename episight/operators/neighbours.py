"""Exact nearest neighbours through inverted lists.

Centres (a bounded, hashed sample of the vectors, moved a few times to their
members' means) own lists.  A query first searches the list of its nearest
centre; the best distance there says which other lists can hold something nearer (those
whose centre is no farther than that distance plus the list's radius), and only they are
searched.  So the answer is that of a search through everything, by the triangle
inequality; how many lists are visited depends on how clustered the vectors are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage, shared_dir
from ..sources.episode_source import filesystem

#: Vectors of a list on average; most lists (their centres are sent to all tasks); vectors of a list in one block.
LIST, MOST_LISTS, BLOCK = 1024, 4096, 4096
#: Queries that a task holds at a time, and those of them that are compared with a block at once.
CHUNK, TILE = 8192, 512
QUERY = "list long, kind long, k long, x array<double>, d double, j long"
QUERY_NAMES = ["list", "kind", "k", "x", "d", "j"]
#: Stands for a second key that isn't there.
NONE = np.iinfo(np.int64).min


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, by differences and not products: exact for equal rows."""
    out = np.zeros((len(a), len(b)))
    for c in range(a.shape[1]):
        out += (a[:, c, None] - b[None, :, c]) ** 2
    return out


def _centres(ref: DataFrame, n: int, width: int, rounds: int = 3) -> np.ndarray:
    """At most ``MOST_LISTS`` centres, from at most eight times as many sampled vectors."""
    lists = max(1, min(MOST_LISTS, -(-n // LIST)))
    if lists == 1:
        return np.zeros((1, width))
    sample = np.array([r.x for r in ref.orderBy(F.xxhash64("k"), "k").limit(8 * lists).select("x").collect()])
    centres = sample[:lists]
    for _ in range(rounds):
        own = np.concatenate([_squares(sample[s : s + 512], centres).argmin(1) for s in range(0, len(sample), 512)])
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        count = np.bincount(own, minlength=lists)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def _owner(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the distance to it."""
    if len(centres) == 1:
        return np.zeros(len(x), np.int64), np.sqrt(_squares(x, centres)[:, 0])
    own, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for s in range(0, len(x), 512):
        d = _squares(x[s : s + 512], centres)
        own[s : s + 512] = d.argmin(1)
        far[s : s + 512] = np.sqrt(d.min(1))
    return own, far


def _written(members: DataFrame, width: int, path: str) -> list:
    """Members (list, k, x, u) into files of the shared folder ``path``, a batch of at most ``BLOCK`` a
    piece of a list, in order of keys; returns (file, at, list, n, radius) of all, a row a batch.
    A task that is tried again writes another file; only what is returned is read."""
    n_parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(n_parts, "list").sortWithinPartitions("list", "k")
    block = BLOCK

    def run(batches) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("k", pa.int64()), ("x", pa.list_(pa.float64())), ("u", pa.int64())])
        files, root = filesystem(path)
        name, writer, told, held = uuid.uuid4().hex, None, [], []

        def put(rows: list, writer):
            writer = writer or pa.ipc.new_file(files.open_output_stream(f"{root}/{name}"), schema)
            t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            writer.write_batch(pa.RecordBatch.from_arrays([t.column("k"), t.column("x"), t.column("u").fill_null(int(NONE))], schema=schema))
            told.append((name, len(told), t.column("list")[0].as_py(), t.num_rows, pc.max(t.column("far")).as_py()))
            return writer

        n = 0
        for b in batches:
            lists = b.column("list").to_numpy()
            for s, e in _runs(lists):
                while s < e:
                    if held and (n == block or held[0].column("list")[0].as_py() != lists[s]):
                        writer, held, n = put(held, writer), [], 0
                    take = min(e - s, block - n)
                    held.append(b.slice(s, take))
                    s, n = s + take, n + take
        if held:
            writer = put(held, writer)
        if writer:
            writer.close()
            names = ["file", "at", "list", "n", "radius"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*told)], names=names)

    return dealt.mapInArrow(run, "file string, at long, list long, n long, radius double").collect()


def _runs(a: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of equal values that stand together."""
    if not len(a):
        return []
    edges = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)]
    return list(zip(edges, edges[1:]))


def _better(q, x, best, name, member: tuple, exclude_self: bool) -> None:
    """Lowers ``best`` (squared distances) and ``name`` (keys) of queries by a block of members (keys in
    order, vectors, second keys).  Products say which members may be nearest, with all that their
    error allows; only these are compared by differences, so the result is that of ``_squares``."""
    own, y, second = member
    yy = np.einsum("ij,ij->i", y, y)
    for p in range(0, len(q), TILE):
        k, v = q[p : p + TILE], x[p : p + TILE]
        vv = np.einsum("ij,ij->i", v, v)
        slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (vv + yy.max()) + np.finfo(float).tiny
        if np.isfinite(slack).all():
            about = v @ y.T
            about *= -2
            about += vv[:, None]
            about += yy
        else:
            about, slack = _squares(v, y), np.zeros(len(k))
            about[np.isnan(about)] = np.inf
        if exclude_self:
            at = np.minimum(np.searchsorted(own, k), len(own) - 1)
            alone = (own[at] == k) & (second[at] == NONE)
            about[np.flatnonzero(alone), at[alone]] = np.inf
        low = about.min(1)
        some = np.flatnonzero(np.isfinite(low) & (low <= best[p : p + TILE] + slack))
        for c in range(0, len(some), 64):
            rows = some[c : c + 64]
            i, m = np.nonzero(about[rows] <= (low[rows] + slack[rows])[:, None])
            i = rows[i]
            d = np.zeros(len(i))
            for j in range(x.shape[1]):
                d += (v[i, j] - y[m, j]) ** 2
            other = np.where(own[m] == k[i], second[m], own[m]) if exclude_self else own[m]
            order = np.lexsort((other, d, i))
            first = order[np.r_[True, np.diff(i[order]) != 0]]
            i, d, other = i[first] + p, d[first], other[first]
            lower = (d < best[i]) | ((d == best[i]) & (other < name[i]))
            best[i[lower]], name[i[lower]] = d[lower], other[lower]


def _reach(far: np.ndarray, best: np.ndarray, radius) -> np.ndarray:
    """Whether a list so far away can hold something as near as the best."""
    return far <= (np.sqrt(best) + radius) * (1 + 1e-12) + 1e-12


def _search(rows: DataFrame, blocks: list, centres: np.ndarray, radius: np.ndarray, path: str, own_lists: bool, exclude_self: bool) -> DataFrame:
    """Queries (list, kind, k, x, d, j) with d and j, the nearest squared distance and who has it (the smallest key of equals),
    after their own lists are searched, or else all others that can hold something nearer than d.

    Tasks hold some thousand queries and read one block of members after the other from the shared
    folder, so nothing is sent: what is written doesn't grow with the lists that queries visit."""
    width = centres.shape[1]
    by_list: dict = {}
    for r in blocks:
        by_list.setdefault(r["list"], []).append((r["file"], r["at"]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(path)
        opened: dict = {}

        def member(file: str, at: int) -> tuple:
            if file not in opened:
                opened[file] = pa.ipc.open_file(files.open_input_file(f"{root}/{file}"))
            b = opened[file].get_batch(at)
            return b.column(0).to_numpy(), _matrix(b.column(1), width), b.column(2).to_numpy()

        for b in gathered(batches):
            lists, k, x = b.column(0).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3), width)
            best, name = b.column(4).to_numpy().copy(), b.column(5).to_numpy().copy()
            for number, places in by_list.items():
                if own_lists:
                    ask = np.flatnonzero(lists == number)
                else:
                    ask = np.flatnonzero(lists != number)
                    ask = ask[_reach(np.sqrt(_squares(x[ask], centres[number : number + 1])[:, 0]), best[ask], radius[number])]
                for place in places if len(ask) else ():
                    q, v, d, j = k[ask], x[ask], best[ask], name[ask]
                    _better(q, v, d, j, member(*place), exclude_self)
                    best[ask], name[ask] = d, j
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)] + [pa.array(best), pa.array(name)], names=QUERY_NAMES)

    def gathered(batches) -> Iterator[pa.RecordBatch]:
        """Batches of ``CHUNK`` rows and more."""
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= CHUNK:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return rows.mapInArrow(run, QUERY)


def nearest(query: DataFrame, ref: DataFrame, cols: list[str], key: str = "ep", exclude_self: bool = False) -> DataFrame:
    """(key, neighbour, distance): the nearest row of ``ref`` by Euclidean
    distance over sqrt(dimensions); the smallest key wins ties.

    Keys are unique; rows with a null or a NaN take no part.  Equal vectors are
    searched once, whatever their number, and a list of over ``BLOCK`` vectors is
    cut into blocks.  Lists lie in the shared folder while they are searched.
    """
    width, spark = len(cols), ref.sparkSession

    def cut(df: DataFrame) -> DataFrame:
        fine = F.lit(True)
        for c in cols:
            fine = fine & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        return df.where(fine).select(F.col(key).cast("long").alias("k"), F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in cols]).alias("x"))

    # the two smallest keys of each vector
    one = cut_lineage(cut(ref).groupBy("x").agg(F.min("k").alias("k"), F.count("*").alias("c"), F.max("k").alias("last")))
    n, n_many = one.agg(F.count("*"), F.count(F.when(F.col("c") > 2, 1))).first()
    if not n:
        return query.select(key).where("false").select(F.col(key), F.lit(None).cast("long").alias("neighbour"), F.lit(None).cast("double").alias("distance"))
    last = F.when(F.col("c") == 2, F.col("last"))
    if n_many:
        many = one.where("c > 2").select("x", F.col("k").alias("low"))
        later = cut(ref).join(many, "x").where("k > low").groupBy("x").agg(F.min("k").alias("next"))
        vectors = cut_lineage(one.join(later, "x", "left").select("k", "x", F.coalesce(last, "next").alias("u")))
    else:
        vectors = one.select("k", "x", last.alias("u"))
    centres = _centres(vectors, n, width)

    def placed(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, far = _owner(_matrix(b.column(1), width), centres)
                yield pa.RecordBatch.from_arrays([pa.array(own), *b.columns, pa.array(far)], names=["list", *b.schema.names, "far"])

    path = f"{shared_dir(spark).rstrip('/')}/nearest-{uuid.uuid4().hex[:12]}"
    files, root = filesystem(path)
    files.create_dir(root)
    try:
        blocks = _written(vectors.mapInArrow(placed, "list long, k long, x array<double>, u long, far double"), width, path)
        radius = np.full(len(centres), -np.inf)
        for r in blocks:
            radius[r["list"]] = max(radius[r["list"]], r["radius"])
        n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        asked = cut(query).repartition(n_parts, "k").mapInArrow(placed, "list long, k long, x array<double>, far double")
        start = asked.select("list", F.lit(1).cast("long").alias("kind"), "k", "x", F.lit(float("inf")).alias("d"), F.lit(int(np.iinfo(np.int64).max)).alias("j"))
        found = cut_lineage(_search(start, blocks, centres, radius, path, True, exclude_self))
        best = found.select("k", "d", "j")
        if len(centres) > 1:

            def open_(batches) -> Iterator[pa.RecordBatch]:
                """Those whose own list may not hold their nearest."""
                for b in batches:
                    lists, x, d = b.column(0).to_numpy(), _matrix(b.column(3), width), b.column(4).to_numpy()
                    more = np.zeros(b.num_rows, bool)
                    for s in range(0, b.num_rows, 512):
                        can = _reach(np.sqrt(_squares(x[s : s + 512], centres)), d[s : s + 512, None], radius[None, :])
                        can[np.arange(len(can)), lists[s : s + 512]] = False
                        more[s : s + 512] = can.any(1)
                    yield b.filter(pa.array(more))

            more = _search(found.mapInArrow(open_, QUERY), blocks, centres, radius, path, False, exclude_self)
            more = more.select("k", "d", "j")
            best = cut_lineage(best.unionByName(more).groupBy("k").agg(F.min(F.struct("d", "j")).alias("m")).select("k", "m.d", "m.j"))
    finally:
        files.delete_dir(root)
    return best.where(F.col("d") < float("inf")).select(F.col("k").alias(key), F.col("j").alias("neighbour"), (F.sqrt("d") / F.lit(float(np.sqrt(width)))).alias("distance"))
