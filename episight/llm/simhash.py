"""Near-duplicates by SimHash with bit-sliced comparison.

A fingerprint's bit is 1 where over half of the text's shingle hashes have it
set.  Equal fingerprints are counted once.  For a radius r the 64 bits are cut
into groups, and fingerprints within r bits of each other agree on some r-out
choice of the groups, so only those that share a bucket are compared.  Buckets
have about ``BUCKET`` fingerprints at any input size, as the number of key bits
grows with the number of fingerprints.

In a bucket the fingerprints are stored vertically: plane b holds bit b of all
of them.  One XOR of a plane with a query's bit gives 64 differences a machine
word, and carry-save counters (ones, twos, four-or-more) add them up for all
pairs at once.  Queries whose counters have all passed the radius are dropped
after every few planes, and the bucket is abandoned once none is left.

A bucket gives a spanning forest of its links, not all pairs; the components
come from rounds of neighbour minima over these, which are far fewer than the
documents.  A bucket of many fingerprints is cut into blocks, and each pair of
blocks is a task's work of its own.

``keep_first`` groups documents by the similarity of their sets of word
shingles: buckets come from minima of shingle hashes, and each pair of a bucket
that isn't connected already is checked on the whole sets.  Bit planes of the
sets' fingerprints only say which pairs are checked first, as near ones connect most of a bucket.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, cut_lineage, join_skewed, texts, tidied

BUCKET = 512
#: Fingerprints compared with each other at once; larger buckets go in squares of this side.
SIDE = 1024
#: Members of a block; a bucket with more of them is compared by pairs of blocks.  The second is for buckets that hold
#: whole sets of shingles: all their blocks are compared with the bucket's first ``LEADERS`` members, then with what these don't reach.
SQUARE, SET_SQUARE, LEADERS = 8192, 1024, 8
#: Shingle minima that must agree for a bucket, and buckets of a document: at a
#: similarity of 0.8 two documents miss each other once in 30,000 times, at 0.85 once in 500,000.
MINIMA, BANDS = 3, 14
#: Fingerprints of sets that are 0.8 alike differ in 10 of 64 bits on average; pairs within so many are looked at first, the nearest before the others.
WIDE = 24


def fingerprint(raw: bytes, width: int = 3) -> int:
    """The fingerprint of a text in UTF-8; 0 if it has no words."""
    from xxhash import xxh64_intdigest as h

    words = raw.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= width:
        hashes = [h(b" ".join(words), 42)]
    else:
        flat = b" ".join(words)
        at = [0]
        for w in words:
            at.append(at[-1] + len(w) + 1)
        hashes = [h(flat[a : b - 1], 42) for a, b in zip(at, at[width:])]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    top = 2 * bits.sum(0, dtype=np.int64) > len(hashes)
    return int.from_bytes(np.packbits(top).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long; null texts count as empty."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def buckets_for(n: int, radius: int, bits: int = 64) -> list[list[int]]:
    """Masks' bit positions: each is a choice of whole groups of bits on which
    two fingerprints within ``radius`` may agree, and any two do on one.

    The fewest keys whose buckets have about ``BUCKET`` of ``n`` fingerprints.
    """
    want = max(0, int(np.ceil(np.log2(max(1, n / BUCKET)))))
    for more in (1, 2, 3):  # groups that must agree
        groups = radius + more
        edges = np.linspace(0, bits, groups + 1).astype(int)
        parts = [list(range(a, b)) for a, b in zip(edges, edges[1:])]
        if want <= min(map(len, parts)) * more or more == 3:
            each = -(-want // more)
            return [sum((p[: min(len(p), each)] for p in c), []) for c in combinations(parts, more)]
    raise AssertionError


def near_pairs(fp: np.ndarray, other: np.ndarray, radius: int = 3, check: int = 8, distances: bool = False) -> tuple[np.ndarray, ...]:
    """Indexes (i, j) with fp[i] and other[j] at most ``radius`` (0 to 62) bits apart, and if asked how many.

    The counters start so high that they overflow with one difference too many.
    """
    if not 0 <= radius <= 62:
        raise ValueError("the radius must be 0 to 62")
    n_bits = (radius + 1).bit_length() if radius else 1
    n_bits -= (1 << (n_bits - 1)) == radius + 1 and n_bits > 1
    bias = (1 << n_bits) - 1 - radius
    pad = -len(other) % 64
    bit = np.unpackbits(other.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    planes = np.packbits(np.ascontiguousarray(np.concatenate([bit, np.zeros((pad, 64), np.uint8)]).T), axis=1)
    planes = np.ascontiguousarray(planes).view(np.uint64)
    own = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    spare = np.packbits(np.concatenate([np.zeros(len(other), np.uint8), np.ones(pad, np.uint8)])).view(np.uint64)
    full = np.uint64(2**64 - 1)
    query = np.where(own.T == 1, full, np.uint64(0))
    row = np.arange(len(fp))
    counters = [np.full((len(fp), planes.shape[1]), full if bias >> k & 1 else 0, np.uint64) for k in range(n_bits)]
    far = np.repeat(spare[None, :], len(fp), 0)  # more differences than the radius, or no fingerprint
    for b in range(64):
        carry = planes[b][None, :] ^ query[b][row][:, None]
        for c in counters:
            over = c & carry
            c ^= carry
            carry = over
        far |= carry
        if b % check == check - 1:
            live = ~(far == full).all(1)
            if not live.all():
                row, far, counters = row[live], far[live], [c[live] for c in counters]
                if not len(row):
                    break
    i, j = np.nonzero(np.unpackbits((~far).view(np.uint8), axis=1)) if len(row) else (np.empty(0, np.int64),) * 2
    if not distances:
        return row[i], j
    at = [np.unpackbits(c.view(np.uint8), axis=1)[i, j].astype(np.int64) << k for k, c in enumerate(counters)]
    return row[i], j, (sum(at) - bias if len(row) else np.empty(0, np.int64))


def forest(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the index of the smallest one that links within
    ``radius`` reach.  Squares whose sides are already one component are
    skipped, so a tight group costs little more than its size."""
    root = np.arange(len(fp))

    def flatten() -> None:
        nonlocal root
        while not np.array_equal(up := root[root], root):
            root = up

    for s in range(0, len(fp), SIDE):
        for t in range(s, len(fp), SIDE):
            a, b = slice(s, s + SIDE), slice(t, t + SIDE)
            if s != t and (root[a] == root[s]).all() and (root[b] == root[s]).all():
                continue
            i, j = near_pairs(fp[a], fp[b], radius)
            i, j = i + s, j + t
            while True:  # larger roots hook onto smaller ones until every link is inside a component
                u, v = root[i], root[j]
                open_ = u != v
                if not open_.any():
                    break
                i, j, u, v = i[open_], j[open_], u[open_], v[open_]
                np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
                flatten()
    return root


def squares(keyed: DataFrame, spread: str, side: int | None = None) -> DataFrame:
    """``keyed`` (table, part, ...) with columns block, x and y, dealt out and
    sorted by (table, part, x, y): a bucket of over ``side`` rows (``SQUARE``) is cut into
    blocks by the hash of ``spread``, and there is a group for each pair (x, y)
    of blocks.  Only the large buckets' sizes are kept and joined."""
    side = side or SQUARE
    large = cut_lineage(keyed.groupBy("table", "part").agg(F.count("*").alias("n")).where(f"n > {side}").select("table", "part", F.ceil(F.col("n") / side).cast("int").alias("m")))
    if few := large.count():
        met = keyed.join(F.broadcast(large) if few <= 100_000 else large, ["table", "part"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    else:
        met = keyed.withColumn("m", F.lit(1))
    met = met.withColumn("block", F.pmod(F.xxhash64(spread), F.col("m")).cast("int"))
    met = met.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("x", F.least("block", "_o")).withColumn("y", F.greatest("block", "_o"))
    return dealt(met.drop("m", "_o"), spread)


def dealt(groups: DataFrame, order: str) -> DataFrame:
    """Rows by (table, part, x, y), in order inside.  The number of parts is
    given, as the work goes with pairs and not with the bytes by which Spark would join small parts."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(n, "table", "part", "x", "y").sortWithinPartitions("table", "part", "x", "y", order)


def by_group(batches, keys: int, work):
    """``work(key, columns)`` for each run of equal values in the first ``keys`` columns of sorted batches."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]
        new = np.any([np.diff(c) != 0 for c in cols[:keys]], axis=0)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for s, e in zip(edges, edges[1:]):
            key = tuple(int(c[s]) for c in cols[:keys])
            if key != now:
                if held:
                    yield from work(now, [np.concatenate(c) for c in zip(*held)])
                held, now = [], key
            held.append([c[s:e] for c in cols[keys:]])
    if held:
        yield from work(now, [np.concatenate(c) for c in zip(*held)])


def links(distinct: DataFrame, n: int, radius: int) -> DataFrame:
    """(a, b): links between fingerprints of ``distinct`` (fp), enough to connect all that are within ``radius``.

    Fingerprints are unique there, so a bucket is large only if many different
    ones agree on its bits; such a bucket is compared by pairs of blocks.
    """
    import pyarrow as pa

    masks = []
    for bits in buckets_for(n, radius):
        m = sum(1 << (63 - b) for b in bits)
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(masks)])).alias("k")).select("fp", "k.table", "k.part")

    def forest_of(key, cols):
        fp = cols[0]
        if len(fp) > 1:
            root = forest(fp.view(np.uint64), radius)
            i = np.flatnonzero(root != np.arange(len(fp)))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[root[i]])], names=["a", "b"])

    def compare(batches):
        yield from by_group(batches, 4, forest_of)

    return squares(keyed, "fp").select("table", "part", "x", "y", "fp").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all ends of ``edges`` (a, b): root is the smallest
    node of its component.

    Alternating large and small stars: each round ties every node's neighbours
    to the smallest one; a logarithmic number of rounds is usual.  A node's
    neighbours are only ever reduced to a minimum, never collected, and the
    joins back are plain equi-joins, whose skewed parts Spark splits.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # not cut: the exchange of distinct() is made once and read for both of its uses
        down = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        rest = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut_lineage(low.select("a", F.col("m").alias("b")).unionByName(rest).distinct())
        if (now := _signature(new)) == before:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        e, before = new, now


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link texts whose fingerprints differ in at most ``radius`` bits (1 to 3).

    Returns doc_id, fingerprint (16 hex digits) and component_id, the smallest
    doc_id that links reach, its own included; one row for each row of
    ``docs``.  Null and empty texts have fingerprint 0 and are linked like any
    other.  A row with a null id gets its group's component_id, which is null
    only if no row of the group has an id.  Repeated rows come out each, an empty
    table gives an empty result, other columns are ignored.
    """
    if radius not in (1, 2, 3):
        raise ValueError("buckets hold all links for a radius of 1 to 3")
    fp = cut_lineage(fingerprints(docs, width, id_col, text_col))
    out = join_skewed(fp, fingerprint_components(fp, radius), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component_id"))


def fingerprint_components(fp: DataFrame, radius: int) -> DataFrame:
    """(fp, n, component_id, lead) for each distinct fingerprint of ``fp``
    (doc_id, fp): n counts its rows; lead is the fingerprint of a row with the
    component's smallest id."""
    distinct = cut_lineage(fp.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"), distinct.count(), radius))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    lead = F.min(F.struct(F.col("first").isNull().alias("no_id"), F.col("first"), F.col("fp")))
    groups = named.groupBy("root").agg(lead.alias("lead"), F.count("*").alias("n"))
    # only components of several fingerprints need another one's id
    several = groups.where("n > 1").select("root", "lead", "n")
    part = join_skewed(named.select("fp", F.col("n").alias("rows"), "first", "root"), several, "root")
    return cut_lineage(part.select("fp", F.col("rows").alias("n"), F.when(F.col("lead").isNull(), F.col("first")).otherwise(F.col("lead.first")).alias("component_id"), F.coalesce("lead.fp", "fp").alias("lead")))


# --- similar documents --------------------------------------------------------


def shingle_hashes(h: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts one after another, and how many each
    text has, from the hashes of their words (``size`` a text).  Fewer than
    ``width`` words give one shingle, none give none."""
    many = np.where(size >= width, size - width + 1, np.minimum(size, 1))
    start = np.repeat(np.cumsum(size) - size, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    left = np.repeat(np.cumsum(size), many) - start  # words from here to the text's end
    out = np.zeros(len(start), np.uint64)
    for k in range(width):
        word = np.where(left > k, h[np.minimum(start + k, max(0, len(h) - 1))], np.uint64(0)) if len(h) else out
        out = (out ^ word) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out, many


class Shingles:
    """Shingle hashes of batches of texts."""

    def __init__(self, width: int, max_words: int = 200_000):
        self.width, self.max_words, self.words = width, max_words, Words()

    def read(self, texts) -> tuple[np.ndarray, np.ndarray]:
        if self.words.known > self.max_words:
            self.words = Words()
        flat, size, _ = self.words.read(texts)
        keep = np.ones(len(flat), bool)
        keep[np.cumsum(size) - 1] = False  # the ends are no words
        return shingle_hashes(self.words.hash[flat[keep]], size - 1, self.width)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, th, same, n, fp, bands) for each row: hashes of the text and of
    its set of shingles, the set's size and fingerprint (each shingle once), and the keys of its buckets."""
    import pyarrow as pa

    odd = np.random.default_rng(5).integers(0, 2**63, MINIMA * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        shingles = Shingles(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                h, many = shingles.read(b.column(2))
                own = np.repeat(np.arange(len(many)), many)
                some = np.flatnonzero(many)
                order = np.lexsort((h, own))
                x, o = h[order], own[order]
                new = np.concatenate([[True], (x[1:] != x[:-1]) | (o[1:] != o[:-1])])[: len(x)]
                x, o = x[new], o[new]
                n = np.bincount(o, minlength=len(many))
                first = (np.cumsum(n) - n)[some]
                top = np.zeros((len(many), 64), np.int64)
                if len(some):
                    bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                    top[some] = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
                fp = np.packbits(2 * top > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
                same, bands = np.zeros(len(many), np.uint64), np.zeros((len(many), BANDS), np.uint64)
                if len(some):
                    mixed = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
                    same[some] = np.add.reduceat(mixed ^ mixed >> np.uint64(32), first, dtype=np.uint64)
                    for k, a in enumerate(odd):
                        low = np.minimum.reduceat(x * a ^ (x * a >> np.uint64(31)), first)
                        band = bands[some, k // MINIMA]
                        bands[some, k // MINIMA] = (band ^ low) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k // MINIMA)
                values = pa.array(bands.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(many) + 1, dtype=np.int32) * BANDS), values)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same.view(np.int64)), pa.array(n, pa.int64()), pa.array(fp), lists], names=["doc_id", "th", "same", "n", "fp", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(tidied(run), "doc_id long, th long, same long, n long, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(same, shingles) for each row (same, text); shingles ascend."""
    import pyarrow as pa

    def run(batches):
        shingles = Shingles(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                h, many = shingles.read(b.column(1))
                sets = [np.unique(x) for x in np.split(h.view(np.int64), np.cumsum(many)[:-1])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["same", "shingles"])

    return docs.select("same", "text").mapInArrow(tidied(run), "same long, shingles array<long>")


class Bucket:
    """Some members of a bucket, their sets, and which are connected."""

    def __init__(self, n: np.ndarray, fp: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], table: int, tenths: int):
        self.n, self.fp, self.sets, self.tenths = n, fp.view(np.uint64), sets, tenths
        #: keys of the earlier tables: a pair with one in common is checked there
        self.earlier = bands[:, :table]
        self.root = np.arange(len(n))
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def flatten(self) -> None:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up

    def join(self, i: int, j: int, linked: bool = True) -> None:
        u, v = self.find(i), self.find(j)
        if u != v:
            self.root[max(u, v)] = min(u, v)
            if linked:
                self.links.append((i, j))

    def may(self, i, j) -> np.ndarray:
        """Pairs whose sizes allow the similarity and that no earlier table has."""
        ok = 10 * np.minimum(self.n[i], self.n[j]) >= self.tenths * np.maximum(self.n[i], self.n[j])
        return ok & ~(self.earlier[i] == self.earlier[j]).any(-1)

    def nearest_first(self) -> None:
        """Check the pairs that the carry-save counters find within ``WIDE`` bits, the nearest first, while they are unconnected."""
        for s in range(0, len(self.n), SIDE):
            for t in range(s, len(self.n), SIDE):
                i, j, d = near_pairs(self.fp[s : s + SIDE], self.fp[t : t + SIDE], WIDE, distances=True)
                i, j = i + s, j + t
                ok = (i < j) & self.may(i, j)
                order = np.argsort(d[ok], kind="stable")
                i, j = i[ok][order], j[ok][order]
                for at in range(0, len(i), 4096):
                    p, q = i[at : at + 4096], j[at : at + 4096]
                    open_ = self.root[p] != self.root[q]
                    for k, m in zip(p[open_].tolist(), q[open_].tolist()):
                        if self.find(k) != self.find(m) and self.alike(k, np.array([m]))[0]:
                            self.join(k, m)
                    self.flatten()

    def alike(self, i: int, others: np.ndarray) -> np.ndarray:
        """Whether the set of member i is similar enough to each of the others'."""
        own = self.sets[i]
        flat = np.concatenate([self.sets[k] for k in others.tolist()])
        size = self.n[others]
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat(own[at] == flat, np.cumsum(size) - size, dtype=np.int64)
        return 10 * both >= self.tenths * (self.n[i] + size - both)

    def each(self, leaders, members: np.ndarray, checked_elsewhere: bool = True) -> None:
        """Check every leader with all members it isn't connected to."""
        for i in leaders:
            self.flatten()
            open_ = members[self.root[members] != self.root[i]]
            if len(open_) and checked_elsewhere:
                open_ = open_[self.may(i, open_)]
            elif len(open_):
                open_ = open_[10 * np.minimum(self.n[i], self.n[open_]) >= self.tenths * np.maximum(self.n[i], self.n[open_])]
            for at in range(0, len(open_), 256):
                part = open_[at : at + 256]
                for k in part[self.alike(i, part)].tolist():
                    self.join(i, k)
        self.flatten()


#: table, part and block name a group; role 0: members, 1: the bucket's leaders (or in the second pass the members not yet reached)
SET_ROWS = ["table", "part", "x", "y", "role", "same", "n", "fp", "bands", "shingles"]
LINKS = "a long, b long, table long, part long, rest long"


def checked(rows: DataFrame, tenths: int, second: bool) -> DataFrame:
    """(a, b): links of each group of ``rows``; and (table, part, rest): members
    of large buckets that their leaders don't reach.

    A group without role 1 is a whole bucket: all its pairs are checked.  With it,
    role 1 is checked with all of role 0; in the ``second`` pass members that a leader reaches count as connected."""
    import pyarrow as pa

    def connect(key, columns):
        role, same, n, fp, bands, sets = columns
        order = np.lexsort((same, -role))  # role 1 first
        role, same, n = role[order], same[order], n[order]
        b = Bucket(n, fp[order], np.stack(bands)[order], [sets[k] for k in order.tolist()], int(key[0]), tenths)
        first, all_ = int((role == 1).sum()), np.arange(len(n))
        rest = np.zeros(0, np.int64)
        if not first:
            b.nearest_first()
            b.each(range(len(n) - 1), all_)
        elif second:
            reached = np.flatnonzero(role == 2)
            for k in reached[1:].tolist():
                b.join(int(reached[0]), k, linked=False)
            b.each(np.flatnonzero(role == 1).tolist(), all_)
        else:
            b.each(range(first), all_, checked_elsewhere=False)
            rest = np.setdiff1d(same[(b.root != b.root[0]) & (role == 0)], same[:first])
            if key[3] == 0:  # leaders themselves, once
                rest = np.concatenate([rest, same[:first][b.root[:first] != b.root[0]]])
        a = [same[i] for i, _ in b.links] + [None] * len(rest)
        z = [same[j] for _, j in b.links] + [None] * len(rest)
        k = [None] * len(b.links)
        if a:
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array([*k, *[key[0]] * len(rest)], pa.int64()), pa.array([*k, *[key[1]] * len(rest)], pa.int64()), pa.array([*k, *rest.tolist()], pa.int64())],
                names=["a", "b", "table", "part", "rest"],
            )

    def run(batches):
        yield from by_group(batches, 4, connect)

    return dealt(rows, "same").select(*SET_ROWS).mapInArrow(tidied(run), LINKS)


def similar_sets(sketch: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(same, root): the sets that are linked to others, and the smallest of their component.

    Only sets that share a bucket with another one are made and shuffled, and
    only to buckets whose members don't all meet in one earlier bucket.  A
    bucket of over ``SET_SQUARE`` members is cut into blocks that each get its
    leaders; those that aren't connected to the first leader then meet all blocks."""
    tenths = round(10 * similarity)
    if not 5 <= tenths <= 10 or abs(tenths - 10 * similarity) > 1e-9:
        raise ValueError("the similarity must be a multiple of 0.1, at least 0.5")
    one = cut_lineage(sketch.groupBy("same").agg(F.min(F.struct("th", "n", "fp", "bands")).alias("s")).select("same", "s.*"))
    keyed = one.where("n > 0").select("same", F.posexplode("bands").alias("table", "part"))
    full = keyed.join(keyed.groupBy("table", "part").agg(F.count("*").alias("c")).where("c > 1").drop("c"), ["table", "part"])
    met = cut_lineage(full.select(F.col("table").cast("long"), "part", "same").join(one.drop("th"), "same"))
    # a bucket whose members all meet in an earlier bucket has nothing left to check
    ends = [f(F.col("bands")[k]).alias(f"{n}{k}") for k in range(BANDS - 1) for n, f in (("least", F.min), ("most", F.max))]
    seen = [(F.col("table") > k) & (F.col(f"least{k}") == F.col(f"most{k}")) for k in range(BANDS - 1)]
    sizes = met.groupBy("table", "part").agg(F.count("*").alias("c"), *ends).where(~F.greatest(*seen))
    rows = cut_lineage(met.join(sizes.select("table", "part", F.ceil(F.col("c") / SET_SQUARE).cast("long").alias("m")), ["table", "part"]))
    active = cut_lineage(rows.select("same").distinct().join(one.select("same", "th"), "same"))
    small = active.count() * 64 <= 64 << 20  # bytes that it may take as a broadcast
    rep = docs.select("text", F.xxhash64("text").alias("th")).join(F.broadcast(active) if small else active, "th")
    sets = cut_lineage(shingle_sets(rep.groupBy("same").agg(F.min("text").alias("text")), width))

    block = F.pmod(F.xxhash64("same"), F.col("m"))
    numbers = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))
    role = lambda k: F.lit(k).cast("long").alias("role")
    members = rows.join(sets, "same").withColumn("x", block).withColumn("y", F.col("x")).withColumn("role", role(0)).select(*SET_ROWS)
    large = rows.where("m > 1")
    if not large.limit(1).count():
        return components(checked(members, tenths, False).select("a", "b")).select(F.col("node").alias("same"), "root")
    leaders = large.withColumn("_k", F.row_number().over(Window.partitionBy("table", "part").orderBy("same"))).where(F.col("_k") <= LEADERS)
    leaders = leaders.join(sets, "same").withColumn("x", numbers("m")).withColumn("y", F.col("x")).withColumn("role", role(1)).select(*SET_ROWS)
    found = cut_lineage(checked(members.unionByName(leaders), tenths, False))
    edges = found.where("a is not null").select("a", "b")
    rest = cut_lineage(found.where("rest is not null").select("table", "part", F.col("rest").alias("same")).distinct())
    if rest.limit(1).count():
        count = rest.groupBy("table", "part").agg(F.ceil(F.count("*") / SET_SQUARE).cast("long").alias("r"))
        again = large.join(count, ["table", "part"]).join(rest.withColumn("open", F.lit(True)), ["table", "part", "same"], "left").join(sets, "same")
        asks = again.where("open").withColumn("x", F.pmod(F.xxhash64("same"), F.col("r"))).withColumn("y", numbers("m")).withColumn("role", role(1))
        all_ = again.withColumn("y", block).withColumn("x", numbers("r")).withColumn("role", F.when(F.col("open"), 0).otherwise(2).cast("long"))
        edges = edges.unionByName(checked(asks.select(*SET_ROWS).unionByName(all_.select(*SET_ROWS)), tenths, True).select("a", "b"))
    return components(edges).select(F.col("node").alias("same"), "root")


def keep_first(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One row of each group of near-duplicates, with all columns: one with
    the group's smallest doc_id (or one of those without ids, if none has one).

    Texts link if the sets of their word shingles (``width`` words; lower-case
    A-Z; fewer words: all of them) have a Jaccard similarity of at least
    ``similarity``; null texts and texts without words are alike.  Groups are
    what links reach.  Links are looked for in buckets that pairs of that similarity
    miss once in 30,000 times; all pairs of a bucket that aren't connected are checked.  Of repeated rows one stays;
    an empty table gives an empty result; a column that is named as one of ours is kept apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    sketch = cut_lineage(sketches(plain, width))
    rows = cut_lineage(sketch.groupBy("same", "doc_id", "th").agg(F.count("*").alias("n")))
    first = rows.groupBy("same").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first"), F.count("*").alias("n"))
    groups = first.join(similar_sets(sketch, plain, width, similarity), "same", "left").withColumn("root", F.coalesce("root", "same"))
    lead = cut_lineage(groups.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.th"))
    # the rows that go, and those of which one stays
    gone = cut_lineage(rows.join(lead, rows["doc_id"].eqNullSafe(lead["doc_id"]) & (rows["th"] == lead["th"]), "left_anti").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")))
    again = cut_lineage(rows.where("n > 1").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_doc"), F.xxhash64(text).alias("_own"))

    def without(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        small = right.count() * 64 <= 64 << 20  # bytes that it may take as a broadcast
        return left.join(F.broadcast(right) if small else right, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_th")), how)

    left = without(packed, gone, "left_anti")
    single = without(left, again, "left_anti")
    several = without(left, again, "left_semi").withColumn("_k", F.row_number().over(Window.partitionBy("_doc", "_own").orderBy(F.lit(1)))).where("_k = 1")
    return single.select("row.*").unionByName(several.select("row.*"))
