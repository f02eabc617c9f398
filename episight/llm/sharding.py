"""Shards of near equal bytes by histogram sort.

Every document gets a 63-bit key: 39 bits of its text's hash, then 24 bits of
its id's hash.  Equal texts are neighbours in key order, and yet even one huge
group of them has 2^24 places to be cut.  Splitters are found without sorting:
each round counts the exact bytes and rows below candidate boundaries in all
partitions, adds them up, and narrows each splitter's interval, until every
splitter is within its tolerance.  Then the rows are exchanged once, into
ranges so fine that none needs to be large; as the rows below each range are
known from the last count, a row's slot is that number plus its place in its
range.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import cut_lineage

KEY_BITS = 63
ID_BITS = 24


def sort_key(text, doc_id):
    """39 bits of the text's hash, then 24 bits of the id's."""
    low = (1 << ID_BITS) - 1
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS + ID_BITS), ID_BITS).bitwiseOR(F.xxhash64(doc_id).bitwiseAND(F.lit(low)))


def count_below(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe.

    Each task adds its rows up by the gap between probes they fall into, so
    what is shuffled and sent to the driver is as many numbers as there are
    probes, whatever the input.
    """
    import pyarrow as pa

    def local(batches):
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(probes, b.column(0).to_numpy(), side="right")
            size += np.bincount(at, b.column(1).to_numpy(), len(size)).astype(np.int64)
            rows += np.bincount(at, minlength=len(rows))
        keep = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(size[keep]), pa.array(rows[keep])], names=["gap", "size", "rows"])

    got = keys.select("key", "size").mapInArrow(local, "gap long, size long, rows long").groupBy("gap").agg(F.sum("size"), F.sum("rows")).collect()
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for gap, s, r in got:
        size[gap], rows[gap] = s, r
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(keys: DataFrame, shards: int, ranges: int, tolerance: float, fine_tolerance: float, fan: int = 32):
    """Boundaries that cut the keys into ``shards * ranges`` parts of about
    equal bytes: (boundaries, bytes below, rows below, rounds).

    Every ``ranges``-th is a shard's boundary and is held to ``tolerance`` (a
    share of a shard's bytes), the others to ``fine_tolerance`` (a share of a
    range's).  A shard's boundary is moved to the edge of a group of equal
    texts if that keeps it within its tolerance.

    All probes counted so far stand in order with their exact bytes and rows
    below; boundaries are looked up there by binary search, and the gaps in which
    some are still too far off get new probes, ``fan`` a gap or sixteen a boundary.
    """
    total, count = keys.agg(F.sum("size"), F.count("*")).first()
    n, top, mask = shards * ranges - 1, (1 << KEY_BITS) - 1, (1 << ID_BITS) - 1
    if not total:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    goal = np.array([total * (i + 1) / (n + 1) for i in range(n)])
    main = np.arange(1, n + 1) % ranges == 0
    allowed = np.where(main, tolerance * total / shards, fine_tolerance * total / (n + 1))
    probes, size, rows = np.array([0, top]), np.array([0, total]), np.array([0, count])
    rounds = 0
    while True:
        high = np.searchsorted(size, goal)
        low = high - 1
        nearest = np.where((size[high] - goal < goal - size[low]) & (high < len(probes) - 1), high, low)
        edge = np.flatnonzero((probes & mask == 0) & (probes < top))
        at = np.clip(np.searchsorted(size[edge], goal), 1, max(1, len(edge) - 1))
        left, right = edge[at - 1], edge[np.minimum(at, len(edge) - 1)]
        kept = np.where(np.abs(size[right] - goal) < np.abs(size[left] - goal), right, left)
        pick = np.where(main & (np.abs(size[kept] - goal) <= allowed), kept, nearest)
        open_ = (np.abs(size[pick] - goal) > allowed) & (probes[high] - probes[low] > 1)
        if rounds == KEY_BITS or not open_.any():
            return probes[pick], size[pick], rows[pick], rounds
        lo, hi = np.unique(np.stack([probes[low[open_]], probes[high[open_]]], 1), axis=0).T
        each = max(fan, 16 * n // len(lo))  # gaps that boundaries share get more probes
        step = np.maximum((hi - lo) // (each + 1), 1)
        even = lo[:, None] + step[:, None] * np.arange(1, each + 1)
        new = np.unique(np.concatenate([even[even < hi[:, None]], (lo >> ID_BITS) + 1 << ID_BITS, hi >> ID_BITS << ID_BITS]))
        new = np.setdiff1d(new[(new > 0) & (new < top)], probes)
        below, rows_below = count_below(keys, new)
        order = np.argsort(np.concatenate([probes, new]), kind="stable")
        probes, size, rows = (np.concatenate(x)[order] for x in ((probes, new), (size, below), (rows, rows_below)))
        rounds += 1


def histogram_shards(
    docs: DataFrame, shards: int = 8, tolerance: float = 0.002, range_rows: int = 250_000, id_col: str = "doc_id", text_col: str = "text", keep: bool = False
) -> DataFrame:
    """Put every row into one of ``shards`` shards of near equal bytes.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ("bytes"),
    shard, slot (gapless from 0 in each shard, in key order), grown_shard
    (null: this law has none) and, with ``keep``, all other columns of
    ``docs`` whose names don't clash with these.

    Null texts have size 1 and the checksum of nothing, and null ids hash
    alike; rows that agree in id and text are told apart by nothing and get
    different slots in any order.  Shards differ from an equal share by at most
    2 * ``tolerance`` of it plus one document.  Equal texts stay in one
    shard unless the bytes need the cut.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), sort_key(text, F.col(id_col)).alias("key")]
    new = {"doc_id", "size", "text_crc32", "key", "law", "shard", "slot", "grown_shard", "range"}
    rest = [c for c in docs.columns if c.lower() not in new | {id_col.lower()}] if keep else []
    keys = cut_lineage(docs.select(*own))
    n_rows = keys.count()
    ranges = max(4, -(-n_rows // (range_rows * shards)))
    cut, _, rows_below, _ = splitters(keys, shards, ranges, tolerance, 0.5)
    order = np.argsort(cut, kind="stable")  # equal boundaries leave a range empty
    cut, start = cut[order], np.concatenate([[0], rows_below[order]])
    shard_of = np.arange(shards * ranges) // ranges
    offset = start - start[shard_of * ranges]

    def place(batches):
        import pyarrow as pa

        for b in batches:
            at = np.searchsorted(cut, b.column(b.schema.get_field_index("key")).to_numpy(), side="right")
            cols = [*b.columns, pa.array(at.astype(np.int32)), pa.array(shard_of[at].astype(np.int32)), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "range", "shard", "first"])

    rows = docs.select(*own, *[F.col(f"`{c}`") for c in rest]) if rest else keys
    schema = StructType([*rows.schema.fields, StructField("range", IntegerType()), StructField("shard", IntegerType()), StructField("first", LongType())])
    placed = rows.mapInArrow(place, schema)
    slot = F.row_number().over(Window.partitionBy("range").orderBy("key", "doc_id")) - 1 + F.col("first")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"`{c}`") for c in rest])
