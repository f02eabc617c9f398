"""Places in an order that no task sees whole: exact quantiles, ranks and
neighbours in a sorted column, from counts below probes and inside ranges."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut_lineage

BINS = 256


def exact_quantiles(rows: DataFrame, column: str, shares: list[float], fine: int = 50_000) -> list[float] | None:
    """The interpolated quantiles of a column; nulls don't count, None without any value.

    Each order statistic lies in a bracket of values; counts in equal bins of
    all brackets, which tasks add up before anything is sent, say in which bin it is, and
    the bin's own ends are the next bracket.  A bracket of at most ``fine`` rows is sorted.  The
    driver holds some numbers a statistic.  ``rows`` are read once a round: write them down first.
    """
    v = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    places = [s * (n - 1) for s in shares]
    found: dict[int, float] = {0: low, n - 1: high}
    # place -> its bracket: ends, values below it, values in it
    open_ = {k: (low, high, 0, n) for p in places for k in (floor(p), ceil(p)) if k not in found}
    while True:
        for k, (a, z, _, _) in list(open_.items()):
            if a == z:
                found[k] = a
                del open_[k]
        wide = {k: b for k, b in open_.items() if b[3] > fine}
        if not wide:
            break
        brackets = sorted({(a, z) for a, z, _, _ in wide.values()})
        number = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(z).alias("z")) for i, (a, z) in enumerate(brackets)])
        d = v.withColumn("b", F.explode(F.filter(number, lambda b: F.col("v").between(b["a"], b["z"])))).select("v", "b.*")
        place = F.least(F.floor((F.col("v") / 2 - F.col("a") / 2) / ((F.col("z") / 2 - F.col("a") / 2) / BINS)), F.lit(BINS - 1))
        counts: dict[tuple, list] = {b: [] for b in brackets}
        for r in d.groupBy("i", place.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():  # BINS rows a bracket
            counts[brackets[r.i]].append((r.bin, r.c, r.lo, r.hi))
        for k, (a, z, below, _) in wide.items():
            for _, c, lo, hi in sorted(counts[a, z]):
                if k < below + c:
                    open_[k] = (lo, hi, below, c)
                    break
                below += c
    if open_:
        wanted = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(a).alias("a"), F.lit(z).alias("z"), F.lit(k - below + 1).cast("long").alias("at")) for k, (a, z, below, _) in open_.items()])
        d = v.withColumn("b", F.explode(F.filter(wanted, lambda b: F.col("v").between(b["a"], b["z"])))).select("v", "b.k", "b.at")
        d = d.withColumn("_p", F.row_number().over(Window.partitionBy("k").orderBy("v"))).where(F.col("_p") == F.col("at"))
        found |= {r.k: r.v for r in d.collect()}  # a row a statistic
    out = []
    for p in places:
        a, z = found[floor(p)], found[ceil(p)]
        out.append(a if a == z else (ceil(p) - p) * a + (p - floor(p)) * z)
    return out


def counted_below(values: DataFrame, asked: DataFrame, column: str, key: str) -> DataFrame:
    """(key, below): for each row of ``asked`` (key, column) how many of ``values``
    (column) are smaller.  Both lie in one sorted order, cut into ranges; counts inside a range are
    shifted by those of the ranges before.  Equal values are one row with their number."""
    counts = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("w"))
    none = F.lit(None).cast(asked.schema[key].dataType)
    # those who ask stand before what is equal
    both = counts.select(none.alias(key), F.struct(F.col(column).alias("v"), F.lit(1).alias("own")).alias("o"), "w")
    both = both.unionByName(asked.select(key, F.struct(F.col(column).alias("v"), F.lit(0).alias("own")).alias("o"), F.lit(0).cast("long").alias("w")))
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(both.repartitionByRange(n, "o").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.sum("w").alias("_n"))  # a row a partition
    shift = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("w").over(Window.partitionBy("_part").orderBy("o"))
    return ranged.withColumn("below", inside).where("o.own = 0").join(F.broadcast(shift), "_part").select(key, (F.col("below") + F.col("_before")).alias("below"))


def with_previous(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the value before each in the order of a column (null for the
    first): inside ranges, and at a range's start the largest of those before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(rows.repartitionByRange(n, column).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.max(column).alias("_last"))  # a row a partition
    edge = parts.select("_part", F.max("_last").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_edge"))
    own = F.lag(column).over(Window.partitionBy("_part").orderBy(column))
    return ranged.withColumn(name, own).join(F.broadcast(edge), "_part").withColumn(name, F.coalesce(name, "_edge")).drop("_part", "_edge")
