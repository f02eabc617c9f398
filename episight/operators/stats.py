"""Robust statistics over episodes, on the long form (ep, metric, value)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import median
from ..functions.lineage import cut_lineage

OUTLIER_K = 3.0
MAD_TO_SIGMA = 1.4826
ANOMALY_Z = 2.5


def long_metrics(wide: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(ep, metric, value)"""
    return wide.select("ep", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot("ep", list(metrics), "metric", "value")


def centre_and_spread(m: DataFrame, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """(by, n, mid, mad, dev): a row a metric (and group)."""
    mid = m.groupBy(*by).agg(F.count("value").alias("n"), median("value").alias("mid"), F.stddev_pop("value").alias("dev"))
    off = m.join(mid, [*by]).groupBy(*by).agg(median(F.abs(F.col("value") - F.col("mid"))).alias("mad"))
    return mid.join(off, [*by])


def mad_outliers(m: DataFrame, lower_worse: tuple[str, ...] = (), k: Mapping[str, float] | None = None, floor: Mapping[str, float] | None = None) -> DataFrame:
    """(ep, metric, value, deviation): values over ``k`` median deviations on
    the bad side (deviations of the mean kind if the median one is 0), of
    metrics with at least 5 values; values below a metric's floor never count."""
    spread = centre_and_spread(m)
    scale = F.when(F.col("mad") < 1e-12, F.col("dev")).otherwise(F.col("mad"))
    d = m.where("value is not null").join(F.broadcast(spread), "metric").where("n >= 5").withColumn("scale", scale).where("scale >= 1e-12")
    d = d.withColumn("deviation", (F.col("value") - F.col("mid")) / F.col("scale"))
    limit, least = F.lit(OUTLIER_K), F.lit(None).cast("double")
    for name, x in (k or {}).items():
        limit = F.when(F.col("metric") == name, F.lit(float(x))).otherwise(limit)
    for name, x in (floor or {}).items():
        least = F.when(F.col("metric") == name, F.lit(float(x))).otherwise(least)
    bad = F.when(F.col("metric").isin(*lower_worse), F.col("deviation") < -limit) if lower_worse else F.when(F.lit(False), F.lit(False))
    bad = bad.otherwise((F.col("deviation") > limit) & F.coalesce(F.col("value") >= least, F.lit(True)))
    return d.where(bad).select("ep", "metric", "value", F.abs("deviation").alias("deviation"))


def firing_rates(outliers: DataFrame, m: DataFrame) -> DataFrame:
    """(metric, n_fired, rate): of all episodes that have a row for the metric."""
    total = m.groupBy("metric").agg(F.count("*").alias("n"))
    fired = outliers.groupBy("metric").agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0))
    return total.join(fired, "metric", "left").select("metric", k.alias("n_fired"), (k / F.col("n")).alias("rate"))


def consecutive_groups(outliers: DataFrame, chunk: int = 4096) -> DataFrame:
    """(first, last, size): runs of consecutive episode numbers with an outlier.

    Runs are found inside chunks of numbers; only those that touch a chunk's
    edge, two a chunk at most, are then looked at together.
    """
    eps = outliers.select("ep").distinct().withColumn("c", F.floor(F.col("ep") / chunk))
    eps = eps.withColumn("g", F.col("ep") - F.row_number().over(Window.partitionBy("c").orderBy("ep")))
    runs = eps.groupBy("c", "g").agg(F.min("ep").alias("first"), F.max("ep").alias("last"))
    runs = runs.withColumn("edge", (F.col("first") == F.col("c") * chunk) | (F.col("last") == F.col("c") * chunk + chunk - 1))
    order = Window.orderBy("first")
    new = F.coalesce(F.col("first") != F.lag("last").over(order) + 1, F.lit(True)).cast("int")
    met = runs.where("edge").withColumn("new", new).withColumn("id", F.sum("new").over(order)).groupBy("id").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("id")
    both = runs.where("not edge").select("first", "last").unionByName(met)
    return both.withColumn("size", F.col("last") - F.col("first") + 1)


def percentile_ranks(m: DataFrame, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """(ep, by, rank): share of the metric's (and group's) values up to this
    one; null below 2 values or if they agree.

    Distinct values are counted first and dealt to ranges of their order; a
    range's start comes from the counts of those before, so no metric is one task's work.
    """
    spread = m.groupBy(*by).agg(F.count("value").alias("n"), (F.max("value") - F.min("value")).alias("range"))
    counts = cut_lineage(m.where("value is not null").groupBy(*by, "value").agg(F.count("*").alias("c")))
    part = counts.repartitionByRange(*by, "value").withColumn("_p", F.spark_partition_id())
    part = cut_lineage(part)
    before = part.groupBy(*by, "_p").agg(F.sum("c").alias("s")).withColumn("start", F.sum("s").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    upto = F.sum("c").over(Window.partitionBy(*by, "_p").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("start", F.lit(0))
    ranks = part.join(before.select(*by, "_p", "start"), [*by, "_p"]).withColumn("upto", upto).join(spread, [*by])
    ranks = ranks.where("n >= 2 and range >= 1e-9").select(*by, "value", (F.col("upto") / F.col("n")).alias("rank"))
    return m.join(ranks, [*by, "value"], "left").select("ep", *by, "rank")


def robust_z(m: DataFrame, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """(ep, by, z): distance from the median over 1.4826 median deviations
    (or the deviation if that is 0); null below 3 values or without spread."""
    s = centre_and_spread(m, by)
    scale = F.when(F.col("mad") * MAD_TO_SIGMA < 1e-12, F.col("dev")).otherwise(F.col("mad") * MAD_TO_SIGMA)
    d = m.join(s, [*by]).withColumn("scale", scale)
    z = F.when((F.col("n") >= 3) & (F.col("scale") >= 1e-12), F.abs(F.col("value") - F.col("mid")) / F.col("scale"))
    return d.select("ep", *by, z.alias("z"))


def assessments(m: DataFrame, risk: DataFrame, coverage: DataFrame | None = None, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """(ep, quality_risk, anomaly, n_reasons, top_reason, coverage_value).

    A reason is a metric with a rank of at most 0.1 or at least 0.9; the
    anomaly is the largest distance of such a rank from the middle, doubled,
    among those with a robust z of at least 2.5.  ``by`` may add columns of ``m``, such
    as the task, within whose groups values are then ranked.
    """
    d = percentile_ranks(m, by).join(robust_z(m, by), ["ep", *by])
    tail = (F.col("rank") <= 0.1) | (F.col("rank") >= 0.9)
    far = F.abs(F.col("rank") - 0.5) * 2
    g = d.groupBy("ep").agg(
        F.coalesce(F.max(F.when(tail & (F.col("z") >= ANOMALY_Z), far)), F.lit(0.0)).alias("anomaly"),
        F.sum(F.coalesce(tail, F.lit(False)).cast("long")).alias("n_reasons"),
        F.min(F.when(tail, F.struct((-far).alias("f"), F.col("metric").alias("metric"))))["metric"].alias("top_reason"),
    )
    out = g.join(risk.select("ep", "quality_risk"), "ep", "left")
    if coverage is not None:
        out = out.join(coverage.select("ep", "coverage_value"), "ep", "left")
    else:
        out = out.withColumn("coverage_value", F.lit(None).cast("double"))
    return out


def review_queue(assessed: DataFrame, n: int) -> DataFrame:
    """The ``n`` episodes to look at first, by 0.5 risk + 0.5 anomaly - 0.3 coverage."""
    order = 0.5 * F.coalesce("quality_risk", F.lit(0.0)) + 0.5 * F.col("anomaly") - 0.3 * F.coalesce("coverage_value", F.lit(0.0))
    return assessed.withColumn("priority", order).orderBy(F.desc(F.round("priority", 9)), "ep").limit(n)


def wilson(k, n, z: float = 1.96):
    """(low, high) of Wilson's interval as columns; nulls for n = 0."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def assessment_summary(assessed: DataFrame) -> DataFrame:
    """One row: n, mean risk, anomaly and coverage value."""
    return assessed.agg(F.count("*").alias("n"), F.avg("quality_risk").alias("quality_risk"), F.avg("anomaly").alias("anomaly"), F.avg("coverage_value").alias("coverage_value"))


def evenly_spaced(rows: DataFrame, k: int, order: str = "ep") -> DataFrame:
    """``k`` rows at even places of the order, the first and the last among them; all if there are no more."""
    n = rows.count()
    if n <= k:
        return rows
    places = [(round(i * (n - 1) / max(1, k - 1)) + 1,) for i in range(k)]
    from .export import numbered

    want = rows.sparkSession.createDataFrame(places, "place long").distinct()
    return numbered(rows, order).join(F.broadcast(want), "place", "left_semi").drop("place")  # k rows
