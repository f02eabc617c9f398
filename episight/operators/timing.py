"""Figures of an episode's clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import in_order, median, norm, share, whole

DROPOUT_FACTOR = 3.0
GRID_TOLERANCE = 1e-3
ZERO_FACTOR = 0.05
MISALIGNED_S = 0.005


def intervals(steps: DataFrame) -> DataFrame:
    """Steps with dt, the time since the step before (null at the first)."""
    return steps.withColumn("dt", F.col("t") - F.lag("t").over(in_order()))


def timing_metrics(steps: DataFrame) -> DataFrame:
    """(ep, n_steps, jitter_cv, dropout, non_monotonic).

    jitter_cv: deviation over mean of the intervals, null below 3 steps or if
    the mean isn't positive.  dropout: share of intervals over 3 medians, 0
    below 3 steps or if the median isn't positive.
    """
    d = intervals(steps).withColumn("mid", median("dt").over(whole()))
    g = d.groupBy("ep").agg(
        F.count("*").alias("n_steps"),
        F.avg("dt").alias("mean"),
        F.stddev_pop("dt").alias("dev"),
        F.first("mid").alias("mid"),
        share(F.col("dt") > DROPOUT_FACTOR * F.col("mid")).alias("gaps"),
        F.max(F.col("dt") <= 0).alias("bad"),
    )
    long = F.col("n_steps") >= 3
    return g.select(
        "ep",
        "n_steps",
        F.when(long & (F.col("mean") > 0), F.col("dev") / F.col("mean")).alias("jitter_cv"),
        F.when(long & (F.col("mid") > 0), F.col("gaps")).otherwise(F.lit(0.0)).alias("dropout"),
        F.coalesce("bad", F.lit(False)).alias("non_monotonic"),
    )


def grid_and_scale(steps: DataFrame) -> DataFrame:
    """(ep, on_grid, median_dt, scale_outlier): whether all stamps lie on a
    regular grid (null below 3 steps), and whether the median positive
    interval is over 10 times or under a tenth of the episodes' median."""
    first = F.first("t").over(in_order())
    d = intervals(steps).withColumns({"mid": median("dt").over(whole()), "t0": first})
    pos = F.when(F.col("dt") > 0, F.col("dt"))
    g = d.groupBy("ep").agg(
        F.count("*").alias("n"),
        F.max(F.abs(F.col("t") - (F.col("t0") + F.col("step") * F.col("mid")))).alias("off"),
        F.first("mid").alias("mid"),
        median(pos).alias("median_dt"),
    )
    centre = g.agg(median("median_dt").alias("centre"))
    g = g.crossJoin(F.broadcast(centre))  # one row
    ratio = F.col("median_dt") / F.col("centre")
    return g.select(
        "ep",
        F.when(F.col("n") >= 3, F.col("off") <= GRID_TOLERANCE * F.col("mid")).alias("on_grid"),
        "median_dt",
        F.coalesce((ratio > 10) | (ratio < 0.1), F.lit(False)).alias("scale_outlier"),
    )


def frame_rates(steps: DataFrame) -> DataFrame:
    """(ep, n_frames, mean_fps, std_fps): over positive intervals, 0 below 2 stamps."""
    fps = F.when(F.col("dt") > 0, 1.0 / F.col("dt"))
    g = intervals(steps).groupBy("ep").agg(F.count("*").alias("n_frames"), F.avg(fps).alias("m"), F.stddev_pop(fps).alias("s"))
    short = F.col("n_frames") < 2
    return g.select("ep", "n_frames", F.when(short, 0.0).otherwise(F.col("m")).alias("mean_fps"), F.when(short, 0.0).otherwise(F.col("s")).alias("std_fps"))


def frame_rate_summary(steps: DataFrame) -> DataFrame:
    """(ep, n_frames, mean_fps, std_fps, cv, dropout_rate): ``frame_rates`` with the
    deviation of all intervals over their mean and the share of those over 3 medians; both 0
    below 2 stamps and where the mean or the median isn't positive."""
    d = intervals(steps).withColumn("mid", median("dt").over(whole()))
    g = d.groupBy("ep").agg(F.avg("dt").alias("m"), F.stddev_pop("dt").alias("s"), F.first("mid").alias("mid"), share(F.col("dt") > DROPOUT_FACTOR * F.col("mid")).alias("gaps"))
    more = g.select("ep", F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0).alias("cv"), F.when(F.col("mid") > 0, F.col("gaps")).otherwise(0.0).alias("dropout_rate"))
    return frame_rates(steps).join(more, "ep")


def clock_lag(steps: DataFrame, other: str = "action_t") -> DataFrame:
    """(ep, lag_mean_ms, lag_std_ms, lag_max_ms, misaligned) of a second clock against t."""
    lag = (F.col(other) - F.col("t")) * 1000
    return steps.groupBy("ep").agg(
        F.avg(lag).alias("lag_mean_ms"),
        F.stddev_pop(lag).alias("lag_std_ms"),
        F.max(F.abs(lag)).alias("lag_max_ms"),
        share(F.abs(lag) > MISALIGNED_S * 1000).alias("misaligned"),
    )


def action_dropout(steps: DataFrame, actions: tuple[str, ...] = ("a0",), states: tuple[str, ...] = ("s0",)) -> DataFrame:
    """(ep, action_dropout): share of transitions with a near-zero action while
    the state moves (without states: of steps with a near-zero action); episodes of 2 or more steps.

    Near zero is against the mean deviation over all episodes, moving against
    the episode's own, times sqrt(dimensions); a deviation of 0 counts as 1.
    """
    mean = lambda parts: sum(parts, F.lit(0.0)) / len(parts)
    scale = steps.agg(mean([F.stddev_pop(c) for c in actions]).alias("all_dev"))
    d = steps.crossJoin(F.broadcast(scale))  # one row
    unit = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    hit = norm(actions) < ZERO_FACTOR * unit("all_dev") * len(actions) ** 0.5
    if states:
        d = d.withColumns({"ds": norm([F.lead(c).over(in_order()) - F.col(c) for c in states]), "own": mean([F.stddev_pop(c).over(whole()) for c in states])})
        hit = F.when(F.col("ds").isNotNull(), hit & (F.col("ds") > ZERO_FACTOR * unit("own") * len(states) ** 0.5))
    return d.groupBy("ep").agg(F.count("*").alias("n"), share(hit).alias("action_dropout")).where("n >= 2").drop("n")


def all_synthetic(grid: DataFrame) -> DataFrame:
    """(synthetic): whether every episode that can tell lies on an exact grid."""
    return grid.agg(F.coalesce(F.bool_and("on_grid"), F.lit(False)).alias("synthetic"))




def not_evaluable(flags: DataFrame, synthetic: DataFrame, metrics: tuple[str, ...] = ("jitter_cv", "dropout")) -> DataFrame:
    """(metric, value, level): flags of clock figures are only INFO if all clocks are synthetic (one row)."""
    d = flags.crossJoin(F.broadcast(synthetic))  # one row
    return d.select("metric", "value", F.when(F.col("synthetic") & F.col("metric").isin(*metrics), "INFO").otherwise(F.col("level")).alias("level"))
