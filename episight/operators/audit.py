"""Many data sets at once: one plan figures, judges and ranks them all.

Episodes are keyed by data set and episode, so the operators' windows need no
change; figures of data sets are groups by their name.  What has been audited in its
present revision is left out before anything is read for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import lower_level, upper_level
from . import motion, timing
from .report import leaderboard, not_audited

#: metric -> the column of ``figures`` that it is the mean of, and its bounds (warning, critical)
LADDERS = {
    "timestamp_jitter_cv": ("jitter_cv", 0.15, 0.30),
    "timestamp_dropout_rate": ("dropout", 0.01, 0.05),
    "jerk_spike_rate": ("spike_rate", 0.02, 0.05),
    "velocity_discontinuity_rate": ("disc_rate", 0.02, 0.05),
    "ldlj": ("ldlj", -10.0, -15.0),
}
CLOCK = ("timestamp_jitter_cv", "timestamp_dropout_rate")


def figures(steps: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """(dataset, ep, n_steps, jitter_cv, dropout, non_monotonic, on_grid, spike_rate, disc_rate, ldlj)."""
    keyed = steps.withColumn("ep", F.struct("dataset", "ep"))
    d = timing.timing_metrics(keyed).join(timing.grid_and_scale(keyed).select("ep", "on_grid"), "ep")
    d = d.join(motion.motion_metrics(keyed, actions).drop("n_steps"), "ep").join(motion.whole_ldlj(keyed, actions).select("ep", "ldlj"), "ep")
    return d.select("ep.dataset", F.col("ep.ep").alias("ep"), "n_steps", "jitter_cv", "dropout", "non_monotonic", "on_grid", "spike_rate", "disc_rate", "ldlj")


def flags(by_episode: DataFrame) -> DataFrame:
    """(dataset, metric, value, level): each data set's means on their ladders;
    where every episode's clock is made up, its clock figures are INFO.  Figures that can't be had are left out."""
    g = by_episode.groupBy("dataset").agg(*[F.avg(c).alias(m) for m, (c, _, _) in LADDERS.items()], F.bool_or("non_monotonic").alias("bad"), F.coalesce(F.bool_and("on_grid"), F.lit(False)).alias("made_up"))
    rows = []
    for m, (_, warn, crit) in LADDERS.items():
        level = (lower_level if crit < warn else upper_level)(F.col(m), warn, crit)
        level = F.when(F.col("made_up"), "INFO").otherwise(level) if m in CLOCK else level
        rows.append(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), level.alias("level")))
    rows.append(F.struct(F.lit("timestamp_non_monotonic").alias("metric"), F.col("bad").cast("double").alias("value"), F.when(F.col("bad"), "CRITICAL").otherwise("OK").alias("level")))
    return g.select("dataset", F.explode(F.array(*rows)).alias("f")).select("dataset", "f.*").where("value is not null")


def audit(steps: DataFrame, actions: tuple[str, ...], done: DataFrame | None = None) -> DataFrame:
    """(rank, dataset, revision, n_episodes, score, n_critical, n_warning, verdict) of
    steps (dataset, revision, ep, step, t, actions): score is the mean credit of the flags (1, a half for a
    warning, none for a critical one) in percent; pass from 90, review from 70.

    ``done``: (dataset, revision) that have an audit already; they are left out.  A
    data set has one revision, the largest of its rows.
    """
    revisions = steps.groupBy("dataset").agg(F.max("revision").alias("revision"))
    if done is not None:
        revisions = not_audited(revisions, done)
        steps = steps.join(revisions.select("dataset"), "dataset", "left_semi")
    by = figures(steps, actions)
    credit = F.when(F.col("level") == "CRITICAL", 0.0).when(F.col("level") == "WARNING", 0.5).otherwise(1.0)
    n = lambda level: F.sum((F.col("level") == level).cast("long"))
    scores = flags(by).groupBy("dataset").agg((100.0 * F.avg(credit)).alias("score"), n("CRITICAL").alias("n_critical"), n("WARNING").alias("n_warning"))
    sizes = by.groupBy("dataset").agg(F.count("*").alias("n_episodes"))
    d = scores.join(sizes, "dataset").join(revisions, "dataset")
    ranks = leaderboard(d.select("dataset", F.round("score", 6).alias("score"), F.lit(False).alias("failed"))).select("dataset", "rank")
    verdict = F.when(F.col("score") >= 90, "pass").when(F.col("score") >= 70, "review").otherwise("fail")
    return d.join(ranks, "dataset").select("rank", "dataset", "revision", "n_episodes", "score", "n_critical", "n_warning", verdict.alias("verdict"))
