"""A dataset's flags in one table, what they come to, and where its outliers
stand; plans that compose the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import lower_level, upper_level
from . import coverage, motion, tasks, timing
from .gates import Limits

#: By noise regime the limits of spikes, discontinuities, dropout and jerk, and the weight of diversity.
REGIMES = {
    "low_noise": (0.15, 0.30, 0.10, -35.0, 0.85),
    "moderate_noise": (0.25, 0.40, 0.15, -40.0, 0.90),
    "high_noise": (0.08, 0.15, 0.08, -25.0, 0.70),
}


def flags(steps: DataFrame, actions: tuple[str, ...], states: tuple[str, ...], gripper: str | None = None) -> DataFrame:
    """(metric, value, level) of a dataset's clocks, motion, coverage and task
    structure: means over episodes, each judged by its own ladder; figures that can't be had are left out.

    Clock figures of an all-synthetic clock are INFO.  Each figure is an
    aggregate over one exchange by episode; only single rows meet.
    """
    rows = []

    def one(df: DataFrame, metric: str, value, level) -> None:
        rows.append(df.select(F.lit(metric).alias("metric"), value.cast("double").alias("value"), level.alias("level")))

    c = F.col
    clock = timing.timing_metrics(steps).agg(F.avg("jitter_cv").alias("j"), F.avg("dropout").alias("d"), F.bool_or("non_monotonic").alias("n")).crossJoin(timing.all_synthetic(timing.grid_and_scale(steps)))  # one row each
    known = lambda level: F.when(c("synthetic"), "INFO").otherwise(level)
    one(clock, "timestamp_jitter_cv", c("j"), known(upper_level(c("j"), 0.15, 0.30)))
    one(clock, "timestamp_dropout_rate", c("d"), known(upper_level(c("d"), 0.01, 0.05)))
    one(clock, "timestamp_non_monotonic", c("n").cast("int"), F.when(c("n"), "CRITICAL").otherwise("OK"))
    drop = timing.action_dropout(steps, actions, states).agg(F.avg("action_dropout").alias("v"))
    one(drop, "action_dropout_rate", c("v"), upper_level(c("v"), 0.05, 0.15))
    moved = motion.motion_metrics(steps, actions).agg(F.avg("spike_rate").alias("s"), F.avg("disc_rate").alias("d"))
    one(moved, "jerk_spike_rate", c("s"), upper_level(c("s"), 0.02, 0.05))
    one(moved, "velocity_discontinuity_rate", c("d"), upper_level(c("d"), 0.02, 0.05))
    smooth = motion.whole_ldlj(steps, actions).agg(F.avg("ldlj").alias("v"))
    one(smooth, "ldlj", c("v"), lower_level(c("v"), -10.0, -15.0))
    if states and len(states) == len(actions):
        off = motion.divergence_flag(steps, actions, states)
        rows.append(off.select(F.lit("action_state_divergence").alias("metric"), c("divergence").alias("value"), "level"))
    bits = coverage.action_entropy(steps, actions).agg(F.avg("bits").alias("v"))
    one(bits, "action_entropy", c("v"), lower_level(c("v"), 2.5, 1.5))
    n = steps.groupBy("ep").agg(F.count("*").alias("n_steps"))
    short = coverage.short_episodes(n)
    one(short, "short_episode_fraction", c("short_fraction"), upper_level(c("short_fraction"), 0.05, 0.15))
    length = coverage.length_stats(n)
    one(length, "episode_length_distribution", c("cv"), F.when(c("bimodal"), "WARNING").otherwise("OK"))
    if gripper is not None:
        rest = tuple(a for a in actions if a != gripper)
        grasps = tasks.grasp_summary(tasks.grasp_count(steps, gripper, rest))
        rows.append(grasps.select(F.lit("grasp_events_per_episode").alias("metric"), c("mean_grasps").alias("value"), "level"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.where("value is not null")


def findings(flagged: DataFrame) -> DataFrame:
    """(metric, value, level, dimension, integrity, action): a finding for each flag that isn't OK."""
    from .policies import DIMENSION_TERMS, actions, containing

    acted = actions(flagged).select("metric", "integrity", "action")
    bad = flagged.where("level <> 'OK'").join(acted, "metric")
    return bad.select("metric", "value", "level", containing(F.col("metric"), DIMENSION_TERMS, "task_integrity").alias("dimension"), "integrity", "action")


def headline(flagged: DataFrame, names: tuple[str, ...] = ("ldlj", "action_entropy", "timestamp_jitter_cv", "timestamp_dropout_rate", "jerk_spike_rate", "velocity_discontinuity_rate")) -> DataFrame:
    """One row with the six figures that datasets are compared by; a missing one is null."""
    return flagged.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])


def detector_spread(outliers: DataFrame, n_episodes: int) -> DataFrame:
    """(metric, n_fired, concentration) of (ep, metric): spread over the dataset, clustered within a tenth of it, or at its end."""
    g = outliers.groupBy("metric").agg(F.countDistinct("ep").alias("n_fired"), F.min("ep").alias("lo"), F.max("ep").alias("hi"))
    near = F.col("hi") - F.col("lo") <= max(3, int(n_episodes * 0.10))
    return g.select("metric", "n_fired", F.when(F.col("n_fired") == 1, "spread").when(near, "clustered").when(F.col("hi") >= int(n_episodes * 0.85), "endpoint").otherwise("spread").alias("concentration"))


def group_labels(groups: DataFrame, outliers: DataFrame, n_episodes: int) -> DataFrame:
    """(first, last, size, label): what a run of outlier episodes may mean, by its
    place, its size and the clock figures among its flags.  The runs, disjoint, are
    met by equality of blocks of episode numbers."""
    block = 4096
    clock = outliers.where(F.col("metric").isin("jitter_cv", "dropout")).select("ep", "metric").withColumn("b", F.floor(F.col("ep") / block))
    runs = groups.withColumn("b", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))))
    seen = runs.join(clock, "b").where("ep between first and last").groupBy("first").agg(F.bool_or(F.col("metric") == "jitter_cv").alias("j"), F.bool_or(F.col("metric") == "dropout").alias("d"))
    d = groups.join(seen, "first", "left").withColumns({"j": F.coalesce("j", F.lit(False)), "d": F.coalesce("d", F.lit(False))})
    label = (
        F.when((F.col("size") >= 3) & (F.col("j") | F.col("d")), "sync_loss_or_interruption")
        .when(F.col("size") >= 3, "fatigue_or_artifact")
        .when(F.col("last") >= int(n_episodes * 0.90), "end_of_dataset")
        .when(F.col("first") <= int(n_episodes * 0.05), "start_of_dataset")
        .when(F.col("j"), "sync_loss")
        .when(F.col("d"), "frame_drop")
        .otherwise("investigate")
    )
    return d.select("first", "last", "size", label.alias("label"))


def most_isolated(nearest: DataFrame) -> DataFrame:
    """One row: the episode with the smallest distance to its nearest neighbour
    (the rule that the audit mode has; the largest would be the loneliest)."""
    return nearest.agg(F.min(F.struct(F.round("distance", 9).alias("d"), "ep")).alias("m")).select(F.col("m.ep").alias("ep"), F.col("m.d").alias("distance"))


def regime_limits(regime: str) -> tuple[Limits, float]:
    """Stage-1 limits and diversity weight of a noise regime."""
    spike, disc, drop, ldlj, weight = REGIMES[regime]
    return Limits(spike_rate=spike, disc_rate=disc, dropout=drop, ldlj=ldlj), weight


def regime_selection(gate_of, figures: DataFrame, regime: DataFrame, fraction: float, features=None, **two_stage) -> DataFrame:
    """The two-stage choice under the limits of the dataset's noise regime: lenient
    for calm and moderate data, strict for noisy data.  ``gate_of(figures, limits)`` gives the
    first stage; ``features(diversity_weight)`` may give (features, columns) of the second."""
    from .selection import two_stage as choose

    limits, weight = regime_limits(regime.first()["regime"])  # one row
    if features is not None:
        two_stage["features"], two_stage["cols"] = features(weight)
    return choose(gate_of(figures, limits), fraction, **two_stage)


def what_if(episodes: DataFrame, selected: DataFrame, predict, base_hours: float, seed: int = 42) -> DataFrame:
    """(condition, n_episodes, hours, success, measured): training on all
    episodes, on the selected ones, and on as many by a hash; hours go with the
    episodes, success is what ``predict(episodes (ep))`` says (one row with score)."""
    from .evidence import measured_else_simulated
    from .surprise import hashed_sample

    n, k = episodes.count(), selected.count()
    sides = {"full": episodes.select("ep"), "selected": selected.select("ep"), "random": hashed_sample(episodes.select("ep"), "ep", k, seed)}
    out = None
    for name, side in sides.items():
        row = predict(side).select(F.lit(name).alias("condition"), F.lit(n if name == "full" else k).alias("n_episodes"), F.lit(None).cast("double").alias("measured_hours"), F.lit(None).cast("double").alias("measured_success"), F.col("score").cast("double").alias("simulated"))
        out = row if out is None else out.unionByName(row)
    return measured_else_simulated(out, n, base_hours)


def drift_thresholds(lags: DataFrame, warn: float = 0.90, critical: float = 0.99) -> DataFrame:
    """One row: warning and critical, the given quantiles of the sizes of benign lags (ep, lag), at least 1 and 2 frames."""
    q = lags.where("lag is not null").agg(F.percentile(F.abs("lag").cast("double"), F.array(F.lit(warn), F.lit(critical))).alias("q"))
    return q.select(F.greatest(F.ceil(F.col("q")[0]), F.lit(1)).cast("long").alias("warning"), F.greatest(F.ceil(F.col("q")[1]), F.lit(2)).cast("long").alias("critical"))


def not_audited(datasets: DataFrame, done: DataFrame) -> DataFrame:
    """The (dataset, revision) rows that have no audit of that revision yet."""
    return datasets.join(done.select("dataset", "revision").distinct(), ["dataset", "revision"], "left_anti")


def leaderboard(results: DataFrame) -> DataFrame:
    """(rank, dataset, score): the best result of each dataset that has one, failed ones left out."""
    from .export import numbered

    best = results.where("score is not null and coalesce(failed, false) = false").groupBy("dataset").agg(F.max("score").alias("score"))
    order = best.withColumn("_o", F.struct((-F.col("score")).alias("s"), "dataset"))
    return numbered(order, "_o").select(F.col("place").alias("rank"), "dataset", "score")


def snapshot(dataset: str, revision: str, assessed: DataFrame, fired: DataFrame) -> DataFrame:
    """(dataset, revision, ep, flagged, priority): what labels are later compared with; flagged if any detector fired."""
    d = assessed.join(fired.select("ep").distinct().withColumn("flagged", F.lit(True)), "ep", "left")
    priority = 0.5 * F.coalesce("quality_risk", F.lit(0.0)) + 0.5 * F.col("anomaly")
    return d.select(F.lit(dataset).alias("dataset"), F.lit(revision).alias("revision"), "ep", F.coalesce("flagged", F.lit(False)).alias("flagged"), priority.alias("priority"))
