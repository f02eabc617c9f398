"""Grippers, contact, phases and other runs inside episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import in_order, median, min_max, norm, share, whole
from ..sources.episodes import dimensions

SLOW = 0.08


def gripper_dims(steps: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(dim, near_extremes, in_middle, is_gripper): dimensions whose values,
    scaled to their range, are in the outer fifths at least 65 % of the time and
    in (0.3, 0.7) at most 10 %; constant ones and tables under 10 rows have none."""
    wide = dimensions(steps, dims)
    span = wide.groupBy("dim").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    x = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    scaled = wide.join(F.broadcast(span), "dim").where("hi - lo >= 1e-8 and n >= 10").withColumn("x", x)  # a row a dimension
    g = scaled.groupBy("dim").agg(share((F.col("x") < 0.2) | (F.col("x") > 0.8)).alias("near_extremes"), share((F.col("x") > 0.3) & (F.col("x") < 0.7)).alias("in_middle"))
    return g.withColumn("is_gripper", (F.col("near_extremes") >= 0.65) & (F.col("in_middle") <= 0.10))


def contact_steps(steps: DataFrame, gripper: str, active: tuple[str, ...]) -> DataFrame:
    """Steps with ``closed`` (the gripper is on the side where it is more often)
    and ``contact`` (closed, or slower than 8 % of the episode's top speed)."""
    d = steps.withColumn("x", min_max(gripper, whole()))
    range_ = F.max(gripper).over(whole()) - F.min(gripper).over(whole())
    low, high = F.avg((F.col("x") < 0.3).cast("double")).over(whole()), F.avg((F.col("x") > 0.7).cast("double")).over(whole())
    d = d.withColumns({"low": low, "high": high, "moves": range_ >= 1e-8})
    is_high = F.col("high") >= F.col("low")
    closed = F.col("moves") & F.when(is_high, F.col("x") > 0.5).otherwise(F.col("x") < 0.5)
    d = d.withColumn("closed", closed)
    d = d.withColumn("speed", norm(F.col(c) - F.lag(c).over(in_order()) for c in active))
    d = d.withColumn("top", F.max("speed").over(whole()))
    slow = F.coalesce((F.col("top") > 0) & (F.col("speed") < SLOW * F.col("top")), F.lit(False))
    return d.withColumn("contact", F.col("closed") | slow)


def contact_fraction(steps: DataFrame, gripper: str, active: tuple[str, ...]) -> DataFrame:
    """(ep, contact_fraction): 0 below 2 steps."""
    g = contact_steps(steps, gripper, active).groupBy("ep").agg(F.count("*").alias("n"), share(F.col("contact")).alias("c"))
    return g.select("ep", F.when(F.col("n") >= 2, F.col("c")).otherwise(F.lit(0.0)).alias("contact_fraction"))


def grasp_count(steps: DataFrame, gripper: str, active: tuple[str, ...]) -> DataFrame:
    """(ep, grasps): changes from open to closed; null below 3 steps."""
    d = contact_steps(steps, gripper, active)
    turn = F.col("closed") & ~F.lag("closed").over(in_order())
    g = d.withColumn("turn", turn).groupBy("ep").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("turn"), F.lit(False)).cast("long")).alias("k"))
    return g.select("ep", F.when(F.col("n") >= 3, F.col("k")).alias("grasps"))


def islands(steps: DataFrame, mask: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """(ep, first, last, length) of each run of steps with a true mask."""
    on = steps.withColumn("m", mask).where("m")
    on = on.withColumn("island", F.col("step") - F.row_number().over(in_order()))
    return on.groupBy("ep", "island").agg(F.min("step").alias("first"), F.max("step").alias("last"), F.count("*").alias("length"), *[F.first(c).alias(c) for c in carry]).drop("island")


def sustained_runs(steps: DataFrame, mask: Column, min_run: int) -> DataFrame:
    """(ep, longest, first_run, last_run): the longest run, where the first one
    of at least ``min_run`` starts and the last one ends; 0 and nulls without."""
    runs = islands(steps, mask)
    long = F.col("length") >= min_run
    g = runs.groupBy("ep").agg(F.max("length").alias("longest"), F.min(F.when(long, F.col("first"))).alias("first_run"), F.max(F.when(long, F.col("last"))).alias("last_run"))
    return steps.select("ep").distinct().join(g, "ep", "left").withColumn("longest", F.coalesce("longest", F.lit(0)))


def phase_fractions(steps: DataFrame, gripper: str, active: tuple[str, ...], min_run: int = 3) -> DataFrame:
    """(ep, approach, contact, retract): shares of steps before, within and
    after the contact, which is smoothed by a vote of ``min_run`` steps (missing
    ones vote no) and lasts from its first to its last sustained run."""
    d = contact_steps(steps, gripper, active)
    before = min_run // 2
    votes = F.sum(F.col("contact").cast("int")).over(in_order().rowsBetween(-before, min_run - 1 - before))
    d = d.withColumn("voted", votes / min_run >= 0.5)
    n = d.groupBy("ep").agg(F.count("*").alias("n"))
    g = n.join(sustained_runs(d, F.col("voted"), min_run), "ep")
    none = F.col("first_run").isNull() | (F.col("n") < 2)
    return g.select(
        "ep",
        F.when(none, 1.0).otherwise(F.col("first_run") / F.col("n")).alias("approach"),
        F.when(none, 0.0).otherwise((F.col("last_run") - F.col("first_run") + 1) / F.col("n")).alias("contact"),
        F.when(none, 0.0).otherwise((F.col("n") - F.col("last_run") - 1) / F.col("n")).alias("retract"),
    )


def hold_steps(steps: DataFrame, actions: tuple[str, ...], states: tuple[str, ...], vel_frac: float = 0.05, min_run: int = 5) -> DataFrame:
    """The steps, with an offset (action less state) a dimension, in a run of
    ``min_run`` or more that are reached by a change of state below ``vel_frac`` of
    the episode's mean deviation (1 if that is 0) times sqrt(dimensions)."""
    w = in_order()
    moved = norm([F.col(c) - F.lag(c).over(w) for c in states])
    dev = sum((F.stddev_pop(c).over(whole()) for c in states), F.lit(0.0)) / len(states)
    d = steps.withColumns({"ds": moved, "dev": dev})
    limit = vel_frac * F.when(F.col("dev") == 0, 1.0).otherwise(F.col("dev")) * len(states) ** 0.5
    d = d.withColumn("still", F.coalesce(F.col("ds") < limit, F.lit(False)))
    d = d.withColumn("island", F.when(F.col("still"), F.col("step") - F.sum(F.col("still").cast("int")).over(w)))
    d = d.withColumn("run", F.count("*").over(Window.partitionBy("ep", "island")))
    held = d.where(F.col("still") & (F.col("run") >= min_run))
    return held.select("ep", "step", *[(F.col(a) - F.col(s)).alias(f"off_{a}") for a, s in zip(actions, states)])


def hold_offsets(steps: DataFrame, actions: tuple[str, ...] = ("a0",), states: tuple[str, ...] = ("s0",), vel_frac: float = 0.05, min_run: int = 5) -> DataFrame:
    """(ep, dim, n_hold, mean_offset, offset_std): action minus state over held steps."""
    held = hold_steps(steps, actions, states, vel_frac, min_run)
    rows = held.unpivot(["ep", "step"], [f"off_{a}" for a in actions], "dim", "off")
    return rows.groupBy("ep", F.substring("dim", 5, 100).alias("dim")).agg(F.count("*").alias("n_hold"), F.avg("off").alias("mean_offset"), F.stddev_pop("off").alias("offset_std"))


def calibration_drift(steps: DataFrame, actions: tuple[str, ...], states: tuple[str, ...], min_frames: int = 20, consistent: float = 2.0, warning: float = 0.03) -> DataFrame:
    """(dim, n_stable, mean_offset, fraction, systematic, level): offsets over all
    held steps; systematic if the mean is twice the deviation, a warning if it is then 3 %
    of the range of the state (of the episodes with holds).  INFO below ``min_frames`` held steps."""
    held = hold_steps(steps, actions, states)
    off = held.agg(F.count("*").alias("n_stable"), *[f(f"off_{a}").alias(f"{k}_{a}") for a in actions for k, f in (("mean", F.avg), ("dev", F.stddev_pop))])
    span = steps.join(held.select("ep").distinct(), "ep", "left_semi").agg(*[(F.max(c) - F.min(c)).alias(f"range_{a}") for a, c in zip(actions, states)])
    one = off.crossJoin(span)  # one row each
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("dim"), F.col(f"mean_{a}").alias("mean"), F.col(f"dev_{a}").alias("dev"), F.col(f"range_{a}").alias("range")) for a in actions])).alias("r")
    d = one.select("n_stable", rows).select("n_stable", "r.*")
    size = F.abs("mean")
    fraction = size / F.when(F.col("range") < 1e-9, 1.0).otherwise(F.col("range"))
    systematic = size / F.greatest("dev", F.lit(1e-9)) >= consistent
    level = F.when(F.col("n_stable") < min_frames, "INFO").when(systematic & (fraction >= warning), "WARNING").otherwise("OK")
    return d.select("dim", "n_stable", F.col("mean").alias("mean_offset"), fraction.alias("fraction"), systematic.alias("systematic"), level.alias("level"))


def force_contact(steps: DataFrame, force: tuple[str, ...], contact: str | None = None, touching: float = 0.5) -> DataFrame:
    """(ep, spike_rate, contact_rate): share of changes of the force's size that
    are over 5 * 1.4826 median deviations (at least 1e-4) from the median one,
    and share of steps whose contact is over ``touching``."""
    d = steps.withColumn("size", norm(force)).withColumn("shock", F.abs(F.col("size") - F.lag("size").over(in_order())))
    d = d.withColumn("mid", median("shock").over(whole())).withColumn("mad", median(F.abs(F.col("shock") - F.col("mid"))).over(whole()))
    spike = F.col("shock") > F.col("mid") + 5.0 * 1.4826 * F.greatest("mad", F.lit(1e-4))
    rate = F.avg((F.col(contact) > touching).cast("double")) if contact else F.lit(None).cast("double")
    return d.groupBy("ep").agg(F.coalesce(share(spike), F.lit(0.0)).alias("spike_rate"), rate.alias("contact_rate"), F.count("shock").alias("n_shocks"), F.count("*").alias("n_steps"))


def force_flags(episodes: DataFrame) -> DataFrame:
    """(metric, value, level): spikes over all changes, a warning over 1 %, and contacts over all steps, critical below 1 %."""
    g = episodes.agg((F.sum(F.col("spike_rate") * F.col("n_shocks")) / F.sum("n_shocks")).alias("s"), (F.sum(F.col("contact_rate") * F.col("n_steps")) / F.sum("n_steps")).alias("c"))
    spike = F.struct(F.lit("force_spike_rate").alias("metric"), F.col("s").alias("value"), F.when(F.col("s") > 0.01, "WARNING").otherwise("OK").alias("level"))
    drop = F.struct(F.lit("contact_dropout").alias("metric"), F.col("c").alias("value"), F.when(F.col("c") < 0.01, "CRITICAL").otherwise("OK").alias("level"))
    return g.select(F.explode(F.array(spike, drop)).alias("r")).select("r.*").where("value is not null")


def grasp_summary(grasps: DataFrame) -> DataFrame:
    """One row: n_episodes, mean_grasps, zero_share, level of (ep, grasps): a warning if over half have none."""
    g = grasps.where("grasps is not null").agg(F.count("*").alias("n_episodes"), F.avg("grasps").alias("mean_grasps"), F.avg((F.col("grasps") == 0).cast("double")).alias("zero_share"))
    level = F.when(F.col("n_episodes") == 0, "INFO").when(F.col("zero_share") > 0.5, "WARNING").otherwise("OK")
    return g.select("n_episodes", "mean_grasps", "zero_share", level.alias("level"))


def trim_dead_time(steps: DataFrame, threshold: float = 5e-4, columns: tuple[str, ...] = ("a0",)) -> DataFrame:
    """(ep, n, start, end): the range of steps left when stillness at both ends is
    cut, with 2 steps kept before and 3 after; whole if under 5 steps or if hardly any would be left.

    A step moves if the mean rate of change of its columns is over ``threshold``."""
    w = in_order()
    dt = F.greatest(F.col("t") - F.lag("t").over(w), F.lit(1e-5))
    d = steps.withColumn("speed", sum((F.abs(F.col(c) - F.lag(c).over(w)) / dt for c in columns), F.lit(0.0)) / len(columns))
    moving = F.col("speed") > threshold
    g = d.groupBy("ep").agg(F.count("*").alias("n"), F.min(F.when(moving, F.col("step") - 1)).alias("lo"), F.max(F.when(moving, F.col("step") - 1)).alias("hi"))
    start, end = F.greatest(F.col("lo") - 2, F.lit(0)), F.least(F.col("hi") + 3, F.col("n"))
    whole_ = (F.col("n") < 5) | F.col("lo").isNull() | (end - start <= 2)
    return g.select("ep", "n", F.when(whole_, 0).otherwise(start).cast("long").alias("start"), F.when(whole_, F.col("n")).otherwise(end).cast("long").alias("end"))
