"""Smoothness of position actions.

The clock is taken as steady, as these are ratios in which the interval
cancels; only the log dimensionless jerk needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import in_order, median, norm, share, whole

SPIKE_FACTOR = 5.0
DISC_FACTOR = 0.20
FILTER_HZ = 10.0


def differences(steps: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Steps with v, dv and j: norms of the first, second and third differences (null at the start)."""
    lag = lambda c: F.lag(c).over(in_order())
    df = steps
    for k, order in enumerate(("1", "2", "3")):
        df = df.withColumns({f"{c}_d{order}": F.col(c if k == 0 else f"{c}_d{k}") - lag(c if k == 0 else f"{c}_d{k}") for c in dims})
    return df.withColumns({name: norm(f"{c}_d{k}" for c in dims) for name, k in (("v", 1), ("dv", 2), ("j", 3))})


def motion_metrics(steps: DataFrame, dims: tuple[str, ...] = ("a0",)) -> DataFrame:
    """(ep, n_steps, spike_rate, disc_rate).

    spike_rate: share of jerks over 5 medians, null below 5 steps, 0 if the
    median is 0.  disc_rate: share of velocity changes over a fifth of the largest
    speed, null below 3 steps, 0 without motion.  Both null if the clock
    doesn't advance.
    """
    d = differences(steps, dims)
    d = d.withColumn("dt", F.col("t") - F.lag("t").over(in_order()))
    d = d.withColumns({"jm": median("j").over(whole()), "vm": F.max("v").over(whole())})
    g = d.groupBy("ep").agg(
        F.count("*").alias("n_steps"), median("dt").alias("dt"), F.first("jm").alias("jm"), F.first("vm").alias("vm"),
        share(F.col("j") > SPIKE_FACTOR * F.col("jm")).alias("spikes"), share(F.col("dv") > DISC_FACTOR * F.col("vm")).alias("discs"),
    )
    runs = F.col("dt") > 0
    return g.select(
        "ep", "n_steps",
        F.when(runs & (F.col("n_steps") >= 5), F.when(F.col("jm") > 1e-12, F.col("spikes")).otherwise(F.lit(0.0))).alias("spike_rate"),
        F.when(runs & (F.col("n_steps") >= 3), F.when(F.col("vm") > 1e-12, F.col("discs")).otherwise(F.lit(0.0))).alias("disc_rate"),
    )


def filtered_discontinuity(steps: DataFrame, dims: tuple[str, ...], period: float) -> DataFrame:
    """(ep, disc_rate): velocity changes after a centred moving average of
    about a tenth of a second, the ends repeated; no filter at slow rates or
    for episodes shorter than the window."""
    w = round((1.0 / period) / FILTER_HZ)
    d = steps.withColumns({f"{c}_v": F.col(c) - F.lag(c).over(in_order()) for c in dims}).where("step > 0")
    if w > 1:
        before, after = w // 2, w - 1 - w // 2
        frame = in_order().rowsBetween(-before, after)
        i, n = F.col("step") - 1, F.count("*").over(whole())
        left = F.greatest(F.lit(before) - i, F.lit(0))
        right = F.greatest(i + after - (n - 1), F.lit(0))
        edge = in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        smooth = {f"{c}_f": (F.sum(f"{c}_v").over(frame) + left * F.first(f"{c}_v").over(edge) + right * F.last(f"{c}_v").over(edge)) / w for c in dims}
        d = d.withColumns(smooth | {"long": n >= w})
        d = d.withColumns({f"{c}_v": F.when(F.col("long"), F.col(f"{c}_f")).otherwise(F.col(f"{c}_v")) for c in dims})
    d = d.withColumns({f"{c}_c": F.col(f"{c}_v") - F.lag(f"{c}_v").over(in_order()) for c in dims})
    d = d.withColumns({"v": norm(f"{c}_v" for c in dims), "dv": norm(f"{c}_c" for c in dims)})
    d = d.withColumn("vm", F.max("v").over(whole()))
    g = d.groupBy("ep").agg(F.count("*").alias("n"), F.first("vm").alias("vm"), share(F.col("dv") > DISC_FACTOR * F.col("vm")).alias("discs"))
    return g.select("ep", F.when(F.col("n") >= 2, F.when(F.col("vm") > 1e-12, F.col("discs")).otherwise(F.lit(0.0))).alias("disc_rate"))


def whole_ldlj(steps: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(ep, ldlj): log dimensionless jerk of whole episodes of 5 or more steps
    that last and move; else null."""
    d = differences(steps, dims).withColumn("dt", F.col("t") - F.lag("t").over(in_order()))
    g = d.groupBy("ep").agg(
        F.count("*").alias("n"), median("dt").alias("dt"), (F.max_by("t", "step") - F.min_by("t", "step")).alias("dur"),
        F.max("v").alias("v"), F.sum(F.col("j") * F.col("j")).alias("jj"),
    )
    dt = F.col("dt")
    peak = F.col("v") / dt
    inner = F.pow("dur", F.lit(3)) / (peak * peak) * (F.col("jj") / F.pow(dt, F.lit(6))) * dt
    ok = (F.col("n") >= 5) & (dt > 0) & (F.col("dur") > 0) & (peak > 1e-12) & (inner > 0)
    return g.select("ep", F.when(ok, -F.log(inner)).alias("ldlj"))


def action_state_divergence(steps: DataFrame, actions: tuple[str, ...] = ("a0",), states: tuple[str, ...] = ("s0",)) -> DataFrame:
    """(ep, divergence): mean distance of action and state."""
    return steps.groupBy("ep").agg(F.avg(norm([F.col(a) - F.col(s) for a, s in zip(actions, states)])).alias("divergence"))


def divergence_flag(steps: DataFrame, actions: tuple[str, ...] = ("a0",), states: tuple[str, ...] = ("s0",)) -> DataFrame:
    """One row: divergence (the episodes' mean), low and high (2.5 and 97.5 %),
    relative and level.  Where a state is beyond 2 pi anywhere its unit isn't the
    radian: the level is INFO and relative has the share of the states' span."""
    per = action_state_divergence(steps, actions, states).agg(F.avg("divergence").alias("divergence"), F.percentile("divergence", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    far = F.greatest(*[F.max(F.abs(c)) for c in states], F.lit(0.0))
    span = F.sqrt(sum(((F.max(c) - F.min(c)) ** 2 for c in states), F.lit(0.0)))
    d = per.crossJoin(steps.agg(far.alias("far"), span.alias("span")))  # one row each
    other = F.col("far") > 2 * 3.141592653589793
    level = F.when(other, "INFO").when(F.col("divergence") >= 0.35, "CRITICAL").when(F.col("divergence") >= 0.15, "WARNING").otherwise("OK")
    return d.select("divergence", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), F.when(other & (F.col("span") > 0), F.col("divergence") / F.col("span")).alias("relative"), level.alias("level"))


def velocity(steps: DataFrame, dims: tuple[str, ...], kind: str = "position") -> DataFrame:
    """(ep, step, dims): velocities of actions that are positions (differences
    over the median interval), velocities (as they are) or accelerations (summed up from the start, over time)."""
    if kind not in ("position", "velocity", "acceleration"):
        raise ValueError(f"actions are positions, velocities or accelerations, not {kind}")
    if kind == "velocity":
        return steps.select("ep", "step", *dims)
    w = in_order()
    d = steps.withColumn("dt", F.col("t") - F.lag("t").over(w)).withColumn("every", median("dt").over(whole()))
    if kind == "position":
        return d.select("ep", "step", *[((F.col(c) - F.lag(c).over(w)) / F.col("every")).alias(c) for c in dims]).where(F.col(dims[0]).isNotNull())
    return d.select("ep", "step", *[(F.sum(c).over(w) * F.col("every")).alias(c) for c in dims])


def submovement_ldlj(steps: DataFrame, dims: tuple[str, ...], min_len: int = 5, valley: float = 0.5, low_peak: float = 0.1) -> DataFrame:
    """(ep, ldlj): log dimensionless jerk per sub-movement, weighted by length.

    Sub-movements are cut at speed minima that are below half of the smaller
    peak beside them; those under 5 steps join the one before, and those whose
    peak is below a tenth of the median peak don't count.  Cutting is
    sequential, so an episode's arrays go through a kernel.
    """
    cols = ["t", *dims]

    def kernel(pdf):
        import pandas as pd

        pdf = pdf.sort_values("step")
        t, a = pdf["t"].to_numpy(float), pdf[list(dims)].to_numpy(float)
        return pd.DataFrame({"ep": [pdf["ep"].iloc[0]], "ldlj": [ldlj_of(t, a, min_len, valley, low_peak)]})

    return steps.select("ep", "step", *cols).groupBy("ep").applyInPandas(kernel, "ep long, ldlj double")


def cut_points(speed, valley: float = 0.5, min_len: int = 5) -> list[tuple[int, int]]:
    """Sub-movements as half-open ranges."""
    n = len(speed)
    marks, last = [0], 0
    for i in range(1, n - 1):
        if speed[i] <= speed[i - 1] and speed[i] < speed[i + 1]:
            nxt = i + 1
            while nxt + 1 < n and speed[nxt + 1] >= speed[nxt]:
                nxt += 1
            if speed[i] < valley * min(speed[last : i + 1].max(), speed[i : nxt + 1].max()):
                marks.append(i)
                last = i
    marks.append(n)
    spans: list[tuple[int, int]] = []
    for a, b in zip(marks, marks[1:]):
        if spans and b - a < min_len:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    if len(spans) > 1 and spans[0][1] - spans[0][0] < min_len:
        spans[:2] = [(spans[0][0], spans[1][1])]
    return spans


def ldlj_of(t, a, min_len: int = 5, valley: float = 0.5, low_peak: float = 0.1) -> float | None:
    import numpy as np

    if len(t) < 5:
        return None
    dt = float(np.median(np.diff(t)))
    if dt <= 0:
        return None
    vel = np.diff(a, axis=0) / dt
    w = round((1.0 / dt) / FILTER_HZ)
    if w > 1 and len(vel) >= w:
        pad = np.pad(vel, ((w // 2, w - 1 - w // 2), (0, 0)), mode="edge")
        vel = np.stack([np.convolve(pad[:, d], np.ones(w) / w, "valid") for d in range(vel.shape[1])], 1)
    speed = np.linalg.norm(vel, axis=1)
    spans = cut_points(speed, valley, min_len)
    peaks = np.array([speed[s:e].max() for s, e in spans])
    found = []
    for (s, e), p in zip(spans, peaks):
        if e - s < min_len or p <= 1e-12 or p < low_peak * np.median(peaks):
            continue
        jerk = np.diff(vel[s:e], n=2, axis=0) / dt**2
        total = float((jerk**2).sum() * dt)
        if total > 0:
            found.append((-np.log(((e - s) * dt) ** 3 / p**2 * total), e - s))
    if not found:
        return None
    v, n = np.array(found).T
    return float((v * n).sum() / n.sum())
