"""Repairs and planned damage of episodes: smoothing, resampling, trimming;
noise, spikes, delays and cuts, and what they do to the figures.

What is random comes from MD5 of episode, step and seed, so it doesn't hang on
partitions, order or retries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import in_order, whole
from .dynamics import interpolate
from .tasks import trim_dead_time


def polynomial_weights(length: int, order: int = 2) -> list[list[float]]:
    """Row i: weights of ``length`` values whose sum is the least-squares polynomial through them at place i."""
    x = np.arange(length) - length // 2
    a = np.vander(x, order + 1)
    return (a @ np.linalg.pinv(a)).round(12).tolist()


def smooth(steps: DataFrame, column: str = "a0", window: int = 7, order: int = 2) -> DataFrame:
    """(ep, step, value): the Savitzky-Golay filter, at both ends the polynomial
    of the outer ``window`` values; shorter episodes use the largest odd window that fits, below 3 steps nothing changes."""
    around = in_order().rowsBetween(-(window - 1), window - 1)
    d = steps.select("ep", "step", F.col(column).cast("double").alias("v")).withColumns({"n": F.count("*").over(whole()), "near": F.collect_list("v").over(around)})
    out = F.col("v")
    for size in range(3, window + 1, 2):
        fits = F.col("n") >= size if size == window else F.col("n").isin(size, size + 1)
        first = F.least(F.greatest(F.col("step") - size // 2, F.lit(0)), F.col("n") - size)  # of the window, in the episode
        skip = first - F.greatest(F.col("step") - (window - 1), F.lit(0))  # in ``near``
        table = F.array(*[F.array(*map(F.lit, row)) for row in polynomial_weights(size, order)])
        value = F.aggregate(F.zip_with(F.slice("near", skip.cast("int") + 1, size), F.get(table, (F.col("step") - first).cast("int")), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        out = F.when(fits, value).otherwise(out)
    return d.select("ep", "step", out.alias("value"))


def cure(steps: DataFrame, columns: tuple[str, ...] = ("a0",), threshold: float = 5e-4) -> DataFrame:
    """(ep, step, t, columns): resampled to even times, smoothed, and cut to where something moves."""
    even = None
    for c in columns:
        part = interpolate(steps, c).select("ep", F.col("i").alias("step"), F.col("value").alias(c))
        even = part if even is None else even.join(part, ["ep", "step"])
    clock = steps.withColumn("dt", F.col("t") - F.lag("t").over(in_order())).groupBy("ep").agg(F.min("t").alias("t0"), F.percentile("dt", F.lit(0.5)).alias("every"))
    out = None
    for c in columns:
        part = smooth(even, c).withColumnRenamed("value", c)
        out = part if out is None else out.join(part, ["ep", "step"])
    out = out.join(clock, "ep").withColumn("t", F.col("t0") + F.col("step") * F.col("every")).drop("t0", "every")
    span = trim_dead_time(out, threshold, columns)
    return out.join(span.select("ep", "start", "end"), "ep").where((F.col("step") >= F.col("start")) & (F.col("step") < F.col("end"))).select("ep", "step", "t", *columns)


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from 52 bits of MD5."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double")
    return (h + 0.5) / F.lit(float(2**52))


def add_jitter(steps: DataFrame, std_ms: float, seed: int = 42) -> DataFrame:
    """(ep, step, t): times with normal noise, in order again."""
    u, v = uniform("ep", "step", F.lit(seed), F.lit("u")), uniform("ep", "step", F.lit(seed), F.lit("v"))
    noisy = steps.select("ep", "step", (F.col("t") + std_ms / 1000.0 * F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * np.pi * v)).alias("t"))
    return noisy.select("ep", (F.row_number().over(Window.partitionBy("ep").orderBy("t", "step")) - 1).alias("step"), "t")


def inject_spikes(steps: DataFrame, rate: float, column: str = "a0", seed: int = 42) -> DataFrame:
    """(ep, step, value): so many inner steps (a share ``rate`` of all, at least
    one, at most a quarter) trade places one after another with any step that is
    over max(2, a tenth of the episode) away; episodes under 4 steps stay.

    Only the swaps of an episode are put together in one place; the values are joined to where they end up.
    """
    import pandas as pd

    n = steps.groupBy("ep").agg(F.count("*").alias("n"))
    d = steps.select("ep", "step", F.col(column).alias("value")).join(n, "ep")
    key = F.md5(F.concat_ws("|", F.col("ep").cast("string"), F.col("step").cast("string"), F.lit(str(seed))))
    inner = d.where("n >= 4 and step between 1 and n - 2").withColumn("place", F.row_number().over(Window.partitionBy("ep").orderBy(key, "step")))
    count = F.least(F.greatest(F.lit(1), F.floor(F.col("n") * rate)), F.floor(F.col("n") / 4))
    gap = F.greatest(F.lit(2), F.floor(F.col("n") / 10))
    left, right = F.greatest(F.lit(0), F.col("step") - gap), F.greatest(F.lit(0), F.col("n") - 1 - F.col("step") - gap)
    drawn = F.floor(uniform("ep", "step", F.lit(seed), F.lit("partner")) * (left + right))
    partner = F.when(drawn < left, drawn).otherwise(F.col("step") + gap + 1 + drawn - left)
    swaps = inner.where((F.col("place") <= count) & (left + right > 0)).select("ep", "place", F.col("step").cast("long").alias("i"), partner.cast("long").alias("j"))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        source: dict[int, int] = {}
        for i, j in pdf.sort_values("place")[["i", "j"]].itertuples(index=False):
            source[i], source[j] = source.get(j, j), source.get(i, i)
        return pd.DataFrame({"ep": pdf["ep"].iloc[0], "step": list(source), "source": list(source.values())})

    moved = swaps.groupBy("ep").applyInPandas(compose, "ep long, step long, source long")
    taken = moved.join(d.select("ep", F.col("step").alias("source"), F.col("value").alias("taken")), ["ep", "source"]).select("ep", "step", "taken", F.lit(True).alias("swapped"))
    out = d.join(taken, ["ep", "step"], "left")
    return out.select("ep", "step", F.when(F.col("swapped"), F.col("taken")).otherwise(F.col("value")).alias("value"))


def some_episodes(steps: DataFrame, fraction: float, seed: int, what: str) -> DataFrame:
    """(ep): a share ``fraction`` of the episodes, at least one, those with the smallest hashes."""
    from .export import numbered

    eps = steps.select("ep").distinct().withColumn("_h", F.struct(F.md5(F.concat_ws("|", F.col("ep").cast("string"), F.lit(str(seed)), F.lit(what))).alias("h"), "ep"))
    ranked = numbered(eps, "_h")
    n = ranked.agg(F.count("*").alias("n"))
    return ranked.crossJoin(F.broadcast(n)).where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") * fraction))).select("ep")  # one row


def delay(steps: DataFrame, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """(ep, step, t): the clocks of a share of the episodes are 50 to 200 ms late."""
    late = some_episodes(steps, fraction, seed, "late").withColumn("_late", F.lit(True))
    d = steps.select("ep", "step", "t").join(late, "ep", "left")
    moved = F.col("t") + 0.05 + 0.15 * uniform("ep", F.lit(seed), F.lit("delay"))
    return d.select("ep", "step", F.when(F.col("_late"), moved).otherwise(F.col("t")).alias("t"))


def truncate(steps: DataFrame, keep: float = 0.8, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """The first ``keep`` of a share of the episodes, at least 2 steps; the others whole."""
    short = some_episodes(steps, fraction, seed, "short").withColumn("_short", F.lit(True))
    d = steps.withColumn("n", F.count("*").over(whole())).join(short, "ep", "left")
    return d.where(F.col("_short").isNull() | (F.col("step") < F.greatest(F.lit(2), F.floor(F.col("n") * keep)))).drop("n", "_short")


def damage_report(before: DataFrame, after: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(metric, before, after, delta): means of two tables of figures by episode."""
    row = lambda df, name: df.agg(*[F.avg(m).alias(m) for m in metrics]).unpivot([], list(metrics), "metric", name)
    d = row(before, "before").join(row(after, "after"), "metric")
    return d.withColumn("delta", F.col("after") - F.col("before"))


#: The least change of a figure that counts as a reaction, and the figures of which less is worse.
REACTS = {"jitter_cv": 0.001, "dropout": 0.005, "spike_rate": 0.005, "disc_rate": 0.005, "ldlj": 0.1, "entropy": 0.1}
LESS_IS_WORSE = ("ldlj", "entropy")


def reactions(report: DataFrame) -> DataFrame:
    """``report`` (of ``damage_report``) with reaction: none below the figure's least
    change, better, worse, or strong (worse by over five times that)."""
    least = F.lit(0.1)
    for name, x in REACTS.items():
        least = F.when(F.col("metric") == name, x).otherwise(least)
    worse = F.when(F.col("metric").isin(*LESS_IS_WORSE), F.col("delta") < 0).otherwise(F.col("delta") > 0)
    size = F.abs("delta")
    return report.withColumn("reaction", F.when(size.isNull() | (size < least), "none").when(~worse, "better").when(size > 5 * least, "strong").otherwise("worse"))


def relative_poses(poses: DataFrame) -> DataFrame:
    """(ep, step, dx, dy, dz, droll, dpitch, dyaw) from (ep, step, x, y, z, qx,
    qy, qz, qw): the move to the next step in the frame of this one, its rotation as
    xyz Euler angles; quaternions are normalised, the last step has no move."""
    w = in_order()
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in ("qx", "qy", "qz", "qw")), F.lit(0.0)))
    d = poses.withColumns({c: F.col(c) / size for c in ("qx", "qy", "qz", "qw")})
    d = d.withColumns({f"n{c}": F.lead(c).over(w) for c in ("x", "y", "z", "qx", "qy", "qz", "qw")}).where("nx is not null")
    c = F.col
    ux, uy, uz, s = -c("qx"), -c("qy"), -c("qz"), c("qw")  # the inverse of this step's rotation
    v = [c("nx") - c("x"), c("ny") - c("y"), c("nz") - c("z")]
    t = [2 * (uy * v[2] - uz * v[1]), 2 * (uz * v[0] - ux * v[2]), 2 * (ux * v[1] - uy * v[0])]
    local = [v[0] + s * t[0] + uy * t[2] - uz * t[1], v[1] + s * t[1] + uz * t[0] - ux * t[2], v[2] + s * t[2] + ux * t[1] - uy * t[0]]
    d = d.withColumns(dict(zip(("dx", "dy", "dz"), local)))
    bx, by, bz, bw = (c(f"n{k}") for k in ("qx", "qy", "qz", "qw"))
    q = {"rx": s * bx + ux * bw + uy * bz - uz * by, "ry": s * by - ux * bz + uy * bw + uz * bx, "rz": s * bz + ux * by - uy * bx + uz * bw, "rw": s * bw - ux * bx - uy * by - uz * bz}
    d = d.withColumns(q)
    x, y, z, r = c("rx"), c("ry"), c("rz"), c("rw")
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (r * y - z * x)))
    return d.select("ep", "step", "dx", "dy", "dz", F.atan2(2 * (r * x + y * z), 1 - 2 * (x * x + y * y)).alias("droll"), F.asin(sine).alias("dpitch"), F.atan2(2 * (r * z + x * y), 1 - 2 * (y * y + z * z)).alias("dyaw"))
