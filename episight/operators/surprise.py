"""How badly a linear model of the dynamics predicts an episode, what that
says of it, and how rare its transitions are."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import in_order

#: Scores from which an episode is surprising, jerk from which that is corruption, and the z of a reason.
SURPRISING, JERKY, REASON_Z = 0.60, 0.04, 1.0
RIDGE = 1e-3


def normalised_transitions(steps: DataFrame, states: tuple[str, ...], actions: tuple[str, ...]) -> DataFrame:
    """(ep, z_*, a_*, n_*): states, actions and next states of all transitions, in deviations of the states and actions they start from."""
    w = in_order()
    d = steps.withColumns({f"next_{c}": F.lead(c).over(w) for c in states}).where(F.col(f"next_{states[0]}").isNotNull())
    stats = d.agg(*[f(c).alias(f"{n}_{c}") for c in (*states, *actions) for n, f in (("mean", F.avg), ("dev", F.stddev_pop))])
    d = d.crossJoin(F.broadcast(stats))  # one row
    z = lambda c, like: (F.col(c) - F.col(f"mean_{like}")) / F.greatest(F.col(f"dev_{like}"), F.lit(1e-8))
    return d.select("ep", *[z(c, c).alias(f"z_{c}") for c in states], *[z(c, c).alias(f"a_{c}") for c in actions], *[z(f"next_{c}", c).alias(f"n_{c}") for c in states])


def principal_axes(df: DataFrame, cols: list[str], k: int) -> tuple[np.ndarray, float]:
    """The first ``k`` principal axes (a row each, its largest part positive)
    and their share of the variance.  Covariances are aggregated; a matrix of the columns is solved on the driver."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    cov = np.zeros((len(cols), len(cols)))
    for (a, b), x in zip(pairs, row):
        cov[cols.index(a), cols.index(b)] = cov[cols.index(b), cols.index(a)] = x or 0.0
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    axes = vectors[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return axes, float(values[order].sum() / values.sum()) if values.sum() > 0 else 1.0


def project(df: DataFrame, cols: list[str], k: int, prefix: str = "p") -> DataFrame:
    """``df`` with p0, p1, ...: centred columns on their first principal axes; as they are with fewer than k + 1 rows."""
    if df.limit(k + 1).count() < k + 1:
        return df.withColumns({f"{prefix}{i}": F.col(c) for i, c in enumerate(cols[:k])})
    axes, _ = principal_axes(df, cols, k)
    means = df.agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])
    d = df.crossJoin(F.broadcast(means))  # one row
    new = {f"{prefix}{i}": sum(((F.col(c) - F.col(f"mean_{c}")) * float(x) for c, x in zip(cols, axis)), F.lit(0.0)) for i, axis in enumerate(axes)}
    return d.withColumns(new).drop(*[f"mean_{c}" for c in cols])


def surprise(steps: DataFrame, states: tuple[str, ...], actions: tuple[str, ...], latent: int = 16, ridge: float = RIDGE) -> DataFrame:
    """(ep, surprise): mean squared error of a ridge forecast of the next latent
    state, scaled to 0..1 over episodes; 0 for episodes without transitions.

    Latent states are principal components of the normalised ones; the normal
    equations are sums, and a matrix of the inputs is solved on the driver.
    """
    d = normalised_transitions(steps, states, actions)
    z, n = [f"z_{c}" for c in states], [f"n_{c}" for c in states]
    if latent < len(states):
        axes, _ = principal_axes(d, z, latent)
        turn = lambda cols, i: sum((F.col(c) * float(x) for c, x in zip(cols, axes[i])), F.lit(0.0))
        d = d.select("ep", *[turn(z, i).alias(f"z{i}") for i in range(latent)], *[f"a_{c}" for c in actions], *[turn(n, i).alias(f"n{i}") for i in range(latent)])
        z, n = [f"z{i}" for i in range(latent)], [f"n{i}" for i in range(latent)]
    x = [*[F.col(c) for c in z], *[F.col(f"a_{c}") for c in actions], F.lit(1.0)]
    sums = d.agg(*[F.coalesce(F.sum(a * b), F.lit(0.0)).alias(f"x{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)], *[F.coalesce(F.sum(a * F.col(b)), F.lit(0.0)).alias(f"y{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(n)]).first()
    m = np.array(list(sums), float)
    w = np.linalg.solve(m[: len(x) ** 2].reshape(len(x), -1) + ridge * np.eye(len(x)), m[len(x) ** 2 :].reshape(len(x), -1))
    error = sum(((F.col(b) - sum((a * float(w[i, j]) for i, a in enumerate(x)), F.lit(0.0))) ** 2 for j, b in enumerate(n)), F.lit(0.0)) / len(n)
    g = steps.select("ep").distinct().join(d.groupBy("ep").agg(F.avg(error).alias("e")), "ep", "left").withColumn("e", F.coalesce("e", F.lit(0.0)))
    span = g.agg(F.min("e").alias("lo"), F.max("e").alias("hi"))
    g = g.crossJoin(F.broadcast(span))  # one row
    return g.select("ep", F.when(F.col("hi") > F.col("lo"), (F.col("e") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("e")).alias("surprise"))


def surprise_verdicts(scores: DataFrame, jerk: DataFrame) -> DataFrame:
    """(ep, surprise, jerk, verdict): NOVEL, CORRUPTED (surprising and jerky) or REDUNDANT."""
    d = scores.join(jerk.select("ep", "jerk"), "ep", "left").withColumn("jerk", F.coalesce("jerk", F.lit(0.0)))
    high = F.col("surprise") >= SURPRISING
    return d.select("ep", "surprise", "jerk", F.when(high & (F.col("jerk") < JERKY), "NOVEL").when(high, "CORRUPTED").otherwise("REDUNDANT").alias("verdict"))


def episode_signals(steps: DataFrame, actions: tuple[str, ...], states: tuple[str, ...]) -> DataFrame:
    """(ep, energy, jerkiness, state_range, length): mean size of the actions and of their second differences, mean range of the states, steps."""
    w = in_order()
    norm = lambda cols: F.sqrt(sum((F.col(c) ** 2 for c in cols), F.lit(0.0)))
    d = steps.withColumns({f"d1_{c}": F.col(c) - F.lag(c).over(w) for c in actions})
    d = d.withColumns({f"d2_{c}": F.col(f"d1_{c}") - F.lag(f"d1_{c}").over(w) for c in actions})
    return d.groupBy("ep").agg(
        F.avg(norm(actions)).alias("energy"),
        F.coalesce(F.avg(norm([f"d2_{c}" for c in actions])), F.lit(0.0)).alias("jerkiness"),
        (sum((F.max(c) - F.min(c) for c in states), F.lit(0.0)) / len(states)).alias("state_range"),
        F.count("*").cast("double").alias("length"),
    )


def reasons(signals: DataFrame, names: tuple[str, ...] = ("energy", "jerkiness", "state_range", "length")) -> DataFrame:
    """(ep, reason): the signal that is farthest from the episodes' mean, if by a deviation at least; else "dynamics"."""
    stats = signals.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("mean", F.avg), ("dev", F.stddev_pop))])
    d = signals.crossJoin(F.broadcast(stats))  # one row
    z = F.array(*[F.struct(F.when(F.col(f"dev_{c}") >= 1e-8, F.round(F.abs((F.col(c) - F.col(f"mean_{c}")) / F.col(f"dev_{c}")), 9)).otherwise(0.0).alias("z"), F.lit(-i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(names)])
    best = F.array_max(z)
    return d.select("ep", F.when(best["z"] >= REASON_Z, best["name"]).otherwise("dynamics").alias("reason"))


def curate_surprising(gate: DataFrame, scores: DataFrame, signals: DataFrame, threshold: float = SURPRISING) -> DataFrame:
    """(ep, surprise, reason): episodes that pass the gate and surprise, and why."""
    kept = gate.where("status <> 'bad'").select("ep").join(scores.where(F.col("surprise") >= threshold), "ep")
    return kept.join(reasons(signals), "ep").select("ep", "surprise", "reason")


def voxel_novelty(vectors: DataFrame, cols: list[str], resolution: float = 0.5) -> DataFrame:
    """(ep, novelty): share of all occupied voxels that this episode alone occupies."""
    v = vectors.select("ep", *[F.rint(F.col(c) / resolution).cast("long").alias(c) for c in cols]).distinct()
    owned = v.groupBy(*cols).agg(F.count("*").alias("n"), F.min("ep").alias("ep"))
    total = owned.agg(F.count("*").alias("total"))
    mine = owned.where("n = 1").groupBy("ep").agg(F.count("*").alias("k"))
    d = vectors.select("ep").distinct().join(mine, "ep", "left").crossJoin(F.broadcast(total))  # one row
    return d.select("ep", F.when(F.col("total") > 0, F.coalesce("k", F.lit(0)) / F.col("total")).otherwise(0.0).alias("novelty"))


def voxel_redundancy(vectors: DataFrame, cols: list[str], resolution: float = 0.5) -> DataFrame:
    """One row: redundancy, one less the share of distinct voxels among the vectors."""
    v = vectors.groupBy(*[F.rint(F.col(c) / resolution).cast("long").alias(c) for c in cols]).agg(F.count("*").alias("n"))
    return v.agg((1.0 - F.count("*") / F.sum("n")).alias("redundancy"))


def entropy_2d(points: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """One row: bits of the points on a grid over their ranges; a constant one spans a unit around itself."""
    span = points.agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    d = points.crossJoin(F.broadcast(span))  # one row

    def cell(c: str):
        flat = F.col(f"hi_{c}") <= F.col(f"lo_{c}")
        return F.when(flat, bins // 2).otherwise(F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * bins), F.lit(bins - 1)))

    n = d.groupBy(cell(x).alias("i"), cell(y).alias("j")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    p = n.crossJoin(F.broadcast(total)).select((F.col("n") / F.col("total")).alias("p"))  # one row
    return p.agg(F.coalesce(-F.sum(F.col("p") * F.log2("p")), F.lit(0.0)).alias("bits"))


def hashed_sample(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of key and seed."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(most)


def knn_density(points: DataFrame, cols: list[str], k: int = 5, most: int = 2000, key: str = "ep") -> DataFrame:
    """One row: mean distance to the ``k``-th nearest other point, over at most
    ``most`` points (the reference size of this figure); 0 with k points or fewer."""
    import pyarrow as pa

    sample = hashed_sample(points, key, most).select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    x = np.array([r.x for r in sample.collect()]).reshape(-1, len(cols))  # at most ``most`` rows
    if len(x) <= k:
        return points.sparkSession.createDataFrame([(0.0,)], "density double")

    def run(batches):
        for b in batches:
            if b.num_rows:
                q = np.array(b.column(0).to_pylist())
                d = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(2))
                yield pa.RecordBatch.from_arrays([pa.array(np.partition(d, k, axis=1)[:, k])], names=["d"])

    return sample.mapInArrow(run, "d double").agg(F.avg("d").alias("density"))


def normalised_hsic(points: DataFrame, xs: list[str], ys: list[str], most: int = 1000, key: str = "ep") -> float:
    """Dependence of two sets of columns (0 to 1) by RBF kernels with median
    widths, over at most ``most`` points (the reference size of this figure)."""
    rows = hashed_sample(points, key, most).select(*xs, *ys).collect()  # at most ``most`` rows
    data = np.array([list(map(float, r)) for r in rows]).reshape(-1, len(xs) + len(ys))
    if len(data) < 4:
        return 0.0

    def kernel(x: np.ndarray) -> np.ndarray:
        d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
        width = np.median(d[d > 0]) if (d > 0).any() else 1.0
        k = np.exp(-d / width)
        return k - k.mean(0) - k.mean(1)[:, None] + k.mean()

    a, b = kernel(data[:, : len(xs)]), kernel(data[:, len(xs) :])
    scale = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / scale) if scale > 0 else 0.0
