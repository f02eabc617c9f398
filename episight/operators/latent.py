"""Transitions of a minimal distance in a state space, and what they say of a dataset's dynamics.

The walk of an episode is sequential: from an anchor the first state farther
than epsilon ends a transition and is the next anchor.  Steps lie in range
partitions of (ep, step); each partition walks the episodes that begin in it,
and an episode that goes on in the next partition hands over its anchor and
running sums, a row a partition.  So an episode may be as long as the whole
table: it is never one task's group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import in_order
from ..functions.lineage import cut_lineage
from . import surprise
from .moments import matrix
from .order import exact_quantiles

TRANSITIONS = "ep long, start long, end long, z array<double>, a array<double>, d array<double>"
#: Epsilon in median steps, ridge, edge of a voxel, robust deviations of an outlier.
ALPHA, RIDGE, VOXEL, OUTLIER = 3.0, 1e-4, 0.5, 3.5


def epsilon(steps: DataFrame, states: Sequence[str], alpha: float = ALPHA) -> float:
    """``alpha`` times the median distance of adjacent states."""
    far = F.sqrt(sum(((F.col(c) - F.lag(c).over(in_order())) ** 2 for c in states), F.lit(0.0)))
    mid = exact_quantiles(cut_lineage(steps.select(far.alias("x")).where("x is not null")), "x", [0.5])
    return alpha * ((mid[0] if mid else None) or 1e-5)


class Walk:
    """One episode's walk: its anchor and what has been added up since."""

    def __init__(self, z: np.ndarray, step: int, total: np.ndarray, count: int):
        self.z, self.step, self.total, self.count = z, step, total, count

    def over(self, step: np.ndarray, z: np.ndarray, a: np.ndarray, eps: float):
        """The transitions that end in these rows; the walk is then at their end.

        Rows are looked at in growing windows, as the next end may be near or far."""
        at, size, out = 0, 16, []
        while at < len(z):
            window = z[at : at + size]
            far = np.flatnonzero(np.sqrt(((window - self.z) ** 2).sum(1)) > eps)
            if not len(far):
                self.total = self.total + a[at : at + size].sum(0)
                self.count += len(window)
                at, size = at + size, min(2 * size, 1 << 14)
                continue
            k = at + int(far[0])
            mean = (self.total + a[at:k].sum(0)) / (self.count + k - at)
            out.append((self.step, int(step[k]), self.z, mean, z[k] - self.z))
            self.z, self.step, self.total, self.count = z[k], int(step[k]), a[k].copy(), 1
            at, size = k + 1, 16
        return out


def walk(steps: DataFrame, states: Sequence[str], actions: Sequence[str], eps: float, partitions: int | None = None) -> DataFrame:
    """(ep, start, end, z, a, d): the transitions of all episodes: anchor and end,
    the anchor's state, the mean of the actions from the anchor up to the end, and the state's change.

    ``steps`` count from 0 in each episode without gaps.  What is over when an
    episode ends is no transition.  Rounds of jobs follow as many partitions
    as the longest episode reaches into; each reads only the partitions that wait.
    """
    spark = steps.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    k, m = len(states), len(actions)
    cols = [F.array(*[F.col(c).cast("double") for c in cs]).alias(name) for cs, name in ((states, "z"), (actions, "a"))]
    # written down, as a range partitioning that is made anew may cut elsewhere
    ranged = steps.select(F.col("ep").cast("long"), F.col("step").cast("long"), *cols).repartitionByRange(n, "ep", "step").sortWithinPartitions("ep", "step")
    ranged = cut_lineage(ranged.withColumn("part", F.spark_partition_id().cast("long")))
    # the episode that goes on in a partition, if its first step isn't the episode's
    heads = ranged.groupBy("part").agg(F.min(F.struct("ep", "step")).alias("first"))
    first = {r.part: r.first for r in heads.collect()}  # a row a partition
    order = sorted(first)
    before = dict(zip(order[1:], order))
    waiting = {p: first[p].ep for p in order if first[p].step > 0}
    schema = TRANSITIONS + ", part long, anchor long, total array<double>, count long"

    def run(carries: dict[int, Walk] | None):
        """``carries`` None: the episodes that begin in a partition; else the heads of the partitions named."""

        def carry(now: tuple[int, int], w: Walk) -> tuple:
            return now[0], None, None, w.z.tolist(), None, None, now[1], w.step, w.total.tolist(), w.count

        def work(batches):
            now, open_ = None, None
            rows: list[tuple] = []

            def batch():
                cols = list(zip(*rows)) if rows else [[]] * 10
                made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.list_(pa.float64())] * 3 + [pa.int64()] * 2 + [pa.list_(pa.float64()), pa.int64()])], names=[f.split()[0] for f in schema.split(", ")])
                rows.clear()
                return made

            for b in batches:
                if not b.num_rows:
                    continue
                ep, step, own = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(4).to_numpy()
                z = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                a = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
                cuts = [0, *(np.flatnonzero((np.diff(ep) != 0) | (np.diff(own) != 0)) + 1).tolist(), len(ep)]
                for s, e in zip(cuts, cuts[1:]):
                    begin = s
                    if (ep[s], own[s]) != now:
                        if open_ is not None and own[s] != now[1]:
                            rows.append(carry(now, open_))
                        now, open_ = (int(ep[s]), int(own[s])), None
                        if carries is not None:
                            open_ = carries[now[1]]
                        elif step[s] == 0:
                            open_, begin = Walk(z[s], 0, a[s].copy(), 1), s + 1
                    if open_ is None:
                        continue
                    for start, end, anchor, mean, change in open_.over(step[begin:e], z[begin:e], a[begin:e], eps):
                        rows.append((now[0], start, end, anchor.tolist(), mean.tolist(), change.tolist(), now[1], None, None, None))
                    if len(rows) >= 5000:
                        yield batch()
            if open_ is not None:
                rows.append(carry(now, open_))
            yield batch()

        return work

    def carried(df: DataFrame) -> dict[tuple[int, int], Walk]:
        return {(r.part, r.ep): Walk(np.array(r.z), r.anchor, np.array(r.total), r["count"]) for r in df.where("end is null").collect()}  # a row a partition

    made = cut_lineage(ranged.select("ep", "step", "z", "a", "part").mapInArrow(run(None), schema))
    out, known = made.where("end is not null"), carried(made)
    while waiting:
        ready = {p: known[before[p], ep] for p, ep in waiting.items() if (before[p], ep) in known}
        head = F.create_map(*[F.lit(x) for p in ready for x in (p, waiting[p])])
        made = cut_lineage(ranged.where(F.col("part").isin(list(ready)) & (head[F.col("part")] == F.col("ep"))).select("ep", "step", "z", "a", "part").mapInArrow(run(ready), schema))
        out, known = out.unionByName(made.where("end is not null")), carried(made)
        for p in ready:
            del waiting[p]
    return out.select("ep", "start", "end", "z", "a", "d")


def single_steps(steps: DataFrame, states: Sequence[str], actions: Sequence[str]) -> DataFrame:
    """Every step and the next one, as transitions."""
    later = {f"_n{i}": F.lead(c).over(in_order()) for i, c in enumerate(states)}
    d = steps.withColumns(later).where("_n0 is not null")
    change = F.array(*[(F.col(f"_n{i}") - F.col(c)).cast("double") for i, c in enumerate(states)])
    arrays = [F.array(*[F.col(c).cast("double") for c in cs]).alias(n) for n, cs in (("z", states), ("a", actions))]
    return d.select("ep", F.col("step").alias("start"), (F.col("step") + 1).alias("end"), *arrays, change.alias("d"))


def _explained(m: np.ndarray, inputs: list[int], one: int, targets: list[int], ridge: float) -> tuple[np.ndarray, float]:
    """Ridge weights of the inputs and a one for the targets, and the share of the variance that they explain, from the moments."""
    x = [*inputs, one]
    w = np.linalg.solve(m[np.ix_(x, x)] + ridge * np.eye(len(x)), m[np.ix_(x, targets)])
    left = np.trace(m[np.ix_(targets, targets)]) - 2 * np.sum(w * m[np.ix_(x, targets)]) + np.sum(w * (m[np.ix_(x, x)] @ w))
    total = np.trace(m[np.ix_(targets, targets)]) - np.sum(m[one, targets] ** 2) / m[one, one]
    return w, float(1.0 - left / total) if total > 1e-15 else 1.0 if abs(left) <= 1e-15 else 0.0


def dynamics(steps: DataFrame, transitions: DataFrame, states: Sequence[str], actions: Sequence[str]) -> DataFrame:
    """One row: n_transitions, state_entropy, state_redundancy, transition_entropy,
    transition_redundancy, predictability, controllability, n_outliers and outlier_fraction.

    Entropies are of the first two principal components on a grid, redundancies
    of voxels in the first three; predictability is how much of the changes a ridge model of state and
    action explains, controllability one of the actions alone; outliers lie 3.5 median
    deviations above the median residual.  Two or more states are needed.
    """
    k, m = len(states), len(actions)
    if k < 2:
        raise ValueError("principal components need two or more states")
    zs, acts, ds = [f"z{i}" for i in range(k)], [f"a{i}" for i in range(m)], [f"d{i}" for i in range(k)]
    t = cut_lineage(transitions.select("ep", *[F.col(n[0])[int(n[1:])].alias(n) for n in (*zs, *acts, *ds)]))
    u = [*[F.col(c) for c in (*zs, *acts)], F.lit(1.0), *[F.col(c) for c in ds]]
    flat = t.agg(F.array(*[F.coalesce(F.sum(a * b), F.lit(0.0)) for i, a in enumerate(u) for b in u[i:]]).alias("m")).first().m  # one row
    sums, one = matrix(flat), k + m
    targets = list(range(one + 1, one + 1 + k))
    w, predictability = _explained(sums, list(range(one)), one, targets, RIDGE)
    _, controllability = _explained(sums, list(range(k, one)), one, targets, RIDGE)
    residual = F.sqrt(sum(((F.col(d) - sum((x * float(w[i, j]) for i, x in enumerate(u[: one + 1])), F.lit(0.0))) ** 2 for j, d in enumerate(ds)), F.lit(0.0)))
    r = t.select(residual.alias("r"))
    mid = (exact_quantiles(r, "r", [0.5]) or [0.0])[0]
    mad = max((exact_quantiles(r.select(F.abs(F.col("r") - mid).alias("x")), "x", [0.5]) or [0.0])[0], 1e-6)
    out = r.agg(F.count("*").alias("n_transitions"), F.coalesce(F.sum((F.col("r") > mid + OUTLIER * mad).cast("long")), F.lit(0)).alias("n_outliers"))
    all_states = cut_lineage(steps.select("ep", *[F.col(c).cast("double").alias(n) for c, n in zip(states, zs)]))

    def plane(df: DataFrame, cols: list[str]) -> DataFrame:
        return surprise.entropy_2d(surprise.project(df, cols, 2), "p0", "p1")

    def voxels(df: DataFrame, cols: list[str]) -> DataFrame:
        few = min(3, len(cols))
        return surprise.voxel_redundancy(surprise.project(df, cols, few), [f"p{i}" for i in range(few)], VOXEL)

    parts = {
        "state_entropy": plane(all_states, zs), "state_redundancy": voxels(all_states, zs),
        "transition_entropy": plane(t, ds), "transition_redundancy": voxels(t, [*zs, *acts, *ds]),
    }
    for name, df in parts.items():
        out = out.crossJoin(df.toDF(name))  # one row each
    return out.select("n_transitions", *parts, F.lit(predictability).alias("predictability"), F.lit(controllability).alias("controllability"), "n_outliers", (F.col("n_outliers") / F.col("n_transitions")).alias("outlier_fraction"))


def dynamics_flags(figures: DataFrame) -> DataFrame:
    """(metric, value, level) of ``dynamics``."""
    rule = {
        "latent_state_entropy": ("state_entropy", F.col("state_entropy") < 2.5), "transition_redundancy": ("transition_redundancy", F.col("transition_redundancy") > 0.8),
        "dynamics_predictability_r2": ("predictability", F.col("predictability") < 0.2), "outlier_transition_fraction": ("outlier_fraction", F.col("outlier_fraction") > 0.05),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value"), F.when(bad, "WARNING").otherwise("OK").alias("level")) for n, (c, bad) in rule.items()])
    return figures.select(F.explode(rows).alias("r")).select("r.*")
