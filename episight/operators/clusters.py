"""Clusters of episodes, and which of them have too few."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from .surprise import project


def nearest_centre(cols: list[str], centres: np.ndarray) -> Column:
    """A struct of gap (squared distance) and cluster (the nearest centre, the first of equals).  The centres, a few, are literals."""
    return F.array_min(F.array(*[F.struct(sum(((F.col(c) - float(x)) ** 2 for c, x in zip(cols, centre)), F.lit(0.0)).alias("gap"), F.lit(i).alias("cluster")) for i, centre in enumerate(centres)]))


def assigned(rows: DataFrame, cols: list[str], centres: np.ndarray) -> DataFrame:
    """``rows`` with cluster and gap of the nearest centre."""
    return rows.withColumn("_n", nearest_centre(cols, centres)).withColumns({"cluster": F.col("_n.cluster"), "gap": F.col("_n.gap")}).drop("_n")


def _moved(rows: DataFrame, cols: list[str], starts: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Where Lloyd's rounds take each of some first centres.  A round is one aggregate
    over ``rows`` for all that still move, a row a centre; each stops by itself."""
    centres, moving = list(starts), [i for i, s in enumerate(starts) if len(s)]
    for _ in range(rounds):
        if not moving:
            break
        own = F.array(*[F.struct(F.lit(i).alias("start"), nearest_centre(cols, centres[i])["cluster"].alias("cluster")) for i in moving])
        met = rows.select(*cols, F.explode(own).alias("_o")).groupBy("_o.start", "_o.cluster")
        new = {i: centres[i].copy() for i in moving}
        for r in met.agg(*[F.avg(c).alias(f"_{k}") for k, c in enumerate(cols)]).collect():
            new[r.start][r.cluster] = [r[f"_{k}"] for k in range(len(cols))]
        moving = [i for i in moving if not np.allclose(new[i], centres[i], rtol=0, atol=1e-12)]
        for i in new:
            centres[i] = new[i]
    return centres


def _first(rows: DataFrame, cols: list[str], k: int, seed: int, key: str) -> np.ndarray:
    """The rows with the smallest hashes of key and seed."""
    first = rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).select(*cols).limit(k).collect()
    return np.array([list(map(float, r)) for r in first]).reshape(-1, len(cols))


def k_means(rows: DataFrame, cols: list[str], k: int, seed: int = 42, rounds: int = 100, key: str = "ep") -> tuple[np.ndarray, DataFrame]:
    """(centres, rows with cluster and gap): Lloyd's rounds, each one aggregate
    of k rows, until the centres stand.  The first centres are the rows with the
    smallest hashes of key and seed; an empty cluster keeps its centre.  ``rows`` are
    read once a round and written down first, so that what is behind them is done once."""
    rows = cut_lineage(rows)
    centres = _moved(rows, cols, [_first(rows, cols, k, seed, key)], rounds)[0]
    return centres, assigned(rows, cols, centres) if len(centres) else rows.withColumns({"cluster": F.lit(None).cast("int"), "gap": F.lit(None).cast("double")})


def trajectory_diversity(features: DataFrame, cols: list[str], restarts: int = 5, seed: int = 42) -> DataFrame:
    """One row: n_modes, separation: how well two clusters part the episodes on
    their first two principal axes (1 less the within over the total squares, the
    best of some restarts); a mode has over a tenth of them.  1 and 0 below 4 episodes.
    The features are computed once and the restarts move together."""
    spark = features.sparkSession
    features = cut_lineage(features.select("ep", *cols))
    n = features.count()
    if n < 4:
        return spark.createDataFrame([(1, 0.0)], "n_modes int, separation double")
    axes = [f"p{i}" for i in range(min(2, len(cols)))]
    flat = cut_lineage(project(features, cols, len(axes)).select("ep", *axes))
    total = flat.agg(*[(F.var_pop(c) * F.count(c)).alias(c) for c in axes]).first()
    total = sum(total) or 0.0
    best = None
    for centres in _moved(flat, axes, [_first(flat, axes, 2, seed + r, "ep") for r in range(restarts)], 50):
        g = assigned(flat, axes, centres).groupBy("cluster").agg(F.count("*").alias("n"), F.sum("gap").alias("gap")).collect()  # two rows
        within = sum(x.gap for x in g)
        if best is None or within < best[0]:
            best = (within, sum(x.n > 0.10 * n for x in g))
    return spark.createDataFrame([(best[1], max(0.0, 1.0 - best[0] / total) if total > 0 else 0.0)], "n_modes int, separation double")


def entropy_gain(features: DataFrame, members: DataFrame, cols: list[str], n_add: int, bins: int = 20) -> float:
    """Expected gain in mean bits a column (over 0..1) if ``n_add`` episodes were
    spread evenly over the members' ranges; a column without width spans 0.05."""
    spans = members.agg(*[f(c) for c in cols for f in (F.min, F.max)]).first()
    if spans[0] is None:
        return 0.0
    cell = lambda c: F.least(F.greatest(F.floor(F.col(c) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    rows = features.select(F.explode(F.array(*[F.struct(F.lit(i).alias("d"), cell(c).alias("b")) for i, c in enumerate(cols)])).alias("x")).groupBy("x.d", "x.b").agg(F.count("*").alias("n")).collect()  # bins a column
    old = np.zeros((len(cols), bins))
    for d, b, n in rows:
        old[d, b] = n
    edges = np.linspace(0, 1, bins + 1)
    new = old.copy()
    for i in range(len(cols)):
        lo, hi = spans[2 * i], spans[2 * i + 1]
        hi = lo + 0.05 if hi == lo else hi
        new[i] += n_add * np.clip(np.minimum(edges[1:], hi) - np.maximum(edges[:-1], lo), 0, None) / (hi - lo)

    def bits(h: np.ndarray) -> float:
        p = h / np.maximum(h.sum(1, keepdims=True), 1e-12)
        return float(-(p * np.log2(p + 1e-12)).sum(1).mean())

    return max(0.0, bits(new) - bits(old))


def coverage_gaps(features: DataFrame, cols: list[str], n_clusters: int = 8, seed: int = 42) -> DataFrame:
    """(cluster, current, target, needed, coverage, gain): clusters with fewer
    episodes than an equal share, by what filling them would add.  The features are computed once."""
    spark, features = features.sparkSession, cut_lineage(features)
    n = features.count()
    schema = "cluster int, current long, target long, needed long, coverage double, gain double"
    k = min(n_clusters, n)
    if n < 2:
        return spark.createDataFrame([], schema)
    centres = _moved(features, cols, [_first(features, cols, k, seed, "ep")], 100)[0]
    got = assigned(features, cols, centres)
    counts = {r.cluster: r.n for r in got.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # k rows
    target = max(1, round(n / k))
    out = []
    for c in range(k):
        have = counts.get(c, 0)
        if have < target:
            out.append((c, have, target, target - have, round(have / target, 3), entropy_gain(features, got.where(F.col("cluster") == c), cols, target - have)))
    return spark.createDataFrame(sorted(out, key=lambda r: (-r[5], r[0])), schema)
