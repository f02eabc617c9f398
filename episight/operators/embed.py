"""Fixed-length embeddings of episodes by a random projection, and what their
geometry says: outliers, novelty, sparsity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import nearest

#: Share of outliers and mean distance to the nearest from which there is a warning, and the robust deviations of an outlier.
OUTLIER_SHARE, SPARSE, DEVIATIONS = 0.05, 0.6, 3.0


def projection(n_features: int, size: int) -> np.ndarray:
    """The directions for so many features, the same wherever they are made."""
    return np.random.default_rng(42 + n_features).normal(size=(n_features, size))


def projected(steps: DataFrame, features: tuple[str, ...], size: int = 64) -> DataFrame:
    """(ep, embedding): mean plus deviation over the steps of each of ``size``
    projections, scaled to length one.

    Both follow from the sums and products of the features, so an episode is a
    few sums that are added up before the shuffle, whatever its length.
    """
    import pyarrow as pa

    cols = [F.col(c).cast("double") for c in features]
    sums = [F.sum(c) for c in cols] + [F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]]
    g = steps.groupBy("ep").agg(F.count("*").cast("double").alias("n"), F.array(*sums).alias("m"))
    k = len(features)
    upper = np.triu_indices(k)

    def run(batches):
        p = projection(k, size)
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(1).to_numpy()[:, None]
            m = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            mean = m[:, :k] / n
            second = np.zeros((len(m), k, k))
            second[:, upper[0], upper[1]] = second[:, upper[1], upper[0]] = m[:, k:] / n
            cov = second - mean[:, :, None] * mean[:, None, :]
            e = mean @ p + np.sqrt(np.maximum(0.0, np.einsum("is,nij,js->ns", p, cov, p)))
            length = np.linalg.norm(e, axis=1, keepdims=True)
            e = np.where(length > 1e-8, e / np.maximum(length, 1e-300), e)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(e) + 1, dtype=np.int32) * size), pa.array(e.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["ep", "embedding"])

    return g.mapInArrow(run, "ep long, embedding array<double>")


def spread_out(embedded: DataFrame, size: int) -> tuple[DataFrame, list[str]]:
    """(ep, e0, e1, ...) and the names."""
    names = [f"e{i}" for i in range(size)]
    return embedded.select("ep", *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)]), names


def novelty(embedded: DataFrame, size: int = 64) -> DataFrame:
    """(ep, neighbour, distance): the episode that is nearest by cosine, and one
    less the cosine.  For vectors of length one the nearest by angle is the nearest in space."""
    d, names = spread_out(embedded, size)
    near = nearest(d, d, names, exclude_self=True)
    return near.select("ep", "neighbour", F.least(F.col("distance") ** 2 * (size / 2.0), F.lit(2.0)).alias("distance"))


def centroid_outliers(embedded: DataFrame) -> DataFrame:
    """(ep, distance, outlier): one less the cosine to the mean embedding, and
    whether that is more than three robust deviations over its median."""
    from ..functions.exprs import median

    mean = embedded.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).orderBy("i").collect()  # a row a component
    if not mean:
        return embedded.select("ep", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("outlier"))
    m = np.array([r.x for r in mean])
    m = m / np.linalg.norm(m) if np.linalg.norm(m) > 1e-8 else m
    dot = sum((F.col("embedding")[i] * float(x) for i, x in enumerate(m)), F.lit(0.0))
    d = embedded.select("ep", (1.0 - dot).alias("distance"))
    mid = d.agg(median("distance").alias("mid"))
    d = d.crossJoin(F.broadcast(mid))  # one row
    mad = d.agg(F.greatest(median(F.abs(F.col("distance") - F.col("mid"))), F.lit(1e-6)).alias("mad"))
    return d.crossJoin(F.broadcast(mad)).select("ep", "distance", (F.col("distance") > F.col("mid") + DEVIATIONS * 1.4826 * F.col("mad")).alias("outlier"))  # one row


def flags(outliers: DataFrame, near: DataFrame) -> DataFrame:
    """(metric, value, level): share of outliers and mean distance to the nearest."""
    a = outliers.agg(F.avg(F.col("outlier").cast("double")).alias("value")).select(F.lit("ssl_trajectory_outliers").alias("metric"), "value", F.when(F.col("value") > OUTLIER_SHARE, "WARNING").otherwise("OK").alias("level"))
    b = near.agg(F.avg("distance").alias("value")).select(F.lit("ssl_dataset_sparsity").alias("metric"), "value", F.when(F.col("value") > SPARSE, "WARNING").otherwise("OK").alias("level"))
    return a.unionByName(b)


def mean_nearest(points: DataFrame, cols: list[str], key: str = "ep", most: int = 2000, seed: int = 42) -> DataFrame:
    """One row: distance, the mean over at most ``most`` sampled points (the figure's
    definition) of the distance to the nearest other of them; 0 for fewer than two."""
    from .surprise import hashed_sample

    d = hashed_sample(points, key, most, seed).select(F.col(key).alias("ep"), *cols)
    return nearest(d, d, cols, exclude_self=True).agg(F.coalesce(F.avg("distance") * float(np.sqrt(len(cols))), F.lit(0.0)).alias("distance"))


# --- latent vectors of episodes -----------------------------------------------


def proprio_latents(steps: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """(ep, latent): means, then deviations of the states of each episode."""
    return steps.groupBy("ep").agg(F.array(*[F.avg(c) for c in states], *[F.stddev_pop(c) for c in states]).alias("latent"))


def visual_latents(frames: DataFrame, channels: int = 1) -> DataFrame:
    """(ep, latent) of (ep, step, pixels: array<double>, channels interleaved): for
    each channel the mean over frames of a frame's mean, then of its deviation, then the deviation of that."""
    own = lambda c: F.filter("pixels", lambda _, i: i % channels == c) if channels > 1 else F.col("pixels")
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / F.size(x)
    d = frames.select("ep", *[own(c).alias(f"c{c}") for c in range(channels)])
    d = d.select("ep", *[mean(F.col(f"c{c}")).alias(f"m{c}") for c in range(channels)], *[F.sqrt(F.greatest(F.lit(0.0), mean(F.transform(f"c{c}", lambda y: y * y)) - mean(F.col(f"c{c}")) ** 2)).alias(f"s{c}") for c in range(channels)])
    parts = [*[F.avg(f"m{c}") for c in range(channels)], *[F.avg(f"s{c}") for c in range(channels)], *[F.stddev_pop(f"s{c}") for c in range(channels)]]
    return d.groupBy("ep").agg(F.array(*parts).alias("latent"))


def singular_directions(vectors: DataFrame, column: str, k: int, extra: int = 8, rounds: int = 4, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean, the first ``k`` singular values of the centred vectors and their
    directions (rows), by randomised subspace iteration.

    Each round is one pass: a task multiplies its block of rows with the current
    directions and back, and the blocks' products, of the vectors' width times k + extra, are summed.  So
    wide vectors never make a square matrix of their width.
    """
    import pyarrow as pa

    size = vectors.select(F.size(column).alias("d")).first().d
    width = min(size, k + extra)

    def summed(work, n: int) -> np.ndarray:
        def run(batches):
            total = np.zeros(n)
            for b in batches:
                if b.num_rows:
                    total += work(b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], names=["i", "x"])

        got = vectors.select(column).mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(n)
        for r in got:
            out[r.i] = r.x
        return out

    first = summed(lambda x: np.append(x.sum(0), len(x)), size + 1)
    mean = first[:size] / max(first[size], 1.0)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(summed(lambda x, q=q: ((x - mean).T @ ((x - mean) @ q)).ravel(), size * width).reshape(size, width))[0]
    small = summed(lambda x: (((x - mean) @ q).T @ ((x - mean) @ q)).ravel(), width * width).reshape(width, width)
    values, turn = np.linalg.eigh(small)
    order = np.argsort(-values)[:k]
    directions = (q @ turn[:, order]).T
    directions *= np.sign(directions[np.arange(len(directions)), np.abs(directions).argmax(1)])[:, None]
    return mean, np.sqrt(np.maximum(values[order], 0)), directions


def reduced(vectors: DataFrame, column: str, k: int, key: str = "ep") -> DataFrame:
    """(key, component, value): the vectors on their first ``k`` singular directions."""
    mean, _, directions = singular_directions(vectors, column, k)
    dot = lambda row: sum(((F.col(column)[i].cast("double") - float(m)) * float(x) for i, (m, x) in enumerate(zip(mean, row))), F.lit(0.0))
    return vectors.select(key, F.posexplode(F.array(*[dot(r) for r in directions])).alias("component", "value"))
