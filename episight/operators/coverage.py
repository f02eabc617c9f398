"""Entropy, lengths and other coverage of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import in_order
from ..sources.episodes import dimensions


def histogram_entropy(values: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """(keys, bits): entropy of (keys, value) in equal bins over each key's own
    range; a constant has none."""
    span = Window.partitionBy(*keys)
    d = values.withColumns({"lo": F.min("value").over(span), "hi": F.max("value").over(span)})
    place = F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))
    d = d.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(place, F.lit(bins - 1))).otherwise(F.lit(0)))
    n = d.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(span)
    return n.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p")) + F.lit(0.0)).alias("bits"))


def trajectory_entropy(steps: DataFrame, dims: tuple[str, ...], bins: int = 20) -> DataFrame:
    """(ep, entropy): mean over dimensions of the episode's histogram entropy."""
    return histogram_entropy(dimensions(steps, dims), ["ep", "dim"], bins).groupBy("ep").agg(F.avg("bits").alias("entropy"))


def action_entropy(steps: DataFrame, dims: tuple[str, ...], bins: int = 50) -> DataFrame:
    """(dim, bits) over all episodes.  The range of each dimension is
    aggregated first, so that no task holds a dimension's values."""
    wide = dimensions(steps, dims)
    span = wide.groupBy("dim").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    d = wide.join(F.broadcast(span), "dim")  # a row a dimension
    place = F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))
    n = d.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(place, F.lit(bins - 1))).otherwise(F.lit(0))).groupBy("dim", "bin").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("dim"))
    return n.withColumn("p", p).groupBy("dim").agg((-F.sum(F.col("p") * F.log2("p")) + F.lit(0.0)).alias("bits"))


def direction_entropy(steps: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(ep, bits): entropy of the signs of the steps' changes."""
    signs = [F.signum(F.col(c) - F.lag(c).over(in_order())).cast("int").cast("string") for c in dims]
    d = steps.withColumn("signs", F.concat_ws(",", *signs)).where("step > 0")
    n = d.groupBy("ep", "signs").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("ep"))
    return n.withColumn("p", p).groupBy("ep").agg((-F.sum(F.col("p") * F.log2("p")) + F.lit(0.0)).alias("bits"))


def length_stats(lengths: DataFrame) -> DataFrame:
    """One row: n_episodes, mean, std, cv and whether lengths look bimodal
    (at least 6 of them, cv at least 0.3, under 15 % within half a deviation)."""
    s = lengths.agg(F.count("*").alias("n_episodes"), F.avg("n_steps").alias("mean"), F.stddev_pop("n_steps").alias("std"))
    near = lengths.crossJoin(F.broadcast(s)).agg(F.avg((F.abs(F.col("n_steps") - F.col("mean")) < 0.5 * F.col("std")).cast("double")).alias("near"))  # one row
    one = s.crossJoin(near).withColumn("cv", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(F.lit(0.0)))
    return one.withColumn("bimodal", (F.col("n_episodes") >= 6) & (F.col("cv") >= 0.3) & (F.col("near") < 0.15))


def short_episodes(lengths: DataFrame) -> DataFrame:
    """One row: q1, q3, fence (q1 - 1.5 * max(iqr, a quarter of the median)), n_short and their share."""
    q = lengths.agg(F.percentile("n_steps", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), (F.col("q")[0] - 1.5 * F.greatest(F.col("q")[2] - F.col("q")[0], 0.25 * F.col("q")[1])).alias("fence"))
    hit = (F.col("n_steps") < F.col("fence")).cast("long")
    d = lengths.crossJoin(F.broadcast(q))  # one row
    return d.groupBy("q1", "q3", "fence").agg(F.sum(hit).alias("n_short"), F.avg(hit.cast("double")).alias("short_fraction"))


def pca_share(steps: DataFrame, dims: tuple[str, ...], k: int = 2) -> DataFrame:
    """One row: the share of variance in the first ``k`` principal components
    (null below 3 dimensions).  Covariances are aggregated; a matrix of the
    dimensions is solved on the driver."""
    import numpy as np

    pairs = [(a, b) for a in dims for b in dims]
    row = steps.agg(*[F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    share = None
    if len(dims) >= 3 and row is not None and all(x is not None for x in row):
        values = np.sort(np.linalg.eigvalsh(np.array(list(row), float).reshape(len(dims), -1)))[::-1]
        share = float(values[:k].sum() / values.sum()) if values.sum() > 0 else None
    return steps.sparkSession.createDataFrame([(share,)], "top_share double")


def episode_features(steps: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(ep, m_*, d_*): mean and deviation of each dimension."""
    return steps.groupBy("ep").agg(*[F.avg(c).alias(f"m_{c}") for c in dims], *[F.stddev_pop(c).alias(f"d_{c}") for c in dims])


def scaled(features: DataFrame, cols: list[str], constant: float = 0.0) -> DataFrame:
    """Columns scaled to 0..1 over all rows; their ranges are one aggregated row."""
    span = features.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    d = features.crossJoin(F.broadcast(span))  # one row
    x = {c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).when(F.col(c).isNotNull(), F.lit(constant)) for c in cols}
    return d.withColumns(x).select(*features.columns)
