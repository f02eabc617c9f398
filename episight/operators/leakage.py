"""Held-out episodes that training episodes are nearly equal to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from .compare import resampled
from .neighbours import nearest
from .order import counted_below, exact_quantiles

#: Near means within this share of the median distance between training episodes; suspicious, below this quantile of them.
NEAR, QUANTILE, ALPHA = 0.01, 0.01, 0.01


def holdout(spark: SparkSession, spec: str) -> DataFrame:
    """(lo, hi): the half-open ranges and single ids of a text such as "0:50,80,90:95"."""
    rows = []
    for part in filter(None, map(str.strip, spec.split(","))):
        lo, _, hi = part.partition(":")
        rows.append((int(lo), int(hi) if hi else int(lo) + 1))
    return spark.createDataFrame(rows, "lo long, hi long")


def held(steps: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ep): the episodes of ``steps`` that the ranges, a short list, hold."""
    eps = steps.select("ep").distinct()
    return eps.join(F.broadcast(ranges), (F.col("ep") >= F.col("lo")) & (F.col("ep") < F.col("hi")), "left_semi")


def digests(steps: DataFrame, streams: tuple[str, ...]) -> DataFrame:
    """(ep, digest) of the streams in order of steps."""
    row = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in streams])
    return steps.groupBy("ep").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", row.alias("r")))), lambda x: x["r"]), ";"), 256).alias("digest"))


def fingerprints(steps: DataFrame, streams: tuple[str, ...], points: int = 32) -> DataFrame:
    """(ep, x0, x1, ...): every stream at ``points`` places of the episode."""
    out = None
    for k, c in enumerate(streams):
        part = resampled(steps, c, points).groupBy("ep").agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"x{k * points + i}") for i in range(points)])
        out = part if out is None else out.join(part, "ep")
    return out


def near_leakage(steps: DataFrame, held_out: DataFrame, streams: tuple[str, ...], points: int = 32) -> tuple[DataFrame, DataFrame]:
    """(pairs, summary).

    pairs (held, train, kind, distance, percentile): held-out episodes with an
    exact copy in training, and those whose nearest distinct training episode is
    near-identical or suspiciously close, in units of the training streams' deviations.
    summary, one row: n_train, n_held, n_exact, n_near, n_suspicious, median_distance,
    p_value (of so many suspicious ones by chance) and status.
    """
    fp = cut_lineage(fingerprints(steps, streams, points).join(digests(steps, streams), "ep"))
    own = held_out.select("ep").distinct().withColumn("h", F.lit(True))
    fp = fp.join(own, "ep", "left").withColumn("h", F.coalesce("h", F.lit(False)))
    train, out = fp.where("not h"), fp.where("h")
    first = train.groupBy("digest").agg(F.min("ep").alias("train"))
    exact = out.join(first, "digest").select(F.col("ep").alias("held"), "train")
    cols = [f"x{i}" for i in range(len(streams) * points)]

    def moments(k: int) -> list:
        own_cols = cols[k * points : (k + 1) * points]
        total = lambda f: F.sum(sum((f(F.col(c)) for c in own_cols), F.lit(0.0)))
        return [total(lambda x: x).alias(f"s{k}"), total(lambda x: x * x).alias(f"q{k}")]

    one = train.agg(F.count("*").alias("n"), *[m for k in range(len(streams)) for m in moments(k)])
    scaled = fp.crossJoin(F.broadcast(one))  # one row
    x = {}
    for k in range(len(streams)):
        mean = F.col(f"s{k}") / (F.col("n") * points)
        dev = F.sqrt(F.greatest(F.col(f"q{k}") / (F.col("n") * points) - mean * mean, F.lit(0.0)))
        for c in cols[k * points : (k + 1) * points]:
            x[c] = (F.col(c) - mean) / F.when(dev == 0, 1.0).otherwise(dev)
    scaled = cut_lineage(scaled.withColumns(x).select("ep", "h", "digest", *cols))
    base = scaled.where("not h").join(first.select(F.col("train").alias("ep")), "ep", "left_semi")
    tt = cut_lineage(nearest(base, base, cols, exclude_self=True).select("ep", F.col("distance").alias("tt")))
    vt = nearest(scaled.where("h"), base, cols).select(F.col("ep").alias("held"), F.col("neighbour").alias("train"), "distance")
    mid, low = exact_quantiles(tt, "tt", [0.5, QUANTILE]) or (None, None)
    known = lambda x: F.lit(x).cast("double")
    cuts = tt.agg(F.count("*").alias("n_tt")).select(known(mid).alias("mid"), known(low).alias("low"), "n_tt")
    rest = vt.join(exact.select("held"), "held", "left_anti").crossJoin(F.broadcast(cuts))  # one row
    kind = F.when(F.col("distance") <= NEAR * F.col("mid"), "near_identical").when(F.col("distance") < F.col("low"), "suspicious")
    close = cut_lineage(rest.withColumn("kind", kind).where("kind is not null"))
    below = counted_below(tt, close.select("held", F.col("distance").alias("tt")), "tt", "held")
    close = close.join(below, "held", "left").select("held", "train", "kind", "distance", (F.coalesce("below", F.lit(0)) / F.col("n_tt")).alias("percentile"))
    none = F.lit(None).cast("double")
    pairs = exact.select("held", "train", F.lit("exact").alias("kind"), none.alias("distance"), none.alias("percentile")).unionByName(close)
    count = lambda k: F.coalesce(F.sum((F.col("kind") == k).cast("long")), F.lit(0))
    g = pairs.agg(count("exact").alias("n_exact"), count("near_identical").alias("n_near"), count("suspicious").alias("n_suspicious"))
    g = g.crossJoin(fp.agg(F.sum((~F.col("h")).cast("long")).alias("n_train"), F.sum(F.col("h").cast("long")).alias("n_held"))).crossJoin(cuts.select(F.col("mid").alias("median_distance")))  # one row each
    g = g.withColumn("p_value", binomial_tail(F.col("n_held") - F.col("n_exact"), F.col("n_suspicious"), QUANTILE))
    status = F.when(F.col("n_exact") + F.col("n_near") > 0, "critical").when(F.col("p_value") < ALPHA, "warning").otherwise("ok")
    return pairs, g.select("n_train", "n_held", "n_exact", "n_near", "n_suspicious", "median_distance", "p_value", status.alias("status"))


def binomial_tail(n, k, p: float):
    """The chance of ``k`` or more of ``n``, as a column: one less the terms below k, each from the one before."""
    import math

    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("log"), F.lit(0.0).alias("sum"))

    def step(a, i):
        return F.struct((a["log"] + F.log((n - i) / (i + 1.0)) + odds).alias("log"), (a["sum"] + F.exp(a["log"])).alias("sum"))

    below = F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(k - 1, F.lit(0))), start, step)["sum"]
    return F.when(k <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - below))
