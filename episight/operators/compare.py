"""Two datasets side by side, and leakage between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.episodes import dimensions


def binned_shares(a: DataFrame, b: DataFrame, dims: tuple[str, ...], bins: int) -> DataFrame:
    """(dim, bin, na, nb): counts of both in bins over their common range."""
    both = dimensions(a, dims).withColumn("side", F.lit("a")).unionByName(dimensions(b, dims).withColumn("side", F.lit("b")))
    span = both.groupBy("dim").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    d = both.join(F.broadcast(span), "dim")  # a row a dimension
    place = F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))
    d = d.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(place, F.lit(bins - 1))).otherwise(F.lit(0)))
    return d.groupBy("dim", "bin").agg(F.sum((F.col("side") == "a").cast("long")).alias("na"), F.sum((F.col("side") == "b").cast("long")).alias("nb"))


def kl_marginals(a: DataFrame, b: DataFrame, dims: tuple[str, ...], bins: int = 50, eps: float = 1e-10) -> DataFrame:
    """(dim, kl): divergence of a's histogram from b's; empty bins of either
    count as ``eps`` (bins empty in both add nothing)."""
    c = binned_shares(a, b, dims, bins)
    total = c.groupBy("dim").agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    d = c.join(F.broadcast(total), "dim")
    p, q = F.col("na") / F.col("ta") + eps, F.col("nb") / F.col("tb") + eps
    return d.groupBy("dim").agg(F.sum(p * F.log(p / q)).alias("kl"))


def coverage_overlap(a: DataFrame, b: DataFrame, dims: tuple[str, ...], bins: int = 20) -> DataFrame:
    """(dim, overlap): share of b's occupied bins that a occupies too."""
    return binned_shares(a, b, dims, bins).where("nb > 0").groupBy("dim").agg(F.avg((F.col("na") > 0).cast("double")).alias("overlap"))


def range_overlap(a: DataFrame, b: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(dim, overlap): length of the common range over that of the joint one; 1 if both are one point."""
    r = lambda df, n: dimensions(df, dims).groupBy("dim").agg(F.min("value").alias(f"lo{n}"), F.max("value").alias(f"hi{n}"))
    d = r(a, "a").join(r(b, "b"), "dim")
    common = F.greatest(F.least("hia", "hib") - F.greatest("loa", "lob"), F.lit(0.0))
    joint = F.greatest("hia", "hib") - F.least("loa", "lob")
    return d.select("dim", F.when(joint > 0, common / joint).otherwise(F.lit(1.0)).alias("overlap"))


def exact_leakage(train: DataFrame, held: DataFrame, train_id: str, held_id: str, text: str = "text") -> DataFrame:
    """(held_id, train_id): held-out rows whose content is in the training
    data, with the first training row that has it."""
    first = train.groupBy(F.sha2(text, 256).alias("digest")).agg(F.min(train_id).alias(train_id))
    return held.select(held_id, F.sha2(text, 256).alias("digest")).join(first, "digest").select(held_id, train_id)


def duplicates(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, original): rows whose content an earlier row has, with the first
    such row.  The first keys are aggregated and joined back, so a group of
    any size spreads over tasks before it is reduced."""
    d = rows.select(key, F.sha2(text, 256).alias("digest"))
    first = d.groupBy("digest").agg(F.min(key).alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    return d.join(first, "digest").where(F.col(key) != F.col("original")).select(key, "original")


def resampled(steps: DataFrame, column: str = "a0", points: int = 32) -> DataFrame:
    """(ep, i, value): the column at ``points`` evenly spaced places of the
    episode, linear between steps."""
    from ..functions.exprs import in_order, whole

    d = steps.withColumns({"n": F.count("*").over(whole()), "next": F.lead(column).over(in_order())})
    at = F.col("i") * (F.col("n") - 1) / (points - 1)
    lo, hi = F.ceil(F.col("step") * (points - 1) / F.greatest(F.col("n") - 1, F.lit(1))), F.ceil((F.col("step") + 1) * (points - 1) / F.greatest(F.col("n") - 1, F.lit(1))) - 1
    last = F.col("step") == F.col("n") - 1
    # a step answers for the places from itself up to the next step; the last one for the last place alone
    first, until = F.when(F.col("n") == 1, 0).when(last, points - 1).otherwise(lo), F.when(last, points - 1).otherwise(F.least(hi, F.lit(points - 2)))
    d = d.withColumns({"first": first.cast("int"), "until": until.cast("int")}).where("first <= until")
    d = d.withColumn("i", F.explode(F.sequence("first", "until")))
    frac = at - F.col("step")
    return d.select("ep", "i", F.when(F.col("next").isNull() | (F.col("n") == 1), F.col(column)).otherwise(F.col(column) + (F.col("next") - F.col(column)) * frac).alias("value"))


def transfer_level(overlap: DataFrame) -> DataFrame:
    """One row: the worst dimension's overlap and its level."""
    g = overlap.agg(F.min("overlap").alias("overlap"))
    return g.withColumn("level", F.when(F.col("overlap") >= 0.8, "COMPATIBLE").when(F.col("overlap") >= 0.5, "ADAPT").otherwise("INCOMPATIBLE"))
