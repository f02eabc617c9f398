"""Scores and grades of a dataset, from one row of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ramp

#: Fixed values: (warning, critical) of the figures that have levels.
LEVELS = {
    "jitter_cv": (0.15, 0.30),
    "dropout": (0.01, 0.05),
    "spike_rate": (0.02, 0.05),
    "disc_rate": (0.02, 0.05),
    "action_dropout": (0.05, 0.15),
}

#: Penalty at warning and at critical, and those bounds; the figures after the first five are bad when small.
OUTCOME = {
    "spike_rate": (8.0, 20.0, 0.02, 0.05),
    "disc_rate": (8.0, 20.0, 0.02, 0.05),
    "dropout": (7.0, 18.0, 0.01, 0.05),
    "jitter_cv": (5.0, 12.0, 0.05, 0.20),
    "surprise": (8.0, 18.0, 0.40, 0.70),
    "ldlj": (10.0, 25.0, -10.0, -15.0),
    "entropy": (10.0, 20.0, 2.5, 1.5),
    "contact": (10.0, 20.0, 0.10, 0.05),
}

#: The same for instruction and response text.
SFT_OUTCOME = {
    "coherence": (15.0, 30.0, 0.15, 0.05),
    "repetition": (10.0, 20.0, 0.25, 0.40),
    "template": (8.0, 18.0, 0.10, 0.30),
    "words": (10.0, 20.0, 15.0, 5.0),
    "diversity": (12.0, 22.0, 0.15, 0.05),
}

DIMENSIONS = {"jitter_cv": "temporal", "dropout": "temporal", "action_dropout": "temporal", "spike_rate": "smoothness", "disc_rate": "smoothness"}


def flags(figures: DataFrame) -> DataFrame:
    """(metric, value, level) of one row of figures that have levels."""
    names = [c for c in figures.columns if c in LEVELS]
    rows = figures.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "metric", "value")
    level = F.lit("OK")
    for name, (warn, crit) in LEVELS.items():
        own = F.when(F.col("value") >= crit, "CRITICAL").when(F.col("value") >= warn, "WARNING").otherwise("OK")
        level = F.when(F.col("metric") == name, own).otherwise(level)
    return rows.where("value is not null").withColumn("level", level)


def composite_score(figures: DataFrame) -> DataFrame:
    """One row: temporal (of 25), smoothness (of 20), coverage (of 25), structure
    (of 15), gate, total (of 100) and category.

    Each figure takes points on a ramp between two bounds; coverage and
    structure count as far as the first two are intact.
    """
    c = F.col
    temporal = 25 - 8.5 * ramp(c("jitter_cv"), 0.05, 0.20) - 8.5 * ramp(c("dropout"), 0.01, 0.05) - 8.0 * ramp(c("action_dropout"), 0.05, 0.15)
    smooth = 20 - 10.0 * ramp(c("spike_rate"), 0.02, 0.05) - 10.0 * ramp(c("disc_rate"), 0.02, 0.05)
    e = c("entropy")
    entropy = F.when(e <= 1.5, 20.0).when(e <= 2.5, 20.0 * (2.5 - e)).when(e <= 4.0, 10.0 * (4.0 - e) / 1.5).otherwise(0.0)
    cover = 25 - F.coalesce(entropy, F.lit(0.0)) - 5.0 * ramp(c("length_cv"), 0.2, 0.5)
    structure = 15 - 10.0 * F.coalesce(F.greatest(1.0 - c("separation") / 0.4, F.lit(0.0)), F.lit(0.0)) - F.when(c("short_fraction") > 0.05, 5.0 * F.least(c("short_fraction") / 0.2, F.lit(1.0))).otherwise(0.0)
    d = figures.select(temporal.alias("temporal"), smooth.alias("smoothness"), F.greatest(cover, F.lit(0.0)).alias("coverage"), F.greatest(structure, F.lit(0.0)).alias("structure"))
    d = d.withColumn("gate", (c("temporal") / 25 + c("smoothness") / 20) / 2)
    d = d.withColumn("total", F.round((c("temporal") + c("smoothness") + (c("coverage") + c("structure")) * c("gate")) / 85 * 100, 1))
    category = F.when(c("total") >= 90, "Excellent").when(c("total") >= 75, "Good").when(c("total") >= 60, "Fair").when(c("total") >= 40, "Poor").otherwise("Critical")
    return d.withColumn("category", category)


def rubric(flagged: DataFrame) -> DataFrame:
    """(dimension, score, grade): mean over flags of 100, 90, 65 or 30 for OK, INFO, WARNING, CRITICAL."""
    points = F.when(F.col("level") == "CRITICAL", 30.0).when(F.col("level") == "WARNING", 65.0).when(F.col("level") == "INFO", 90.0).otherwise(100.0)
    dim = F.lit("coverage")
    for name, x in DIMENSIONS.items():
        dim = F.when(F.col("metric") == name, x).otherwise(dim)
    g = flagged.groupBy(dim.alias("dimension")).agg(F.avg(points).alias("score"))
    return g.withColumn("grade", grade(F.col("score")))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def integrity_score(flagged: DataFrame) -> DataFrame:
    """One row: score (mean of 1, 0.5, 0 for fine, warning, critical, in percent) and verdict."""
    credit = F.when(F.col("level") == "CRITICAL", 0.0).when(F.col("level") == "WARNING", 0.5).otherwise(1.0)
    g = flagged.agg((F.avg(credit) * 100).alias("score"))
    return g.withColumn("verdict", F.when(F.col("score") >= 90, "pass").when(F.col("score") >= 70, "review").otherwise("fail"))


def certification(flagged: DataFrame, scripted: bool = False) -> DataFrame:
    """One row: n_critical, n_warning, grade.  Spikes of scripted motion don't count."""
    own = flagged.where(F.col("metric") != "spike_rate") if scripted else flagged
    g = own.agg(F.sum((F.col("level") == "CRITICAL").cast("long")).alias("n_critical"), F.sum((F.col("level") == "WARNING").cast("long")).alias("n_warning"))
    return g.withColumn("grade", F.when(F.col("n_critical") > 0, "NOT CERTIFIED").when(F.col("n_warning") > 0, "PROVISIONALLY CERTIFIED").otherwise("CERTIFIED"))


def regime(figures: DataFrame) -> DataFrame:
    """One row: regime and noise_score, from spikes, discontinuities and dropout."""
    s, d, o = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("spike_rate", "disc_rate", "dropout"))
    noise = 0.50 * F.least(s / 0.090, F.lit(1.0)) + 0.35 * F.least(d / 0.130, F.lit(1.0)) + 0.15 * F.least(o / 0.05, F.lit(1.0))
    kind = F.when((s < 0.025) & (d < 0.040), "low_noise").when((s >= 0.090) | (d >= 0.130), "high_noise").otherwise("moderate_noise")
    return figures.select(kind.alias("regime"), F.round(noise, 4).alias("noise_score"))


def penalty(value: Column, at_warn: float, at_crit: float, warn: float, crit: float) -> Column:
    """0 before the warning bound, then from the first penalty to the second at the critical bound; null counts as fine."""
    sign = 1.0 if crit > warn else -1.0
    x = sign * (value - warn) / (sign * (crit - warn))
    return F.coalesce(F.when(x >= 1, at_crit).when(x >= 0, at_warn + (at_crit - at_warn) * x), F.lit(0.0))


def deducted(names: list[str], rules: dict[str, tuple[float, float, float, float]], scripted: bool = False) -> tuple[Column, Column]:
    """100 less the penalties (0 at least) of the figures that there are, and how many there are."""
    less = {k: 0.4 if scripted and k in ("ldlj", "spike_rate", "disc_rate") else 1.0 for k in rules}
    used = {k: penalty(F.col(k), less[k] * v[0], less[k] * v[1], *v[2:]) for k, v in rules.items() if k in names}
    total, hits = F.lit(100.0), F.lit(0)
    for p in used.values():
        total, hits = total - p, hits + (p > 0).cast("int")
    return F.greatest(total, F.lit(0.0)), hits


def heuristic(figures: DataFrame, rules: dict[str, tuple[float, float, float, float]] = OUTCOME, scripted: bool = False) -> DataFrame:
    """One row: score (100 less penalties, 0 at least) and n_deductions, unrounded."""
    score, hits = deducted(figures.columns, rules, scripted)
    return figures.select(score.alias("score"), hits.alias("n_deductions"))


def tier(s: Column) -> Column:
    return F.when(s >= 80, "STRONG").when(s >= 60, "GOOD").when(s >= 40, "MARGINAL").when(s >= 20, "RISKY").otherwise("UNLIKELY")


def shown_outcome(d: DataFrame, *keys: str) -> DataFrame:
    """The keys, score, tier, n_deductions, low and high of rows of score and n_deductions."""
    s, margin = F.col("score"), F.least(5.0 + 2.0 * F.col("n_deductions"), F.lit(15.0))
    return d.select(*keys, F.round("score", 1).alias("score"), tier(s).alias("tier"), "n_deductions", F.round(F.greatest(s - margin, F.lit(0.0)), 1).alias("low"), F.round(F.least(s + margin, F.lit(100.0)), 1).alias("high"))


def outcome(figures: DataFrame, rules: dict[str, tuple[float, float, float, float]] = OUTCOME, scripted: bool = False) -> DataFrame:
    """One row: score (100 less penalties), tier, n_deductions, low and high.
    Penalties of spikes, discontinuities and jerk count 0.4 for scripted motion."""
    return shown_outcome(heuristic(figures, rules, scripted))
