"""Quality gates and the decisions that follow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ramp, rounded

KEEP, DROP, REVIEW = "keep", "drop", "review"


@dataclass(frozen=True)
class Limits:
    """Stage-1 limits; a null figure never fails."""

    min_length: int = 10
    spike_rate: float = 0.10
    disc_rate: float = 0.25
    dropout: float = 0.10
    ldlj: float = -30.0


def contact_aware_disc(figures: DataFrame, limits: Limits) -> DataFrame:
    """One row, disc_limit: the limit times 1 to 3, as the mean discontinuity
    rate goes from 3 to 20 times the mean spike rate (contact, not noise)."""
    r = figures.agg(F.avg("disc_rate").alias("d"), F.avg("spike_rate").alias("s"))
    ratio = F.coalesce(F.col("d"), F.lit(0.0)) / F.greatest(F.coalesce(F.col("s"), F.lit(0.0)), F.lit(0.001))
    return r.select((F.lit(limits.disc_rate) * (1.0 + 2.0 * ramp(ratio, 3.0, 20.0))).alias("disc_limit"))


def quality_gate(figures: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(ep, reasons, status): status bad, clean, or not_evaluated without any figure.

    A short episode has that as its sole reason; else the reasons stand in the
    order spikes, discontinuities, dropout, jerk.
    """
    d = figures.crossJoin(F.broadcast(contact_aware_disc(figures, limits)))  # one row
    other = F.array_compact(
        F.array(
            F.when(F.col("spike_rate") > limits.spike_rate, "spike_rate"),
            F.when(F.col("disc_rate") > F.col("disc_limit"), "disc_rate"),
            F.when(F.col("dropout") > limits.dropout, "dropout"),
            F.when(F.col("ldlj") < limits.ldlj, "ldlj"),
        )
    )
    reasons = F.when(F.col("n_steps") < limits.min_length, F.array(F.lit("length"))).otherwise(other)
    seen = F.coalesce("spike_rate", "disc_rate", "dropout", "ldlj").isNotNull()
    status = F.when(F.size("reasons") > 0, "bad").when(seen, "clean").otherwise("not_evaluated")
    return d.withColumn("reasons", reasons).withColumn("status", status).select("ep", F.concat_ws(",", "reasons").alias("reasons"), "status")


def violations(figures: DataFrame, upper: dict[str, float], lower: dict[str, float]) -> DataFrame:
    """(ep, metric, value, threshold): one row for each figure beyond its limit."""
    rows = figures.select("ep", *[F.col(m).cast("double").alias(m) for m in [*upper, *lower]]).unpivot("ep", [*upper, *lower], "metric", "value")
    limit, is_low = F.lit(None).cast("double"), F.col("metric").isin(*lower)
    for name, x in {**upper, **lower}.items():
        limit = F.when(F.col("metric") == name, F.lit(float(x))).otherwise(limit)
    rows = rows.withColumn("threshold", limit)
    return rows.where(F.when(is_low, F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold")))


def quality_risk(figures: DataFrame) -> DataFrame:
    """(ep, quality_risk): weighted share of the limits that spikes,
    discontinuities, dropout and jerk use up; a null adds nothing."""
    part = lambda c, top: F.least(F.coalesce(F.col(c) / top, F.lit(0.0)), F.lit(1.0))
    jerk = F.coalesce(F.least(F.greatest((F.col("ldlj") + 3.0) / -27.0, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    risk = 0.35 * part("spike_rate", 0.10) + 0.35 * part("disc_rate", 0.25) + 0.20 * part("dropout", 0.10) + 0.10 * jerk
    return figures.select("ep", rounded(risk, 6).alias("quality_risk"))


def dispositions(gate: DataFrame, selected: DataFrame, redundant: str = DROP) -> DataFrame:
    """(ep, disposition): bad ones drop, unselected ones are redundant, those
    that couldn't be judged are for review."""
    d = gate.join(selected.select("ep", F.lit(True).alias("chosen")), "ep", "left")
    return d.select("ep", F.when(F.col("status") == "bad", DROP).when(F.col("status") == "not_evaluated", REVIEW).when(F.col("chosen"), KEEP).otherwise(redundant).alias("disposition"))


def characterised(gate: DataFrame, selected: DataFrame, lengths: DataFrame, assessed: DataFrame, redundant: str = DROP) -> DataFrame:
    """(ep, disposition, n_steps, score, quality_risk, anomaly, coverage_value,
    redundancy, integrity_flags): each decision with what it rests on.

    score is 100 less the risk in percent, redundancy 1 less the coverage value; null where those are
    null or the episode isn't in ``assessed`` (ep, quality_risk, anomaly, coverage_value).  Flags are
    the gate's reasons of dropped episodes, else empty.
    """
    d = dispositions(gate, selected, redundant).join(gate.select("ep", "reasons", "status"), "ep").join(lengths.select("ep", "n_steps"), "ep", "left")
    d = d.join(assessed.select("ep", "quality_risk", "anomaly", "coverage_value"), "ep", "left")
    return d.select(
        "ep", "disposition", "n_steps", rounded(100.0 * (1.0 - F.col("quality_risk")), 1).alias("score"), "quality_risk", "anomaly", "coverage_value",
        rounded(1.0 - F.col("coverage_value"), 4).alias("redundancy"), F.when(F.col("status") == "bad", F.col("reasons")).otherwise("").alias("integrity_flags"),
    )


#: The dispositions with which an episode stays in the data.
KEEP_LIKE = ("keep", "downweight", "annotate")


def approved_rows(rows: DataFrame, decisions: DataFrame, key: str = "ep", kept: tuple[str, ...] = KEEP_LIKE) -> DataFrame:
    """The rows of a data set whose episode has a disposition that keeps it;
    ``decisions``: (ep, disposition).  Episodes without a decision go."""
    keep = decisions.where(F.lower("disposition").isin(*kept)).select(F.col("ep").alias(key)).distinct()
    return rows.join(keep, key, "left_semi")
