"""How far simulated data is from real data: the gaps of motion, clock, actions
and dynamics, each with its risk, and an index of how well one prepares for the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.episodes import dimensions
from . import moments as mo
from . import motion, policies, timing

#: Fixed values: (medium, high, critical) of each gap, after its scale.
RISKS = {
    "ldlj_gap": (1.0, 3.0, 8.0, 15.0),
    "spike_rate_gap": (20.0, 1.0, 2.0, 4.0),
    "jitter_cv_gap": (10.0, 0.5, 1.5, 3.0),
    "action_kl_divergence": (1.0, 0.5, 1.5, 3.0),
    "transition_dynamics_gap": (10.0, 0.2, 0.5, 1.0),
    "control_frequency_gap": (1.0, 5.0, 15.0, 30.0),
}
#: Coverage from which the risk is low or medium, and the index's share for unknown observations.
COVERED, PARTLY, UNKNOWN_MODALITIES = 0.7, 0.4, 85.0
ORDER = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def risk(name: str, value: float) -> str:
    scale, medium, high, critical = RISKS[name]
    value = value * scale
    return "CRITICAL" if value >= critical else "HIGH" if value >= high else "MEDIUM" if value >= medium else "LOW"


def _binned(a: DataFrame, b: DataFrame, dims: tuple[str, ...], bins: int, on: str) -> DataFrame:
    """(dim, width, na, nb) of the occupied bins over the range of both, or of b alone (values outside fall away);
    dimensions without a range are left out."""
    both = dimensions(a, dims).withColumn("side", F.lit("a")).unionByName(dimensions(b, dims).withColumn("side", F.lit("b")))
    seen = F.col("value") if on == "both" else F.when(F.col("side") == "b", F.col("value"))
    span = both.groupBy("dim").agg(F.min(seen).alias("lo"), F.max(seen).alias("hi")).where("hi > lo").withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    d = both.join(F.broadcast(span), "dim").where("value between lo and hi")  # a row a dimension
    place = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).alias("bin")
    side = lambda s: F.sum((F.col("side") == s).cast("long")).alias(f"n{s}")
    return d.groupBy("dim", place).agg(F.first("width").alias("width"), side("a"), side("b"))


def kl_of_densities(a: DataFrame, b: DataFrame, dims: tuple[str, ...], bins: int = 50, eps: float = 1e-10) -> DataFrame:
    """One row: kl, the mean over dimensions of the divergence of a's histogram from
    b's; ``eps`` is added to each bin's density before these are scaled to one."""
    c = _binned(a, b, dims, bins, "both")
    total = c.groupBy("dim").agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    d = c.join(F.broadcast(total), "dim")
    share = lambda s: (F.col(f"n{s}") / (F.col(f"t{s}") * F.col("width")) + eps) / (1.0 / F.col("width") + bins * eps)
    by = d.groupBy("dim").agg(F.sum(share("a") * F.log(share("a") / share("b"))).alias("kl"))
    return by.agg(F.coalesce(F.avg("kl"), F.lit(0.0)).alias("kl"))


def covered(a: DataFrame, b: DataFrame, dims: tuple[str, ...], bins: int = 20) -> DataFrame:
    """One row: overlap, the mean over dimensions of the share of b's occupied bins (over b's range) that a occupies."""
    c = _binned(a, b, dims, bins, "b").where("nb > 0").groupBy("dim").agg(F.avg((F.col("na") > 0).cast("double")).alias("o"))
    return c.agg(F.coalesce(F.avg("o"), F.lit(0.0)).alias("overlap"))


def figures(steps: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """One row: mean ldlj, spike, jitter and hz of the episodes."""
    by = timing.timing_metrics(steps).select("ep", "jitter_cv").join(motion.motion_metrics(steps, actions).select("ep", "spike_rate"), "ep")
    by = by.join(motion.whole_ldlj(steps, actions).select("ep", "ldlj"), "ep").join(policies.episode_rates(steps).select("ep", "hz_forward"), "ep")
    return by.agg(F.avg("ldlj").alias("ldlj"), F.avg("spike_rate").alias("spike"), F.avg("jitter_cv").alias("jitter"), F.avg("hz_forward").alias("hz"))


def sim_to_real(
    sim: DataFrame, real: DataFrame, actions: tuple[str, ...], states: tuple[str, ...] = (), sim_modalities: set[str] | None = None, real_modalities: set[str] | None = None
) -> DataFrame:
    """(gap, sim, real, value, risk): a row for each gap that can be had, one for
    overall_risk (the worst of them) and one for alignment_index (0 to 100).

    The dynamics gap is how much worse a ridge model of the state's change that is
    fitted on ``sim`` forecasts ``real`` than one fitted on ``real`` itself (root mean squared
    errors); both come from aggregated moments.  The index is the mean of the
    scores of divergence, frequency, coverage, dynamics and shared modalities that there are.
    """
    rows: list[tuple] = []
    s, r = figures(sim, actions).first(), figures(real, actions).first()  # one row each

    def gap(name: str, a: float | None, b: float | None, digits: int) -> float | None:
        if a is None or b is None:
            return None
        delta = abs(a - b)
        rows.append((name, float(a), float(b), round(delta, digits), risk(name, delta)))
        return round(delta, digits)

    gap("ldlj_gap", s.ldlj, r.ldlj, 3)
    gap("spike_rate_gap", s.spike, r.spike, 4)
    gap("jitter_cv_gap", s.jitter, r.jitter, 5)
    kl = kl_of_densities(sim, real, actions).first().kl
    rows.append(("action_kl_divergence", None, None, round(kl, 4), risk("action_kl_divergence", kl)))
    overlap = covered(sim, real, actions).first().overlap
    rows.append(("sim_coverage_of_real", None, None, round(overlap, 3), "LOW" if overlap >= COVERED else "MEDIUM" if overlap >= PARTLY else "HIGH"))
    clip = lambda x: max(0.0, min(100.0, 100.0 * x))
    parts = [clip(1.0 - (round(kl, 4) - 0.1) / 2.9)]
    if states:
        ms, mr = (mo.matrix(mo.moments(d, states, actions, by=()).first().moments) for d in (sim, real))
        own, other = (mo.change_rmse(mr, mo.change_weights(m, len(states)), len(states)) for m in (mr, ms))
        worse = max(0.0, other - own)
        rows.append(("transition_dynamics_gap", None, None, round(worse, 4), risk("transition_dynamics_gap", worse)))
    hz = gap("control_frequency_gap", s.hz, r.hz, 1)
    if hz is not None:
        parts.append(clip(1.0 - hz / 30.0))
    parts.append(100.0 * round(overlap, 3))
    if states:
        parts.append(clip(1.0 - round(worse, 4)))
    if sim_modalities and real_modalities:
        parts.append(100.0 * len(sim_modalities & real_modalities) / len(sim_modalities | real_modalities))
    else:
        parts.append(UNKNOWN_MODALITIES)
    worst = max((x[4] for x in rows), key=ORDER.index)
    rows.append(("overall_risk", None, None, None, worst))
    rows.append(("alignment_index", None, None, round(sum(parts) / len(parts), 1), None))
    return sim.sparkSession.createDataFrame(rows, "gap string, sim double, real double, value double, risk string")
