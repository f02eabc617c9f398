"""Registered queries over one report of a dataset: phases, copies, trust,
what to keep, outcomes by policy, failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..operators import coverage, dynamics, evidence, gates, one_shot, scoring, sft, surprise, tasks, timing
from ..sources.episodes import table, turns
from .analysis import _report, _voxels
from .catalog import ACTIVE, GRIPPER, LINE_DIMS, _assessed, _influence, _summary, _vectors, ev, figures, li, query, shown

POLICIES = ("act", "diffusion_policy", "octo")
FAILED_DIMS = ("a2", "a3")
COPY = 1_000_000


def doubled(spark, d):
    """Events and all their episodes again under other numbers, the odd ones with another action."""
    e = ev(spark, d).select("ep", "step", "a0", "s0")
    again = e.select((F.col("ep") + COPY).alias("ep"), "step", F.when(F.col("ep") % 2 == 1, F.col("a0") + 1).otherwise(F.col("a0")).alias("a0"), "s0")
    return e.unionByName(again)


def _all_flags(spark, d):
    return _report(spark, d).unionByName(one_shot.copies_flag(doubled(spark, d), ("a0", "s0")))


@query
def phase_flags(spark, d):
    return shown(one_shot.phase_flags(tasks.phase_fractions(li(spark, d), GRIPPER, ACTIVE)))


@query
def copied_episodes(spark, d):
    return one_shot.copies(doubled(spark, d), ("a0", "s0"))


@query
def integrity_categories(spark, d):
    return one_shot.categories(_all_flags(spark, d))


@query
def one_shot_analysis(spark, d):
    redundancy = surprise.voxel_redundancy(_voxels(spark, d), ["z_s0", "a_a0", "n_s0"])
    return shown(one_shot.one_shot(_all_flags(spark, d), redundancy, ev(spark, d)))


@query
def policy_outcomes(spark, d):
    """Three policies' expected outcomes, with a calibrated weight of spikes."""
    return one_shot.outcomes(_summary(spark, d), POLICIES, weights={"spike_rate": 9.0})


@query
def predicted_outcome(spark, d):
    """Drawn towards episodes with similar figures, whose success is a tenth of their number's last digit."""
    records = figures(spark, d).withColumn("success", (F.col("ep") % 10) / 10.0)
    return one_shot.predicted(_summary(spark, d), records, "act")


@query
def frame_rate_summary(spark, d):
    return shown(timing.frame_rate_summary(ev(spark, d)), digits=3)


@query
def diagnosed_failures(spark, d):
    """Returned lines of each supplier as a failure against what the suppliers' other lines cover, by both scales."""
    lines = li(spark, d)
    raw = coverage.episode_features(lines.where("l_returnflag <> 'R'"), FAILED_DIMS)
    cols = [c for c in raw.columns if c != "ep"]
    training = coverage.scaled(raw, cols)
    out = None
    for scale, span in (("own", None), ("training", raw)):
        failed = one_shot.failure_features(lines.where("l_returnflag = 'R'"), FAILED_DIMS, span)
        one = one_shot.diagnose(failed, training, cols, 61.5).withColumn("scale", F.lit(scale))
        out = one if out is None else out.unionByName(one)
    return shown(out.drop("nearest"), digits=5)


@query
def collection_focus(spark, d):
    return shown(one_shot.collection_focus(li(spark, d).where("l_returnflag = 'R'"), LINE_DIMS, digits=13), digits=9)


@query
def transition_flag(spark, d):
    return shown(dynamics.transition_flag(ev(spark, d)), digits=4)


@query
def characterised_episodes(spark, d):
    """Decisions of the gate on even users, with the influence of the supplier of a number as their coverage."""
    f = figures(spark, d)
    worth = _influence(spark, d).select("ep", rounded("influence", 4).alias("coverage_value"))
    assessed = _assessed(spark, d).drop("coverage_value").join(worth, "ep", "left")
    return shown(gates.characterised(gates.quality_gate(f), f.where("ep % 2 = 0").select("ep"), f.select("ep", "n_steps"), assessed))


@query
def fault_detectors(spark, d):
    """Which detectors fire on users, all of whose episodes are there twice, the even ones' unchanged."""
    f, assessed = figures(spark, d), _assessed(spark, d)
    fence = coverage.short_episodes(f.select("ep", "n_steps")).select("fence")
    copied = one_shot.copies(doubled(spark, d), ("a0", "s0")).select((F.col("ep") - COPY).alias("ep"), F.col("original").alias("duplicate_of"))
    s = f.crossJoin(F.broadcast(fence)).select("ep", (F.col("n_steps") < F.col("fence")).alias("short_outlier"), F.lit(None).cast("boolean").alias("video_fault"))  # one row
    s = s.join(gates.quality_gate(f).select("ep", (F.col("status") == "bad").alias("stage1_fail")), "ep").join(copied, "ep", "left")
    return evidence.detectors(s.join(assessed.select("ep", F.round("quality_risk", 6).alias("quality_risk"), F.round("anomaly", 6).alias("anomaly")), "ep"), 0.4, 0.9)


@query
def whole_sft_outcome(spark, d):
    """The outcome of pairs that pass the gate, with vectors for instruction and response."""
    pairs = turns(table(spark, d, "conversations"))
    v, cols = _vectors(spark, d)
    e = table(spark, d, "embeddings")
    n = e.count()
    own = lambda name: e.select(F.col("vec_id").alias(f"_{name}"), F.col("embedding").alias(name))
    met = pairs.withColumns({"_left": F.col("conv_id") % n, "_right": (F.col("conv_id") * 7 + F.col("turn")) % n}).join(own("left"), "_left").join(own("right"), "_right")
    kept = sft.gate(sft.with_coherence(sft.fingerprint(pairs), met, "left", "right").withColumn("coherence", F.round("coherence", 12))).where("passed")
    points = kept.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), (F.col("conv_id") % n).alias("ep")).join(v, "ep").select("key", *cols)
    return scoring.outcome(sft.whole_aggregate(kept, points, cols, "key"), scoring.SFT_OUTCOME)
