"""More registered queries: composed selections, leakage, surprise, repairs,
policies, evidence and camera frames."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import in_order
from ..operators import clusters, compare, coverage, cure, dynamics, evidence, export, frames, gates, leakage, limits, motion, neighbours, policies, report, scoring, selection, stats, surprise, tasks, timing
from ..sources import lerobot
from ..sources.episodes import LINE_DIMS, table
from .catalog import ACTIVE, GRIPPER, METRICS, _assessed, _features, _influence, _long, _outliers, _summary, _vectors, ev, figures, li, query, shown

STREAMS = ("a0", "s0")
HELD = "0:5,33,1000:1030"
REPORTED = {"jitter_cv": "timestamp_jitter_cv", "dropout": "timestamp_dropout_rate", "spike_rate": "jerk_spike_rate", "disc_rate": "velocity_discontinuity_rate", "action_dropout": "action_dropout_rate"}


def following(spark, d):
    """Lines whose state is the action before."""
    s = li(spark, d)
    return s.withColumns({f"s{k}": F.coalesce(F.lag(f"a{k}").over(in_order()), F.col(f"a{k}")) for k in range(4)})


def holding(spark, d):
    """Lines with a coarse state that holds for several steps, and an action a little beside it."""
    level = F.floor(F.col("a1") / 60000).cast("double")
    return li(spark, d).select("ep", "step", "t", (level + F.col("a2")).alias("a0"), (2 * level + F.col("a3")).alias("a1"), level.alias("s0"), (2 * level).alias("s1"))


def flags(spark, d):
    """The summary's flags under the names that reports have."""
    name = F.create_map(*[F.lit(x) for pair in REPORTED.items() for x in pair])
    return scoring.flags(_summary(spark, d)).withColumn("metric", name[F.col("metric")])


@query
def calibration_drift(spark, d):
    return shown(tasks.calibration_drift(holding(spark, d), ("a0", "a1"), ("s0", "s1")))


@query
def action_dropout_vector(spark, d):
    return shown(timing.action_dropout(following(spark, d), ("a2", "a3"), ("s0", "s1")))


@query
def divergence_flag(spark, d):
    return shown(motion.divergence_flag(following(spark, d), ("a2", "a3"), ("s2", "s3")))


@query
def divergence_units(spark, d):
    return shown(motion.divergence_flag(ev(spark, d)))


@query
def accelerations_summed(spark, d):
    return shown(motion.velocity(li(spark, d), ("a2", "a3"), "acceleration"))


@query
def force_contact(spark, d):
    return shown(tasks.force_contact(li(spark, d), ACTIVE, "a3", 0.04))


@query
def force_flags(spark, d):
    return shown(tasks.force_flags(tasks.force_contact(li(spark, d), ACTIVE, "a3", 0.04)))


@query
def grasp_summary(spark, d):
    return shown(tasks.grasp_summary(tasks.grasp_count(li(spark, d), GRIPPER, ACTIVE)))


@query
def synthetic_clock_flags(spark, d):
    steps = li(spark, d)
    m = timing.timing_metrics(steps).agg(F.avg("jitter_cv").alias("jitter_cv"), F.avg("dropout").alias("dropout"))
    return shown(timing.not_evaluable(scoring.flags(m), timing.all_synthetic(timing.grid_and_scale(steps))))


def _checks(spark, d):
    steps = li(spark, d)
    names = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ep"), F.col("s_name").alias("task"))
    rates = policies.episode_rates(steps).join(names, "ep", "left")
    bits = coverage.action_entropy(steps, LINE_DIMS).agg(F.avg("bits")).first()[0]
    return policies.compatibility(rates, len(LINE_DIMS), 3, {"entropy": bits, "ldlj": motion.whole_ldlj(steps, LINE_DIMS).agg(F.avg("ldlj")).first()[0]})


@query
def policy_compatibility(spark, d):
    return shown(_checks(spark, d), digits=4)


@query
def policy_hints(spark, d):
    return policies.hints(_checks(spark, d))


def copied(spark, d):
    """Events with copies of 20 users under other numbers, the last ten of them a little off."""
    s = ev(spark, d).select("ep", "step", "t", "a0", "s0")
    again = s.where("ep between 1 and 20").select((F.col("ep") + 1000).alias("ep"), "step", "t", F.when(F.col("ep") > 10, F.col("a0") * 1.0001).otherwise(F.col("a0")).alias("a0"), "s0")
    return s.unionByName(again)


def _near(spark, d):
    steps = copied(spark, d)
    return leakage.near_leakage(steps, leakage.held(steps, leakage.holdout(spark, HELD)), STREAMS)


@query
def near_leakage(spark, d):
    return shown(_near(spark, d)[0], digits=5)


@query
def near_leakage_summary(spark, d):
    return shown(_near(spark, d)[1], digits=5)


@query
def permutation_drift(spark, d):
    m = _long(spark, d)
    t = dynamics.permutation_tests(m.where("ep % 2 = 0"), m.where("ep % 2 = 1"))
    name = F.create_map(*[F.lit(x) for pair in REPORTED.items() for x in pair])
    way = policies.direction(name[F.col("metric")], F.round("delta", 9))
    t = t.withColumn("direction", way)
    return shown(t.withColumn("level", policies.drift_level(F.col("direction"), F.col("p_value") < 0.05, F.lit("WARNING"))))


@query
def grouped_assessment(spark, d):
    """Assessments inside each of three tasks."""
    m = figures(spark, d)
    long = stats.long_metrics(m, METRICS).withColumn("task", F.col("ep") % 3)
    return shown(stats.assessments(long, gates.quality_risk(m), by=("metric", "task")).drop("top_reason"))


@query
def assessment_summary(spark, d):
    return shown(stats.assessment_summary(_assessed(spark, d)))


@query
def headline_scores(spark, d):
    return shown(policies.headline_scores(_assessed(spark, d)))


def _gate(spark, d):
    return gates.quality_gate(motion.motion_metrics(li(spark, d), LINE_DIMS).withColumns({"dropout": F.lit(0.0), "ldlj": F.lit(None).cast("double")}), gates.Limits(spike_rate=0.006))


@query
def coreset_influence(spark, d):
    return selection.two_stage(_gate(spark, d), 0.3, "influence", scores=_influence(spark, d).select("ep", F.round("influence", 9).alias("score")))


@query
def coreset_energy(spark, d):
    m = motion.motion_metrics(li(spark, d), LINE_DIMS).select("ep", F.col("disc_rate").alias("score"), F.col("spike_rate").alias("error"))
    return selection.two_stage(_gate(spark, d), 0.3, "energy", scores=m, error="error")


def _voxels(spark, d):
    return surprise.normalised_transitions(ev(spark, d), ("s0",), ("a0",))


@query
def coreset_novelty(spark, d):
    gate = gates.quality_gate(figures(spark, d))
    novelty = surprise.voxel_novelty(_voxels(spark, d), ["z_s0", "a_a0", "n_s0"])
    return selection.two_stage(gate, 0.3, "novelty", scores=novelty.withColumnRenamed("novelty", "score"))


@query
def coreset_diversity(spark, d):
    f = coverage.episode_features(li(spark, d), LINE_DIMS).join(motion.motion_metrics(li(spark, d), LINE_DIMS), "ep").join(coverage.trajectory_entropy(li(spark, d), LINE_DIMS), "ep")
    action = [c for c in f.columns if c[:2] in ("m_", "d_")]
    x, cols = selection.weighted_features(f.withColumn("length", F.col("n_steps") / 1000.0), action, ["spike_rate", "disc_rate", "length"], "entropy", 0.6, 0.1)
    return selection.two_stage(_gate(spark, d), 0.3, "diversity", x, cols)


@query
def feature_weights(spark, d):
    f = coverage.episode_features(li(spark, d), LINE_DIMS).join(motion.motion_metrics(li(spark, d), LINE_DIMS), "ep")
    x, _ = selection.weighted_features(f.withColumn("length", F.col("n_steps") / 1000.0), ["m_a0", "d_a0"], ["spike_rate", "disc_rate", "length"], None, 0.7)
    return shown(x)


@query
def entropy_ranking(spark, d):
    return shown(selection.entropy_ranking(coverage.trajectory_entropy(li(spark, d), LINE_DIMS)))


@query
def evenly_spaced(spark, d):
    return stats.evenly_spaced(li(spark, d).select("ep").distinct(), 7)


@query
def cure_smooth(spark, d):
    return shown(cure.smooth(ev(spark, d)), digits=5)


@query
def cure_episodes(spark, d):
    return shown(cure.cure(ev(spark, d), threshold=0.001), digits=3)


@query
def corrupt_jitter(spark, d):
    return shown(cure.add_jitter(ev(spark, d).withColumn("t", F.col("t") % 1000), 20.0), digits=5)


@query
def corrupt_spikes(spark, d):
    return cure.inject_spikes(ev(spark, d), 0.1)


@query
def corrupt_delay(spark, d):
    return shown(cure.delay(ev(spark, d).withColumn("t", F.col("t") % 1000), 0.3), digits=5)


@query
def corrupt_truncate(spark, d):
    return cure.truncate(ev(spark, d), fraction=0.3).select("ep", "step", "a0")


@query
def corruption_report(spark, d):
    steps = ev(spark, d)
    both = [timing.timing_metrics(s).join(motion.motion_metrics(s).drop("n_steps"), "ep") for s in (steps, cure.truncate(steps))]
    return shown(cure.damage_report(*both, METRICS))


@query
def transfer_ladder(spark, d):
    steps = li(spark, d)

    def side(s):
        rates = policies.episode_rates(s)
        one = rates.agg(F.avg("hz_forward").alias("hz"), F.avg("n_steps").alias("mean_length"), F.lit(4).alias("n_dims"))
        return one.crossJoin(motion.whole_ldlj(s, LINE_DIMS).agg(F.avg("ldlj").alias("ldlj")))  # one row each

    one, other = steps.where("ep % 2 = 0"), steps.where("ep % 2 = 1").withColumn("t", F.col("t") * 2)
    return policies.transfer(side(one), side(other), policies.range_covered(one, other, LINE_DIMS, LINE_DIMS))


def _surprise(spark, d):
    return surprise.surprise(ev(spark, d), ("s0",), ("a0",))


@query
def linear_surprise(spark, d):
    return shown(_surprise(spark, d))


@query
def surprise_verdicts(spark, d):
    jerk = motion.motion_metrics(ev(spark, d)).select("ep", F.col("spike_rate").alias("jerk"))
    return shown(surprise.surprise_verdicts(_surprise(spark, d).withColumn("surprise", F.round("surprise", 9)), jerk))


@query
def surprising_episodes(spark, d):
    steps = ev(spark, d)
    scores = _surprise(spark, d).withColumn("surprise", F.round("surprise", 9))
    return shown(surprise.curate_surprising(gates.quality_gate(figures(spark, d)), scores, surprise.episode_signals(steps, ("a0",), ("s0",)), 0.3))


@query
def voxel_novelty(spark, d):
    return shown(surprise.voxel_novelty(_voxels(spark, d), ["z_s0", "a_a0", "n_s0"]), digits=9)


@query
def voxel_redundancy(spark, d):
    return shown(surprise.voxel_redundancy(_voxels(spark, d), ["z_s0", "a_a0", "n_s0"]))


@query
def transition_entropy_2d(spark, d):
    return shown(surprise.entropy_2d(_voxels(spark, d), "z_s0", "a_a0"))


@query
def knn_density(spark, d):
    v, cols = _vectors(spark, d)
    return shown(surprise.knn_density(v, cols), digits=5)


@query
def latent_projection(spark, d):
    """Sizes on the first three principal axes, which don't hang on the axes' signs."""
    v, cols = _vectors(spark, d)
    return shown(surprise.project(v, cols, 3).select("ep", *[F.abs(f"p{i}").alias(f"p{i}") for i in range(3)]), digits=3)


@query
def trajectory_diversity(spark, d):
    f, cols = _features(spark, d)
    return shown(clusters.trajectory_diversity(f, cols))


@query
def coverage_gaps(spark, d):
    f, cols = _features(spark, d)
    return shown(clusters.coverage_gaps(f, cols))


def _records(spark, d):
    """Orders as recorded runs: an experiment, a retention level, a condition and a success rate each."""
    o = table(spark, d, "orders").where("o_orderkey % 3 <> 1")
    level = F.element_at(F.array(F.lit(25.0), F.lit(50.0), F.lit(75.0), F.lit(100.0)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    condition = F.when(level == 100.0, "full").when(F.col("o_orderpriority") < "3", "selected").otherwise("random")
    return o.select((F.col("o_custkey") % 40).alias("experiment_id"), level.alias("retention_pct"), condition.alias("condition"), F.col("o_orderkey").alias("recorded"), F.col("o_orderkey").alias("record_id"), (F.col("o_totalprice") / 600000).alias("success"), F.col("o_orderstatus").alias("embodiment"))


@query
def retention_table(spark, d):
    return shown(evidence.retention_table(_records(spark, d)))


@query
def missing_cells(spark, d):
    return evidence.missing_cells(_records(spark, d).where("record_id % 7 = 0"))


@query
def matrix_coverage(spark, d):
    return evidence.matrix_coverage(_records(spark, d).where("record_id % 101 = 0"), ("embodiment",))


@query
def treatment_deltas(spark, d):
    return shown(evidence.treatment_deltas(_records(spark, d)))


@query
def nearest_retention(spark, d):
    wanted = spark.createDataFrame([(25.4, "random"), (49.0, "selected"), (60.0, "random"), (99.5, "full")], "target_pct double, condition string")
    r = _records(spark, d).select("retention_pct", "condition", "recorded", "success")
    return shown(evidence.nearest_retention(r, wanted))


@query
def precision_table(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("detector"), F.col("lang").alias("dataset"))
    kind = F.when(F.col("toxic") == 1, "ambiguous").when(F.col("quality") == 0, "true_corruption").otherwise("unusual_valid")
    return shown(evidence.precision_table(table(spark, d, "labels").join(docs, "doc_id").select("detector", "dataset", kind.alias("characterization"))))


@query
def baseline_lookup(spark, d):
    p = table(spark, d, "customer").select(F.col("c_mktsegment").alias("detector"), (F.col("c_nationkey") % 10).alias("dataset"), (F.col("c_nationkey") % 3).alias("task_family"), F.col("c_acctbal").alias("rate"), F.col("c_custkey").alias("n_episodes"))
    s = table(spark, d, "supplier")
    wanted = s.select(F.element_at(F.array(F.lit("BUILDING"), F.lit("NOTHING"), F.lit("MACHINERY")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("detector"), F.col("s_nationkey").alias("dataset"), (F.col("s_nationkey") % 4).alias("task_family")).distinct()
    return shown(evidence.lookup_baseline(p, wanted))


def _items(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("dataset"), F.col("doc_id").alias("ep"), (F.col("n_chars") < 400).alias("flagged"), F.col("n_chars").cast("double").alias("priority"))
    return docs


@query
def blind_sample(spark, d):
    return shown(evidence.blind_sample(_items(spark, d), 5, 10, 8))


@query
def detector_scores(spark, d):
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("quality") == 0, "acquisition_fault").when(F.col("toxic") == 1, "unsure").otherwise("fine").alias("label"))
    key = docs.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("dataset"), F.lit("r1").alias("revision"), F.col("doc_id").alias("ep"), F.when(F.col("n_chars") < 1000, 1.0).otherwise(0.25).alias("inclusion_prob"))
    fires = F.explode(F.array(F.struct(F.lit("short").alias("detector"), (F.col("n_chars") < 800).alias("fires")), F.struct(F.lit("long").alias("detector"), (F.col("n_chars") > 4000).alias("fires")))).alias("f")
    snapshots = docs.select(F.col("lang").alias("dataset"), F.lit("r1").alias("revision"), F.col("doc_id").alias("ep"), fires).select("dataset", "revision", "ep", "f.*")
    return shown(evidence.detector_scores(labels, key, snapshots))


@query
def outcome_blend(spark, d):
    near = dynamics.similar_outcomes(figures(spark, d), _summary(spark, d)).withColumn("success", (F.col("ep") % 10) / 10.0)
    return evidence.blend(62.5, near)


@query
def annotation_sidecar(spark, d):
    g = gates.quality_gate(figures(spark, d))
    chosen = figures(spark, d).where("ep % 2 = 0").select("ep")
    rows = evidence.annotations(gates.dispositions(g, chosen), _assessed(spark, d), _outliers(spark, d).select("ep", "metric"))
    return shown(rows.withColumn("integrity_flags", F.array_join("integrity_flags", ",")))


@query
def dimension_scores(spark, d):
    return shown(policies.dimension_scores(flags(spark, d)))


@query
def overall_score(spark, d):
    return shown(policies.overall_score(policies.dimension_scores(flags(spark, d))))


@query
def health_score(spark, d):
    return policies.health_score(flags(spark, d))


@query
def flag_actions(spark, d):
    return policies.actions(flags(spark, d), {"timestamp_jitter_cv": "inspect"})


@query
def ci_verdict(spark, d):
    return policies.ci_verdict(policies.actions(flags(spark, d)))


@query
def audit_confidence(spark, d):
    per = figures(spark, d).select("ep", *METRICS).unpivot("ep", list(METRICS), "metric", "v").where("v is not null")
    g = per.groupBy("metric").agg(F.avg("v").alias("value"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return policies.confidence(g.select("value", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")))


@query
def scripted_signature(spark, d):
    return shown(policies.scripted_signature(figures(spark, d)))


@query
def scripted_outcome(spark, d):
    return scoring.outcome(_summary(spark, d), scripted=True)


@query
def community_ranks(spark, d):
    q = F.percentile("n_chars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.9))).alias("q")
    docs = table(spark, d, "documents")
    per = docs.groupBy("source").agg(F.avg("n_chars").alias("v")).crossJoin(docs.agg(q))  # one row
    rank = policies.landmark_rank(F.col("v"), *[F.col("q")[i] for i in range(4)], higher_better=False)
    return shown(per.select("source", rank.alias("rank"), policies.normal_rate(F.col("v") / 100.0).alias("rate")), digits=4)


def camera(spark, d):
    """Vectors as frames of 8 by 8 pixels: an episode a label, in order of their numbers; the first pixel is the action."""
    e = table(spark, d, "embeddings")
    step = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    pixels = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(F.col("label").cast("long").alias("ep"), step.alias("step"), pixels.alias("pixels")).withColumn("a0", F.col("pixels")[0])


@query
def frame_sharpness(spark, d):
    return shown(frames.sharpness(camera(spark, d), 8, 8), digits=9)


@query
def frame_transitions(spark, d):
    return shown(frames.transitions(camera(spark, d).drop("a0"), 400.0, 0.9), digits=9)


@query
def episode_frames(spark, d):
    return shown(frames.episode_frames(camera(spark, d), 8, 8, 400.0, 0.9))


@query
def blur_outliers(spark, d):
    return shown(frames.blur_outliers(frames.episode_frames(camera(spark, d), 8, 8)))


@query
def frame_flags(spark, d):
    return shown(frames.frame_flags(frames.episode_frames(camera(spark, d), 8, 8, 400.0, 0.9)))


@query
def egomotion(spark, d):
    return shown(frames.egomotion(camera(spark, d), ("a0",)))


@query
def camera_mismatch(spark, d):
    name = F.element_at(F.array(F.lit("observation.images.wrist_cam"), F.lit("camera_top"), F.lit("images.laptop")), (F.col("ep") % 3 + 1).cast("int"))
    return shown(frames.camera_mismatch(frames.egomotion(camera(spark, d), ("a0",)).withColumn("camera", name)))


@query
def visual_lag(spark, d):
    return frames.correlation_lags(frames.motion_pairs(camera(spark, d), ("a0",)), "motion", "activity")


@query
def physics_drift(spark, d):
    return frames.physics_drift(frames.correlation_lags(frames.motion_pairs(camera(spark, d), ("a0",)), "motion", "activity"))


@query
def episode_digests(spark, d):
    return dynamics.episode_digests(ev(spark, d), ("t", "a0"))


@query
def batch_fingerprint(spark, d):
    return dynamics.batch_fingerprint(dynamics.episode_digests(ev(spark, d), ("t", "a0")), "pi0")


@query
def relative_poses(spark, d):
    s = li(spark, d)
    return shown(cure.relative_poses(s.select("ep", "step", F.col("a0").alias("x"), (F.col("a1") / 1000).alias("y"), F.col("a2").alias("z"), F.col("a2").alias("qx"), (F.col("a3") - 0.05).alias("qy"), (F.col("a0") / 100).alias("qz"), F.lit(0.5).alias("qw"))), digits=5)


@query
def standalone_figures(spark, d):
    return shown(dynamics.standalone_figures(li(spark, d), LINE_DIMS), digits=4)


@query
def pair_coherence(spark, d):
    e = table(spark, d, "embeddings")
    pairs = e.select("vec_id", "embedding", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id")).alias("next")).where("next is not null")
    return shown(dynamics.coherence(pairs, "embedding", "next").select("vec_id", "coherence"))


@query
def limit_violations(spark, d):
    urdf = '<robot><joint name="lift" type="prismatic"><limit lower="3" upper="45" velocity="1500"/></joint><joint name="turn" type="revolute"><limit lower="0.01" upper="0.09" velocity="2.5"/></joint><joint name="base" type="fixed"/></robot>'
    return shown(limits.limit_violations(li(spark, d), {"lift": "a0", "turn": "a2"}, limits.parse_limits(spark, urdf)))


@query
def canonical_keys(spark, d):
    """Names of observation keys built from event types."""
    e = table(spark, d, "events").select("event_type").distinct()
    fixed = ("images.top", "images.left_arm", "image.x", "obs/thing", "robot0_eef_pos", "robot0_base", "joint_pos", "camera_rgb", "depth")
    keys = e.select(F.concat(F.lit("obs/"), "event_type").alias("key")).unionByName(spark.createDataFrame([(k,) for k in fixed], "key string"))
    patterns = {"proprioception": ("joint", "eef", "obs"), "vision": ("image", "camera", "depth")}
    return keys.select("key", lerobot.canonical_keys(F.col("key")).alias("name"), lerobot.mapped_column(F.col("key"), patterns).alias("kind"), frames.viewpoint(F.col("key")).alias("view"))


@query
def rows_by_offsets(spark, d):
    """Events in one running order, cut into episodes at the ends of each hundred users' counts."""
    e = table(spark, d, "events").select((F.col("event_id") - F.lit(0)).alias("row"), "value")
    n = e.agg(F.max("row")).first()[0]
    ends = spark.range(1, 12).select(F.col("id").alias("ep"), F.floor((n + 1) * F.col("id") * F.col("id") / 121).alias("end"))
    return lerobot.by_offsets(e, ends).groupBy("ep").agg(F.count("*").alias("n"), F.max("step").alias("last"), F.round(F.sum("value"), 3).alias("total"))


@query
def kept_renumbered(spark, d):
    """Metadata of the kept episodes under their new numbers."""
    n = li(spark, d).where("ep % 3 <> 0").groupBy(F.col("ep").alias("episode_index")).agg(F.count("*").alias("length"))
    meta = table(spark, d, "supplier").select(F.col("s_suppkey").alias("episode_index"), "s_name")
    return lerobot.remap_meta(meta, export.episode_offsets(n))


@query
def vector_transitions(spark, d):
    return shown(dynamics.transition_errors(following(spark, d), ("s2", "s3"), ("a2", "a3")), digits=5)


def _report(spark, d):
    return report.flags(ev(spark, d), ("a0",), ("s0",))


@query
def full_report(spark, d):
    return shown(_report(spark, d), digits=5)


@query
def findings(spark, d):
    return shown(report.findings(_report(spark, d)), digits=5)


@query
def headline_metrics(spark, d):
    return shown(report.headline(_report(spark, d)), digits=5)


@query
def detector_spread(spark, d):
    return report.detector_spread(_outliers(spark, d), ev(spark, d).select("ep").distinct().count())


@query
def outlier_labels(spark, d):
    o = _outliers(spark, d)
    return report.group_labels(stats.consecutive_groups(o), o, ev(spark, d).select("ep").distinct().count())


@query
def most_isolated(spark, d):
    f, cols = _features(spark, d)
    return shown(report.most_isolated(neighbours.nearest(f, f, cols, exclude_self=True)), digits=5)


@query
def drift_thresholds(spark, d):
    return report.drift_thresholds(frames.correlation_lags(frames.motion_pairs(camera(spark, d), ("a0",)), "motion", "activity"))


@query
def leaderboard(spark, d):
    r = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("dataset"), (F.col("o_totalprice") / 10000).alias("score"), (F.col("o_orderstatus") == "F").alias("failed"))
    return shown(report.leaderboard(r))


@query
def not_audited(spark, d):
    o = table(spark, d, "orders")
    return report.not_audited(o.select((F.col("o_custkey") % 50).alias("dataset"), (F.col("o_orderkey") % 5).alias("revision")).distinct(), o.where("o_orderkey % 61 = 0 and o_custkey % 4 <> 0").select((F.col("o_custkey") % 50).alias("dataset"), (F.col("o_orderkey") % 5).alias("revision")))


@query
def audit_snapshot(spark, d):
    return shown(report.snapshot("events", "r1", _assessed(spark, d), _outliers(spark, d)))


@query
def what_if(spark, d):
    m = figures(spark, d)
    chosen = gates.quality_gate(m).where("status <> 'bad'").select("ep")
    predict = lambda side: scoring.outcome(m.join(side, "ep", "left_semi").agg(*[F.avg(c).alias(c) for c in (*METRICS, "ldlj")]))
    return shown(report.what_if(m, chosen, predict, 12.0), digits=4)
