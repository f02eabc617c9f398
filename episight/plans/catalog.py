"""The registered queries over the driver's tables.

Episodes stand for: users of ``events`` (one action, one state), suppliers of
``lineitem`` (four actions, steady clock) and orders (length only); pairs of
``conversations`` turns stand for instruction and response; ``documents``,
``benchmark`` and ``labels`` for content and human labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import out, upper_level
from ..operators import compare, coverage, dynamics, export, gates, motion, neighbours, scoring, selection, sft, stats, tasks, timing
from ..sources.episodes import LINE_DIMS, LINE_PERIOD, event_steps, line_steps, order_lengths, table, turns
from ..streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
GRIPPER, ACTIVE = "a3", ("a0", "a1", "a2")
METRICS = ("jitter_cv", "dropout", "spike_rate", "disc_rate")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def shown(df: DataFrame, *exact: str, digits: int = 6) -> DataFrame:
    """Round all double columns but those named."""
    return df.select(*[F.col(c) if c in exact or t not in ("double", "float") else out(F.col(c), digits).alias(c) for c, t in df.dtypes])


def ev(spark: SparkSession, d: str) -> DataFrame:
    return event_steps(table(spark, d, "events"))


def li(spark: SparkSession, d: str) -> DataFrame:
    return line_steps(table(spark, d, "lineitem"))


def figures(spark: SparkSession, d: str) -> DataFrame:
    """(ep, n_steps, jitter_cv, dropout, spike_rate, disc_rate, ldlj) of the events' episodes."""
    steps = ev(spark, d)
    return timing.timing_metrics(steps).join(motion.motion_metrics(steps).drop("n_steps"), "ep").join(motion.whole_ldlj(steps, ("a0",)), "ep")


@query
def episode_timing_metrics(spark, d):
    return shown(timing.timing_metrics(ev(spark, d)))


@query
def timing_flags(spark, d):
    m = timing.timing_metrics(ev(spark, d)).agg(F.avg("jitter_cv").alias("jitter_cv"), F.avg("dropout").alias("dropout"))
    return shown(m).select("jitter_cv", "dropout", upper_level(F.col("jitter_cv"), 0.15, 0.30).alias("jitter_level"), upper_level(F.col("dropout"), 0.01, 0.05).alias("dropout_level"))


@query
def timing_grid_and_scale(spark, d):
    return shown(timing.grid_and_scale(ev(spark, d)))


@query
def frame_rate_stability(spark, d):
    return shown(timing.frame_rates(ev(spark, d)), digits=3)


@query
def clock_lag(spark, d):
    return shown(timing.clock_lag(ev(spark, d).withColumn("action_t", F.col("t") + F.col("a0") / 10000)), digits=3)


@query
def action_dropout(spark, d):
    return shown(timing.action_dropout(ev(spark, d)))


@query
def event_motion(spark, d):
    return shown(motion.motion_metrics(ev(spark, d)))


@query
def line_motion(spark, d):
    return shown(motion.motion_metrics(li(spark, d), LINE_DIMS))


@query
def velocity_discontinuity_filtered(spark, d):
    return shown(motion.filtered_discontinuity(li(spark, d), LINE_DIMS, LINE_PERIOD))


@query
def whole_episode_ldlj(spark, d):
    return shown(motion.whole_ldlj(li(spark, d), LINE_DIMS), digits=4)


@query
def submovement_ldlj(spark, d):
    return shown(motion.submovement_ldlj(li(spark, d), LINE_DIMS), digits=4)


@query
def action_state_divergence(spark, d):
    return shown(motion.action_state_divergence(ev(spark, d)))


@query
def gripper_dims(spark, d):
    return shown(tasks.gripper_dims(li(spark, d), LINE_DIMS))


@query
def contact_fraction(spark, d):
    return shown(tasks.contact_fraction(li(spark, d), GRIPPER, ACTIVE))


@query
def grasp_count(spark, d):
    return tasks.grasp_count(li(spark, d), GRIPPER, ACTIVE)


@query
def phase_fractions(spark, d):
    return shown(tasks.phase_fractions(li(spark, d), GRIPPER, ACTIVE))


@query
def sustained_runs(spark, d):
    steps = ev(spark, d)
    return tasks.sustained_runs(steps, F.col("a0") > 20, 3)


@query
def hold_offsets(spark, d):
    from .analysis import holding

    return shown(tasks.hold_offsets(holding(spark, d), ("a0", "a1"), ("s0", "s1")), digits=9)


@query
def cure_trim(spark, d):
    return tasks.trim_dead_time(ev(spark, d), 0.02, ("a0", "s0"))


@query
def trajectory_entropy(spark, d):
    return shown(coverage.trajectory_entropy(li(spark, d), LINE_DIMS))


@query
def action_entropy(spark, d):
    return shown(coverage.action_entropy(li(spark, d), LINE_DIMS))


@query
def direction_entropy(spark, d):
    return shown(coverage.direction_entropy(li(spark, d), LINE_DIMS))


@query
def episode_length_stats(spark, d):
    return shown(coverage.length_stats(order_lengths(table(spark, d, "lineitem"))))


@query
def short_episode_fence(spark, d):
    return shown(coverage.short_episodes(order_lengths(table(spark, d, "lineitem"))))


@query
def pca_top2(spark, d):
    return shown(coverage.pca_share(li(spark, d), LINE_DIMS))


@query
def episode_features(spark, d):
    f = coverage.episode_features(li(spark, d), LINE_DIMS)
    return shown(coverage.scaled(f, [c for c in f.columns if c != "ep"]), digits=5)


def _features(spark, d):
    f = coverage.episode_features(li(spark, d), LINE_DIMS)
    return coverage.scaled(f, [c for c in f.columns if c != "ep"]), [c for c in f.columns if c != "ep"]


@query
def nearest_neighbour(spark, d):
    f, cols = _features(spark, d)
    return shown(neighbours.nearest(f, f, cols, exclude_self=True), digits=5)


def _influence(spark, d):
    f, cols = _features(spark, d)
    steps = li(spark, d)
    novelty = neighbours.nearest(f, f, cols, exclude_self=True).select("ep", F.col("distance").alias("novelty"))
    parts = novelty.join(coverage.trajectory_entropy(steps, LINE_DIMS), "ep").join(tasks.contact_fraction(steps, GRIPPER, ACTIVE).withColumnRenamed("contact_fraction", "contact"), "ep")
    return selection.influence(parts)


@query
def influence(spark, d):
    return shown(_influence(spark, d), digits=4)


@query
def topk_influence(spark, d):
    return shown(selection.top_k(_influence(spark, d), "influence", 20), digits=4)


@query
def topk_energy(spark, d):
    m = motion.motion_metrics(li(spark, d), LINE_DIMS).select("ep", F.col("disc_rate").alias("energy"), F.col("spike_rate").alias("error"))
    return shown(selection.calm_top_k(m, "energy", "error", 20))


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("ep"), "label", *[F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(64)]), [f"x{k}" for k in range(64)]


@query
def kcenter_coreset(spark, d):
    v, cols = _vectors(spark, d)
    return selection.k_center_exact(v, cols, 50)


@query
def diversity_scores(spark, d):
    v, cols = _vectors(spark, d)
    return shown(selection.distance_to(v.where("ep < 20"), v, cols), digits=4)


@query
def nearest_embedding(spark, d):
    v, cols = _vectors(spark, d)
    return shown(neighbours.nearest(v, v, cols, exclude_self=True), digits=4)


def _long(spark, d):
    return stats.long_metrics(figures(spark, d), METRICS)


def _outliers(spark, d):
    return stats.mad_outliers(_long(spark, d), floor={"jitter_cv": 0.01})


@query
def mad_outliers(spark, d):
    return shown(_outliers(spark, d), digits=4)


@query
def firing_rates(spark, d):
    return shown(stats.firing_rates(_outliers(spark, d), _long(spark, d)))


@query
def outlier_clusters(spark, d):
    return stats.consecutive_groups(_outliers(spark, d))


@query
def percentile_ranks(spark, d):
    return shown(stats.percentile_ranks(_long(spark, d)))


@query
def robust_z(spark, d):
    return shown(stats.robust_z(_long(spark, d)), digits=4)


def _assessed(spark, d):
    m = figures(spark, d)
    return stats.assessments(stats.long_metrics(m, METRICS), gates.quality_risk(m))


@query
def episode_assessment(spark, d):
    return shown(_assessed(spark, d).drop("top_reason"))


@query
def review_queue(spark, d):
    return shown(stats.review_queue(_assessed(spark, d), 20).select("ep", "priority"))


@query
def quality_risk(spark, d):
    return shown(gates.quality_risk(figures(spark, d)))


@query
def quality_gate(spark, d):
    return gates.quality_gate(figures(spark, d))


@query
def curator_violations(spark, d):
    return shown(gates.violations(figures(spark, d), {"jitter_cv": 0.9, "dropout": 0.05, "spike_rate": 0.10, "disc_rate": 0.5}, {"n_steps": 60.0}))


@query
def dispositions(spark, d):
    f = figures(spark, d)
    chosen = f.where("ep % 2 = 0").select("ep")
    return gates.dispositions(gates.quality_gate(f), chosen)


@query
def annotation_manifest(spark, d):
    return export.manifest(dispositions(spark, d))


def _summary(spark, d):
    """One row of the figures that the scores need."""
    steps = ev(spark, d)
    f = figures(spark, d).agg(*[F.avg(c).alias(c) for c in METRICS])
    drop = timing.action_dropout(steps).agg(F.avg("action_dropout").alias("action_dropout"))
    bits = coverage.action_entropy(steps, ("a0",)).agg(F.avg("bits").alias("entropy"))
    n = steps.groupBy("ep").agg(F.count("*").alias("n_steps"))
    cv = coverage.length_stats(n).select(F.col("cv").alias("length_cv"))
    short = coverage.short_episodes(n).select("short_fraction")
    one = f
    for part in (drop, bits, cv, short):
        one = one.crossJoin(part)  # one row each
    # how well the episodes' means fall into those above and below their median
    means = steps.groupBy("ep").agg(F.avg("a0").alias("x"))
    halves = means.crossJoin(F.broadcast(means.agg(F.percentile("x", F.lit(0.5)).alias("mid"))))  # one row
    squares = F.var_pop("x") * F.count("x")
    within = halves.groupBy((F.col("x") > F.col("mid")).alias("high")).agg(squares.alias("v")).agg(F.sum("v").alias("within"))
    split = within.crossJoin(means.agg(squares.alias("all")))  # one row each
    return one.crossJoin(split.select((1.0 - F.col("within") / F.col("all")).alias("separation")))


@query
def composite_score(spark, d):
    return shown(scoring.composite_score(_summary(spark, d)), "total", digits=4)


@query
def metric_flags(spark, d):
    return shown(scoring.flags(_summary(spark, d)))


@query
def rubric_grade(spark, d):
    return shown(scoring.rubric(scoring.flags(_summary(spark, d))))


@query
def integrity_score(spark, d):
    return shown(scoring.integrity_score(scoring.flags(_summary(spark, d))))


@query
def certification(spark, d):
    return scoring.certification(scoring.flags(_summary(spark, d)))


@query
def regime_diagnosis(spark, d):
    return scoring.regime(_summary(spark, d))


@query
def outcome_prediction(spark, d):
    return scoring.outcome(_summary(spark, d))


def _halves(spark, d):
    s = li(spark, d)
    return s.where("l_returnflag = 'R'"), s.where("l_returnflag <> 'R'")


@query
def kl_marginals(spark, d):
    return shown(compare.kl_marginals(*_halves(spark, d), LINE_DIMS), digits=5)


@query
def coverage_overlap(spark, d):
    return shown(compare.coverage_overlap(*_halves(spark, d), LINE_DIMS))


@query
def range_overlap(spark, d):
    return shown(compare.range_overlap(*_halves(spark, d), LINE_DIMS))


@query
def transfer_level(spark, d):
    return shown(compare.transfer_level(compare.coverage_overlap(*_halves(spark, d), LINE_DIMS)))


@query
def exact_leakage(spark, d):
    docs = table(spark, d, "documents")
    return compare.exact_leakage(docs.where("source <> 'src0'"), docs.where("source = 'src0'").withColumnRenamed("doc_id", "held_id"), "doc_id", "held_id")


@query
def duplicate_episodes(spark, d):
    return compare.duplicates(table(spark, d, "documents"), "doc_id")


@query
def resampled_fingerprint(spark, d):
    return shown(compare.resampled(ev(spark, d)), digits=5)


def _pairs(spark, d):
    return sft.gate(sft.fingerprint(turns(table(spark, d, "conversations"))))


@query
def sft_gate(spark, d):
    return shown(_pairs(spark, d))


@query
def document_fingerprint(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.col("text").alias("output"))
    return shown(sft.gate(sft.fingerprint(docs)).drop("turn"))


@query
def sft_outcome(spark, d):
    return scoring.outcome(sft.aggregate(_pairs(spark, d)), scoring.SFT_OUTCOME)


@query
def wilson_interval(spark, d):
    labels = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    g = labels.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("k"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return shown(g.select("source", "n", "k", lo.alias("low"), hi.alias("high")))


@query
def weighted_precision(spark, d):
    """Precision and recall of a detector against labels, weighted by the inverse of how likely a row was looked at."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") < 1000).alias("fires"))
    r = table(spark, d, "labels").join(docs, "doc_id").withColumns({"bad": F.col("quality") == 0, "w": F.when(F.col("fires"), 1.0).otherwise(4.0)})
    s = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0))
    return shown(r.agg((s(F.col("fires") & F.col("bad")) / s(F.col("fires"))).alias("precision"), (s(F.col("fires") & F.col("bad")) / s(F.col("bad"))).alias("recall")))


@query
def episode_offsets(spark, d):
    n = li(spark, d).where("ep % 3 <> 0").groupBy(F.col("ep").alias("episode_index")).agg(F.count("*").alias("length"))
    return export.episode_offsets(n)


@query
def watch_verdicts(spark, d):
    """The streaming plan's judgement, run over a batch."""
    return watch.verdicts(figures(spark, d).select("ep", "spike_rate", "disc_rate", "dropout", "ldlj")).select("ep", "verdict", "metric")


@query
def standalone_kinematics(spark, d):
    return shown(dynamics.tracking_and_sigma_jerk(ev(spark, d)))


@query
def transition_dynamics(spark, d):
    return shown(dynamics.transition_errors(ev(spark, d)), digits=4)


@query
def failure_diagnosis(spark, d):
    f, cols = _features(spark, d)
    return shown(dynamics.failure_diagnosis(f.where("ep <> 1"), f.where("ep = 1"), cols), digits=5)


@query
def similar_outcomes(spark, d):
    return shown(dynamics.similar_outcomes(figures(spark, d), _summary(spark, d)), digits=5)


@query
def outlier_concentration(spark, d):
    f = figures(spark, d)
    return shown(dynamics.concentration(stats.mad_outliers(stats.long_metrics(f, METRICS), floor={"jitter_cv": 0.01}), f.count()))


@query
def cure_interpolate(spark, d):
    return shown(dynamics.interpolate(ev(spark, d)), digits=3)


@query
def corrupt_drop(spark, d):
    return dynamics.drop_steps(ev(spark, d), 0.2)


@query
def dataset_comparison(spark, d):
    m = _long(spark, d)
    return shown(dynamics.compare_datasets(m.where("ep % 2 = 0"), m.where("ep % 2 = 1"), METRICS))


@query
def approx_coreset(spark, d):
    v, cols = _vectors(spark, d)
    return selection.k_center(v, cols, 20, part=200)


def _knn(spark, d):
    v, cols = _vectors(spark, d)
    return neighbours.nearest(v, v, cols, exclude_self=True)


@query
def embedding_outliers(spark, d):
    """Vectors whose nearest neighbour is far, by the median and its deviation."""
    m = _knn(spark, d).select("ep", F.lit("distance").alias("metric"), F.col("distance").alias("value"))
    return shown(stats.mad_outliers(m), digits=4)


from . import analysis, extended, reporting  # noqa: E402, F401  (they register their queries and build on the ones above)
