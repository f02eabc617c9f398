"""Rules over few rows: which policies a dataset suits, what a report's flags
come to, and how two datasets go together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import in_order, median, rounded

#: For each policy the steps that an episode needs, the share of
#: short ones for a warning and for worse, hertz, action dimensions, cameras, episodes,
#: annotated share for worse and for fine, least entropy and smoothness.
POLICIES = {
    "gr00t": {"steps": 16, "short": (0.0, 0.20), "hz": (15.0, 120.0), "dims": (7, 8, 14, 16), "language": (0.50, 0.99)},
    "pi0": {"steps": 50, "short": (0.10, None), "hz": (10.0, 100.0), "dims": (7, 14), "language": (0.50, 1.0), "ldlj": -15.0},
    "openvla": {"steps": 10, "short": (0.05, None), "hz": (3.0, 30.0), "dims": (7,), "language": (0.50, 1.0), "cameras": 1, "entropy": 2.0},
    "octo": {"steps": 5, "short": (0.0, 0.50), "hz": (5.0, 100.0), "dims": (7, 14), "language": (None, 1.0), "cameras": 2, "episodes": 50},
}

#: Terms that put a metric into a dimension, in this order, and the dimensions' weights.
DIMENSION_TERMS = {
    "temporal_integrity": ("timestamp", "jitter", "dropout", "lag", "sync", "align", "temporal"),
    "motion_quality": ("ldlj", "jerk", "velocity_discontinuity", "vel_disc", "smoothness", "divergence"),
    "behavioral_coverage": ("entropy", "ssl", "novelty", "coverage", "diversity", "embed"),
}
DIMENSION_WEIGHTS = {"temporal_integrity": 0.30, "motion_quality": 0.30, "behavioral_coverage": 0.20, "task_integrity": 0.20}

#: The same for the health score's categories.
HEALTH_TERMS = {
    "quality": ("ldlj", "jerk", "velocity_discontinuity", "smoothness", "action"),
    "synchrony": ("timestamp", "jitter", "dropout", "contact", "sync", "temporal"),
    "coverage": ("ssl", "novelty", "coverage", "diversity", "outlier"),
}

#: Metrics of the integrity layer, and those of them that only ask for a look.
INTEGRITY = (
    "timestamp_jitter_cv", "timestamp_dropout_rate", "timestamp_non_monotonic", "timestamp_scale_mismatch", "action_obs_misalignment",
    "camera_physics_drift", "action_dropout_rate", "short_episode_fraction", "duplicate_episode_fraction", "duplicate_frame_rate",
    "camera_freeze_events", "blurry_episode_fraction", "camera_view_name_mismatch", "jerk_spike_rate", "velocity_discontinuity_rate",
    "joint_offset_max_abs",
)
REVIEW_ONLY = ("jerk_spike_rate", "velocity_discontinuity_rate", "joint_offset_max_abs")

#: Whether a metric should rise or fall, by the first term that it contains.
DIRECTIONS = (
    ("ldlj", "up_better"), ("action_entropy", "up_better"), ("state_entropy", "up_better"), ("timestamp_jitter_cv", "down_better"),
    ("timestamp_dropout_rate", "down_better"), ("jerk_spike_rate", "down_better"), ("velocity_discontinuity_rate", "down_better"),
    ("pca_top2_variance_fraction", "down_better"), ("short_episode_fraction", "down_better"), ("trajectory_diversity", "down_better"),
    ("camera_lag_std", "down_better"), ("action_obs_misalignment", "down_better"), ("contact_density", "ambiguous"),
    ("grasp_events_per_episode", "ambiguous"), ("episode_length_distribution", "ambiguous"),
)


def episode_rates(steps: DataFrame) -> DataFrame:
    """(ep, n_steps, hz, hz_forward): one over the median interval, of all and of the positive ones."""
    dt = F.col("t") - F.lag("t").over(in_order())
    g = steps.withColumn("dt", dt).groupBy("ep").agg(F.count("*").alias("n_steps"), median("dt").alias("d"), median(F.when(F.col("dt") > 0, F.col("dt"))).alias("f"))
    return g.select("ep", "n_steps", F.when(F.col("d") > 0, 1 / F.col("d")).alias("hz"), F.when(F.col("f") > 0, 1 / F.col("f")).alias("hz_forward"))


def compatibility(episodes: DataFrame, dims: int, cameras: int, figures: dict[str, Column | float | None] | None = None) -> DataFrame:
    """(policy, check, value, level) for each policy of POLICIES.

    ``episodes``: (ep, n_steps, hz, hz_forward, task); ``figures``: the
    dataset's entropy (bits a dimension) and ldlj, a check of which is left out without them.
    """
    figures = figures or {}
    facts = [F.count("*").alias("n"), F.avg((F.coalesce(F.trim("task"), F.lit("")) != "").cast("double")).alias("language"), median("hz").alias("gr00t_hz"), F.avg("hz_forward").alias("mean_hz")]
    facts += [F.avg((F.col("n_steps") < p["steps"]).cast("double")).alias(f"{k}_short") for k, p in POLICIES.items()]
    one = episodes.agg(*facts)
    rows = []

    def add(policy: str, check: str, value: Column, level: Column) -> None:
        rows.append(F.struct(F.lit(policy).alias("policy"), F.lit(check).alias("check"), value.cast("double").alias("value"), level.alias("level")))

    for k, p in POLICIES.items():
        add(k, "visual", F.lit(float(cameras > 0)), F.lit("OK" if cameras > 0 else "CRITICAL"))
        bad, fine = p["language"]
        low = F.lit(False) if bad is None else F.col("language") < bad
        add(k, "language", F.col("language"), F.when(F.col("language") >= fine, "OK").when(low, "CRITICAL").otherwise("WARNING"))
        some, many = p["short"]
        worse = F.lit(False) if many is None else F.col(f"{k}_short") > many
        add(k, "episode_length", F.col(f"{k}_short"), F.when(worse, "CRITICAL").when(F.col(f"{k}_short") > some, "WARNING").otherwise("OK"))
        hz = F.col("gr00t_hz" if k == "gr00t" else "mean_hz")
        add(k, "frequency", hz, F.when(hz.isNull(), "INFO").when(hz.between(*p["hz"]), "OK").otherwise("WARNING"))
        add(k, "action_dim", F.lit(dims), F.lit("OK" if dims in p["dims"] else "INFO" if k == "gr00t" else "WARNING"))
        if "cameras" in p and cameras > 0:
            add(k, "cameras", F.lit(cameras), F.lit("WARNING" if cameras > p["cameras"] else "OK"))
        if "episodes" in p:
            add(k, "dataset_size", F.col("n"), F.when(F.col("n") < p["episodes"], "WARNING").otherwise("OK"))
        for name in ("entropy", "ldlj"):
            if name in p and figures.get(name) is not None:
                value = F.lit(figures[name]) if isinstance(figures[name], float) else figures[name]
                add(k, name, value, F.when(value < p[name], "WARNING").otherwise("OK"))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def hints(checks: DataFrame) -> DataFrame:
    """(policy, hint) from the levels of each policy's checks."""
    g = checks.groupBy("policy").agg(F.sum((F.col("level") == "CRITICAL").cast("long")).alias("c"), F.sum((F.col("level") == "WARNING").cast("long")).alias("w"))
    return g.select("policy", F.when(F.col("c") > 0, "not_recommended").when(F.col("w") > 0, "review").otherwise("recommended").alias("hint"))


def containing(metric: Column, terms: dict[str, tuple[str, ...]], otherwise: str) -> Column:
    """The first name of ``terms`` with a term that the lower-cased metric contains."""
    out = F.lit(otherwise)
    for name, words in reversed(terms.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.lower(metric).contains(word)
        out = F.when(hit, name).otherwise(out)
    return out


def level_points(level: Column) -> Column:
    return F.when(level == "CRITICAL", 30.0).when(level == "WARNING", 65.0).when(level == "INFO", 90.0).otherwise(100.0)


def dimension_scores(flags: DataFrame, unscored: tuple[str, ...] = ("ldlj",)) -> DataFrame:
    """(dimension, weight, score, n_flags) of (metric, level); a dimension without flags has 100."""
    own = flags.where(~F.col("metric").isin(*unscored)).select(containing(F.col("metric"), DIMENSION_TERMS, "task_integrity").alias("dimension"), level_points(F.col("level")).alias("points"))
    g = own.groupBy("dimension").agg(F.avg("points").alias("score"), F.count("*").alias("n_flags"))
    known = flags.sparkSession.createDataFrame(list(DIMENSION_WEIGHTS.items()), "dimension string, weight double")
    return known.join(g, "dimension", "left").select("dimension", "weight", F.coalesce("score", F.lit(100.0)).alias("score"), F.coalesce("n_flags", F.lit(0)).alias("n_flags"))


def overall_score(dimensions: DataFrame) -> DataFrame:
    """One row: score (weighted mean) and grade."""
    from .scoring import grade

    g = dimensions.agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("score"))
    return g.select("score", grade(F.col("score")).alias("grade"))


def confidence(flags: DataFrame) -> DataFrame:
    """One row: confidence, from how narrow the flags' intervals (low, high) are beside their values; 0.9 without any."""
    width = F.greatest(F.lit(0.0), 1.0 - (F.col("high") - F.col("low")) / (F.abs("value") + 1e-9))
    return flags.agg(F.round(F.coalesce(F.avg(F.when(F.col("value").isNotNull(), width)), F.lit(0.9)), 3).alias("confidence"))


def health_score(flags: DataFrame) -> DataFrame:
    """(category, score): 100 less 12 and 4 overall, or 20 and 8 in a category, for each critical flag and each warning."""
    named = flags.withColumn("category", containing(F.col("metric"), HEALTH_TERMS, "integrity"))
    off = lambda c, w: F.sum(F.when(F.col("level") == "CRITICAL", c).when(F.col("level") == "WARNING", w).otherwise(0))
    every = named.agg(off(12, 4).alias("off")).select(F.lit("overall").alias("category"), "off")
    own = named.groupBy("category").agg(off(20, 8).alias("off"))
    known = flags.sparkSession.createDataFrame([(c,) for c in ("overall", *HEALTH_TERMS, "integrity")], "category string")
    return known.join(every.unionByName(own), "category", "left").select("category", F.greatest(F.lit(0), 100 - F.coalesce("off", F.lit(0))).cast("long").alias("score"))


def actions(flags: DataFrame, policy: dict[str, str] | None = None) -> DataFrame:
    """(metric, level, integrity, action): informational, inspect or block;
    ``policy`` says it for critical flags of the metrics that it names."""
    critical = F.when(F.col("metric").isin(*REVIEW_ONLY), "inspect").otherwise("block")
    for name, action in (policy or {}).items():
        critical = F.when(F.col("metric") == name, action).otherwise(critical)
    action = F.when(F.col("level") == "OK", "informational").when(F.col("level") == "WARNING", "inspect").otherwise(critical)
    member = F.col("metric").isin(*INTEGRITY) | F.col("metric").startswith("camera_lag_std[")
    return flags.select("metric", "level", member.alias("integrity"), action.alias("action"))


def ci_verdict(acted: DataFrame, strict: bool = False) -> DataFrame:
    """One row: result (Passed or Failed), n_critical, n_blocking over the integrity flags."""
    critical = (F.col("level") == "CRITICAL") & F.col("integrity")
    g = acted.agg(F.coalesce(F.sum(critical.cast("long")), F.lit(0)).alias("n_critical"), F.coalesce(F.sum((critical & (F.col("action") == "block")).cast("long")), F.lit(0)).alias("n_blocking"))
    failed = (F.col("n_blocking") > 0) | (F.lit(strict) & (F.col("n_critical") > 0))
    return g.select(F.when(failed, "Failed").otherwise("Passed").alias("result"), "n_critical", "n_blocking")


def direction(metric: Column, delta: Column) -> Column:
    """improved, degraded or ambiguous for a metric that changed by ``delta``."""
    rule = F.lit("ambiguous")
    for term, x in reversed(DIRECTIONS):
        rule = F.when(F.lower(metric).contains(term), x).otherwise(rule)
    up = F.when(delta > 0, "improved").otherwise("degraded")
    down = F.when(delta > 0, "degraded").otherwise("improved")
    return F.when((delta == 0) | (rule == "ambiguous"), "ambiguous").when(rule == "up_better", up).otherwise(down)


def drift_level(direction_: Column, significant: Column, candidate_level: Column) -> Column:
    return F.when(~significant, "INFO").when(direction_ == "improved", "OK").when(direction_ == "degraded", candidate_level).otherwise("INFO")


def compare_reports(baseline: DataFrame, candidate: DataFrame, tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(metric, baseline, candidate, delta, relative_change, p_value, significant,
    direction, level): the flags (metric, value, level, and low and high if known) that
    both reports have, side by side.

    ``tests`` (metric, p_value) says which changes are significant; for metrics without
    one it is whether the intervals are apart.  A significant change for the worse has the candidate's level.
    """
    ends = lambda df, s: df.select("metric", F.col("value").alias(f"{s}_value"), F.col("level").alias(f"{s}_level"), *[(F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(f"{s}_{c}") for c in ("low", "high")])
    d = ends(baseline, "b").join(ends(candidate, "c"), "metric").where("b_value is not null and c_value is not null").join(tests.select("metric", "p_value"), "metric", "left")
    delta = F.col("c_value") - F.col("b_value")
    apart = F.coalesce((F.col("b_high") < F.col("c_low")) | (F.col("c_high") < F.col("b_low")), F.lit(False))
    d = d.withColumns({"delta": delta, "significant": F.when(F.col("p_value").isNotNull(), F.col("p_value") < alpha).otherwise(apart)})
    d = d.withColumn("direction", direction(F.col("metric"), F.round("delta", 9)))
    relative = F.when(F.abs("b_value") > 1e-12, F.col("delta") / F.abs("b_value"))
    level = drift_level(F.col("direction"), F.col("significant"), F.col("c_level"))
    return d.select("metric", F.col("b_value").alias("baseline"), F.col("c_value").alias("candidate"), "delta", relative.alias("relative_change"), "p_value", "significant", "direction", level.alias("level"))


#: Where a reference profile has the six headline figures, and the definition of smoothness that they may be compared under.
REFERENCE_METRICS = {
    "jitter_cv": ("temporal_stability", "jitter.mean_cv"),
    "dropout_rate": ("temporal_stability", "dropout.mean_dropout_fraction"),
    "ldlj": ("control_smoothness", "ldlj.mean_ldlj"),
    "spike_rate": ("control_smoothness", "jerk_spikes.mean_spike_fraction"),
    "vel_disc_rate": ("control_smoothness", "vel_discontinuities.mean_disc_fraction"),
    "action_entropy": ("coverage_entropy", "action_entropy.entropy_bits_per_dim"),
}
LDLJ_DEFINITION = "per_submovement_v1"


def reference_metrics(profiles: DataFrame, json_col: str = "profile") -> DataFrame:
    """``profiles`` with the six headline figures of their JSON (a column); what is
    missing is null, and so is smoothness under another definition."""
    part = "map<string,map<string,double>>"
    read = F.from_json(json_col, f"meta map<string,string>, aggregate_metrics {part}")
    d = profiles.withColumn("_p", read)
    values = {n: F.try_element_at(F.try_element_at("_p.aggregate_metrics", F.lit(a)), F.lit(b)) for n, (a, b) in REFERENCE_METRICS.items()}
    values["ldlj"] = F.when(F.try_element_at("_p.meta", F.lit("ldlj_definition")) == LDLJ_DEFINITION, values["ldlj"])
    return d.withColumns(values).drop("_p")


def ladder(value: Column, direct: float, adapt: float) -> Column:
    return F.when(value.isNull(), "ADAPT").when(value < direct, "DIRECT").when(value < adapt, "ADAPT").otherwise("DIFFICULT")


def range_covered(source: DataFrame, target: DataFrame, source_dims: tuple[str, ...], target_dims: tuple[str, ...]) -> DataFrame:
    """One row: covered, the mean over the dimensions that both have, and that vary
    in the target, of the share of the target's range inside the source's; 0 without any."""
    dims = list(zip(source_dims, target_dims))
    ends = lambda df, names, s: df.agg(*[f(c).cast("double").alias(f"{s}_{n}{i}") for i, c in enumerate(names) for n, f in (("lo", F.min), ("hi", F.max))])
    d = ends(source, [a for a, _ in dims], "s").crossJoin(ends(target, [b for _, b in dims], "t"))  # one row each
    parts = []
    for i in range(len(dims)):
        common = F.greatest(F.lit(0.0), F.least(f"t_hi{i}", f"s_hi{i}") - F.greatest(f"t_lo{i}", f"s_lo{i}"))
        parts.append(F.when(F.col(f"t_hi{i}") > F.col(f"t_lo{i}"), common / (F.col(f"t_hi{i}") - F.col(f"t_lo{i}"))))
    known = F.array_compact(F.array(*parts))
    return d.select(F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(0.0).alias("covered"))


def transfer(source: DataFrame, target: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """(aspect, level) for action dimensions, frequency, smoothness and episode
    length of two one-row tables (hz, ldlj, mean_length, n_dims), for the action
    range if ``covered`` is given (of ``range_covered``), and the worst as ``overall``.

    Dimensions that can be dropped need adapting; missing ones can't be made up."""
    names = ("hz", "ldlj", "mean_length", "n_dims")
    d = source.select(*[F.col(c).alias(f"s_{c}") for c in names]).crossJoin(target.select(*[F.col(c).alias(f"t_{c}") for c in names]))  # one row each
    ratio = lambda c, least: F.when(F.col(f"s_{c}").isNotNull() & F.col(f"t_{c}").isNotNull(), F.greatest(f"s_{c}", f"t_{c}") / F.greatest(F.least(f"s_{c}", f"t_{c}"), F.lit(least)))
    more = F.col("s_n_dims") - F.col("t_n_dims")
    levels = {
        "action_dims": F.when(more == 0, "DIRECT").when(more > 0, "ADAPT").otherwise("DIFFICULT"),
        "frequency": ladder(ratio("hz", 0.1), 1.5, 3.0),
        "smoothness": ladder(F.abs(F.col("s_ldlj") - F.col("t_ldlj")), 3.0, 8.0),
        "episode_length": ladder(ratio("mean_length", 1.0), 2.0, 5.0),
    }
    if covered is not None:
        d = d.crossJoin(covered)  # one row
        levels["action_range"] = F.when(F.col("covered") >= 0.8, "DIRECT").when(F.col("covered") >= 0.5, "ADAPT").otherwise("DIFFICULT")
    rows = d.select(F.explode(F.array(*[F.struct(F.lit(k).alias("aspect"), x.alias("level")) for k, x in levels.items()])).alias("r")).select("r.*")
    rank = F.when(F.col("level") == "DIFFICULT", 2).when(F.col("level") == "ADAPT", 1).otherwise(0)
    worst = rows.agg(F.max(rank).alias("m")).select(F.lit("overall").alias("aspect"), F.when(F.col("m") == 2, "DIFFICULT").when(F.col("m") == 1, "ADAPT").otherwise("DIRECT").alias("level"))
    return rows.unionByName(worst)


def normal_rate(value: Column) -> Column:
    """Rates over 1 and up to 100 are percent."""
    return F.when((value > 1.0) & (value <= 100.0), value / 100.0).otherwise(value)


def landmark_rank(value: Column, p25: Column, p50: Column, p75: Column, p90: Column, higher_better: bool = True) -> Column:
    """0 to 100 between a community's percentiles, linear in between, 90 beyond the last; null if one is missing."""
    part = lambda a, b, start, width: start + width * (value - a) / F.greatest(b - a, F.lit(1e-9))
    low = F.when(p25 != 0, F.greatest(F.lit(0.0), 25.0 * value / p25)).otherwise(25.0)
    raw = F.when(value <= p25, low).when(value <= p50, part(p25, p50, 25.0, 25.0)).when(value <= p75, part(p50, p75, 50.0, 25.0)).when(value <= p90, part(p75, p90, 75.0, 15.0)).otherwise(90.0)
    known = p25.isNotNull() & p50.isNotNull() & p75.isNotNull() & p90.isNotNull()
    return F.when(known, raw if higher_better else 100.0 - raw)


def headline_scores(assessed: DataFrame) -> DataFrame:
    """(ep, score, redundancy): 100 less the risk in percent, and 1 less the coverage value."""
    return assessed.select("ep", rounded(100.0 * (1.0 - F.col("quality_risk")), 1).alias("score"), (1.0 - F.col("coverage_value")).alias("redundancy"))


def scripted_signature(figures: DataFrame, position: bool = True) -> DataFrame:
    """One row: spike, disc, scripted: many spikes beside hardly any discontinuity, for position control."""
    g = figures.agg(F.avg("spike_rate").alias("spike"), F.avg("disc_rate").alias("disc"))
    return g.select("spike", "disc", (F.lit(position) & (F.col("spike") > 0.10) & (F.col("disc") < 0.015)).alias("scripted"))
