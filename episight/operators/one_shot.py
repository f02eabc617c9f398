"""One report of a dataset: phases, copies, trust by category, what to keep of
it, outcomes by policy family, and failures traced back to the training data."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import lower_level
from . import coverage, dynamics, neighbours, scoring

#: The trust questions and the metrics that answer them.
CATEGORIES = {
    "Timestamps & sync": ("timestamp_jitter_cv", "timestamp_dropout_rate", "timestamp_non_monotonic", "timestamp_scale_mismatch", "action_obs_misalignment", "camera_physics_drift"),
    "Episode structure": ("action_dropout_rate", "short_episode_fraction", "duplicate_episode_fraction"),
    "Camera feed": ("duplicate_frame_rate", "camera_freeze_events", "blurry_episode_fraction", "camera_view_name_mismatch"),
    "Motion & control": ("jerk_spike_rate", "velocity_discontinuity_rate", "joint_offset_max_abs"),
}
CLOCK_PREFIX = "camera_lag_std["

#: By policy family the bounds that differ from the general ones.
FAMILY_BOUNDS = {
    "act": {"ldlj": (-10.0, -15.0), "spike_rate": (0.005, 0.01), "disc_rate": (0.04, 0.08)},
    "diffusion": {"ldlj": (-20.0, -25.0), "spike_rate": (0.05, 0.10), "disc_rate": (0.15, 0.30)},
    "other": {"ldlj": (-15.0, -25.0), "spike_rate": (0.05, 0.10), "disc_rate": (0.05, 0.15)},
}
ANY_FAMILY_BOUNDS = {"entropy": (2.0, 1.0), "contact": (0.04, 0.02)}

#: Points of success that a bit of entropy is worth, and bits that an episode near a failure adds.
POINTS_A_BIT = 10.0 / 1.5
BITS_AN_EPISODE, MOST_BITS = 0.03, 0.5


# --- flags -----------------------------------------------------------------


def phase_flags(phases: DataFrame, draws: int = 0, level: float = 0.95) -> DataFrame:
    """(metric, value, level) of episodes' approach and contact shares: too little
    contact (at most a tenth; a twentieth is critical) and an approach of over four fifths (a note).

    With ``draws`` the contact share also gets low and high, percentiles of
    resampled means.  No episodes, no flags.
    """
    g = phases.agg(F.avg("contact").alias("c"), F.avg("approach").alias("a")).where("c is not null")
    contact = g.select(F.lit("contact_phase_fraction").alias("metric"), F.col("c").alias("value"), lower_level(F.col("c"), 0.10, 0.05).alias("level"))
    approach = g.select(F.lit("approach_phase_dominance").alias("metric"), F.col("a").alias("value"), F.when(F.col("a") > 0.80, "INFO").otherwise("OK").alias("level"))
    out = contact.unionByName(approach)
    if draws:
        m = phases.select(F.lit("contact_phase_fraction").alias("metric"), "ep", F.col("contact").alias("value"))
        out = out.join(dynamics.bootstrap_means(m, draws, level).drop("mean"), "metric", "left")
    return out


def copies(steps: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(ep, original): episodes whose steps, in order and in all ``columns``, an
    earlier episode has, with the first such one.

    An episode is known by its length and two sums of 64-bit hashes of its
    (step, values) rows, which tasks add up before the shuffle: no episode stands in one row.
    Nulls are values like others; repeated steps count as often as they are there.
    """
    values = [F.struct(F.col(c).isNull(), F.col(c)) for c in ("step", *columns)]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(20,0)"))
    d = steps.groupBy("ep").agg(F.count("*").alias("n"), total(1).alias("h1"), total(2).alias("h2"))
    key = ["n", "h1", "h2"]
    first = d.groupBy(*key).agg(F.min("ep").alias("original"), F.count("*").alias("k")).where("k > 1").drop("k")
    return d.join(first, key).where("ep <> original").select("ep", "original")


def copies_flag(steps: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(metric, value, level): the share of episodes that copy an earlier one; any is critical."""
    n = steps.agg(F.countDistinct("ep").alias("n"))
    k = copies(steps, columns).agg(F.count("*").alias("k"))
    share = F.col("k") / F.greatest(F.col("n"), F.lit(1))
    return n.crossJoin(k).select(F.lit("duplicate_episode_fraction").alias("metric"), share.alias("value"), F.when(F.col("k") > 0, "CRITICAL").otherwise("OK").alias("level"))  # one row each


# --- trust -----------------------------------------------------------------


def category(metric: Column) -> Column:
    """The trust question that a metric belongs to, or null."""
    out = F.when(metric.startswith(CLOCK_PREFIX), "Timestamps & sync")
    for name, metrics in CATEGORIES.items():
        out = out.when(metric.isin(*metrics), name)
    return out


def categories(flagged: DataFrame) -> DataFrame:
    """(category, n_flags, level): every category with its worst level; null if
    nothing of it could be judged (no flags, or notes only)."""
    bad = lambda level: F.bool_or(F.col("level") == level)
    worst = F.when(bad("CRITICAL"), "CRITICAL").when(bad("WARNING"), "WARNING").when(bad("OK"), "OK")
    g = flagged.withColumn("category", category(F.col("metric"))).where("category is not null").groupBy("category").agg(F.count("*").alias("n_flags"), worst.alias("level"))
    names = flagged.sparkSession.createDataFrame([(n,) for n in CATEGORIES], "category string")
    return names.join(g, "category", "left").withColumn("n_flags", F.coalesce("n_flags", F.lit(0)))


def integrity(flagged: DataFrame) -> DataFrame:
    """One row: score and status of the metrics that answer trust questions; notes
    don't count, and 100 and Healthy without any."""
    credit = F.when(F.col("level") == "OK", 1.0).when(F.col("level") == "WARNING", 0.5).when(F.col("level") == "CRITICAL", 0.0)
    g = flagged.where(category(F.col("metric")).isNotNull()).agg(F.coalesce(F.bround(100 * F.avg(credit), 0), F.lit(100.0)).cast("long").alias("score"))
    return g.withColumn("status", F.when(F.col("score") >= 90, "Healthy").when(F.col("score") >= 70, "Warning").otherwise("Critical"))


def keep_fraction(redundancy: Column) -> Column:
    """What to keep of a dataset: as much as isn't redundant, from 0.15 to 0.85; half if that isn't known."""
    return F.when(redundancy.isNull(), 0.5).otherwise(F.bround(F.least(F.greatest(1.0 - redundancy, F.lit(0.15)), F.lit(0.85)), 2))


def one_shot(flagged: DataFrame, redundancy: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row: n_episodes, n_critical, n_warning, score and status of the
    integrity, redundancy (``redundancy``: one row of it) and keep_fraction, which is a half below 5 episodes."""
    count = lambda level: F.coalesce(F.sum((F.col("level") == level).cast("long")), F.lit(0)).alias(f"n_{level.lower()}")
    one = episodes.agg(F.countDistinct("ep").alias("n_episodes"))
    for part in (flagged.agg(count("CRITICAL"), count("WARNING")), integrity(flagged), redundancy.agg(F.max("redundancy").alias("redundancy"))):
        one = one.crossJoin(part)  # one row each
    known = F.when(F.col("n_episodes") >= 5, F.col("redundancy"))
    return one.withColumns({"redundancy": known, "keep_fraction": keep_fraction(known)})


# --- outcomes --------------------------------------------------------------


def family(policy: str) -> str:
    """The family whose bounds a policy's name takes."""
    name = policy.lower()
    return "act" if "act" in name or "pi0" in name else "diffusion" if "diffusion" in name else "other"


def rules(policy: str | None = None, weights: dict[str, float] | None = None) -> dict[str, tuple[float, float, float, float]]:
    """The penalties and bounds of outcomes under a policy.  ``weights`` replaces
    penalties at warning; those at critical keep their ratio to them."""
    bounds = {} if not policy else ANY_FAMILY_BOUNDS | FAMILY_BOUNDS[family(policy)]
    out = {}
    for name, (at_warn, at_crit, warn, crit) in scoring.OUTCOME.items():
        own = (weights or {}).get(name)
        if own is not None:
            at_warn, at_crit = own, round(own * (at_crit / at_warn if at_warn > 0 else 2.0), 2)
        out[name] = (at_warn, at_crit, *bounds.get(name, (warn, crit)))
    return out


def outcomes(figures: DataFrame, policies: tuple[str, ...], scripted: bool = False, weights: dict[str, float] | None = None) -> DataFrame:
    """(policy, score, tier, n_deductions, low, high): the expected outcome under each policy from one row of figures."""
    rows = []
    for p in policies:
        score, hits = scoring.deducted(figures.columns, rules(p, weights), scripted)
        rows.append(F.struct(F.lit(p).alias("policy"), score.alias("score"), hits.alias("n_deductions")))
    return scoring.shown_outcome(figures.select(F.explode(F.array(*rows)).alias("r")).select("r.*"), "policy")


def predicted(figures: DataFrame, records: DataFrame, policy: str | None = None, scripted: bool = False, weights: dict[str, float] | None = None, k: int = 5) -> DataFrame:
    """One row: heuristic, score, weight, tier, low, high: an expected outcome drawn
    towards what datasets with similar figures came to.

    ``records`` (ep, success from 0 to 1, policy if known, and figures).  The nearest
    ``k`` of them count by 1 over their distance; the more and the nearer they are, the
    more they weigh (0.6 at most) and the narrower the range is.  Without any the heuristic stands.
    """
    h = scoring.heuristic(figures, rules(policy, weights), scripted)
    near = dynamics.similar_outcomes(records, figures, k, policy=policy).join(records.select("ep", "success"), "ep").where("success is not null")
    w = 1.0 / (F.col("distance") + 1e-6)
    seen = near.agg(F.count("*").alias("n"), F.min("distance").alias("d"), (F.sum(w * F.col("success") * 100.0) / F.sum(w)).alias("seen"))
    one = h.crossJoin(seen)  # one row each
    weight = F.when(F.col("n") == 0, 0.0).otherwise(0.6 * F.least(F.lit(1.0), F.col("n") / 5.0) * F.greatest(F.lit(0.0), 1.0 - F.col("d") / 0.4))
    one = one.withColumn("w", weight)
    mixed = F.when(F.col("n") == 0, F.col("score")).otherwise(F.round(F.least(F.greatest((1.0 - F.col("w")) * F.col("score") + F.col("w") * F.col("seen"), F.lit(0.0)), F.lit(100.0)), 1))
    one = one.withColumns({"mixed": mixed, "margin": F.least(5.0 + 2.0 * F.col("n_deductions"), F.lit(15.0)) * (1.0 - 0.5 * F.round("w", 3))})
    shown = lambda c: F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0)), 1)
    return one.select(
        F.round("score", 1).alias("heuristic"), shown(F.col("mixed")).alias("score"), F.round("w", 3).alias("weight"), scoring.tier(F.col("mixed")).alias("tier"),
        shown(F.col("mixed") - F.col("margin")).alias("low"), shown(F.col("mixed") + F.col("margin")).alias("high"),
    )


# --- failures --------------------------------------------------------------


def failure_features(failures: DataFrame, dims: tuple[str, ...], training: DataFrame | None = None) -> DataFrame:
    """(ep, m_*, d_*) of failed episodes, scaled by each one's own smallest and
    largest figure, or by the ranges of ``training`` (unscaled features), within 0 to 1."""
    f = coverage.episode_features(failures, dims)
    cols = [c for c in f.columns if c != "ep"]
    if training is None:
        d = f.withColumns({"_lo": F.least(*cols), "_hi": F.greatest(*cols)})
        x = {c: F.coalesce((F.col(c) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.col(c) - F.col("_lo")) for c in cols}
    else:
        span = training.agg(*[g(c).alias(f"{n}_{c}") for c in cols for n, g in (("lo", F.min), ("hi", F.max))])
        d = f.crossJoin(F.broadcast(span))  # one row
        x = {c: F.coalesce((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)), F.col(c) - F.col(f"lo_{c}")) for c in cols}
    return d.select("ep", *[F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)).alias(c) for c, v in x.items()])


def counts_within(failed: DataFrame, training: DataFrame, cols: list[str], close: float, near: float, key: str = "ep", salts: int = 8) -> DataFrame:
    """(key, n_close, n_near): training rows nearer than ``close`` and ``near`` to
    each failure that has any.

    Rows meet in cells as wide as ``near`` of the first three columns, a failure
    in its own and those around it.  Equal training rows are counted first, and a
    cell's are dealt to ``salts`` groups, so that a crowded cell isn't one task's.
    """
    axes = cols[:3]
    cell = lambda c: F.floor(F.col(c) / near)
    known = " and ".join(f"{c} is not null and not isnan({c})" for c in cols)
    t = training.where(known).groupBy(*cols).agg(F.count("*").alias("_n"))
    t = t.select(*[F.col(c).alias(f"t_{c}") for c in cols], "_n", *[cell(c).alias(f"g{i}") for i, c in enumerate(axes)], F.pmod(F.xxhash64(*cols), F.lit(salts)).alias("_salt"))
    around = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(offset)]) for offset in product((-1, 0, 1), repeat=len(axes))])
    f = failed.where(known).select(key, *cols, F.explode(around).alias("_o"))
    f = f.select(key, *cols, *[(cell(c) + F.col(f"_o.o{i}")).alias(f"g{i}") for i, c in enumerate(axes)], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"))
    d = F.sqrt(sum(((F.col(c) - F.col(f"t_{c}")) ** 2 for c in cols), F.lit(0.0)))
    met = f.join(t, [*[f"g{i}" for i in range(len(axes))], "_salt"]).withColumn("d", d).where(F.col("d") < near)
    return met.groupBy(key).agg(F.sum(F.when(F.col("d") < close, F.col("_n")).otherwise(0)).alias("n_close"), F.sum("_n").alias("n_near"))


def diagnose(failed: DataFrame, training: DataFrame, cols: list[str], success: float) -> DataFrame:
    """(ep, nearest, distance, n_close, n_near, verdict, to_collect,
    success_after): whether each failure's surroundings were in the training data, how many
    episodes to collect there, and the success (now ``success``, in percent) to expect of that.

    ``failed`` and ``training``: ep and the scaled columns.  A failure with a null
    or NaN figure has none of them (verdict null); without training data all are MISSING.
    """
    n = neighbours.nearest(failed, training, cols).select("ep", F.col("neighbour").alias("nearest"), (F.col("distance") * len(cols) ** 0.5).alias("distance"))
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    d = failed.select("ep", whole.alias("_whole")).join(n, "ep", "left").join(counts_within(failed, training, cols, dynamics.CLOSE, dynamics.NEAR), "ep", "left")
    d = d.withColumns({c: F.when(F.col("_whole"), F.coalesce(c, F.lit(0))) for c in ("n_close", "n_near")})
    close, near = F.col("n_close"), F.col("n_near")
    verdict = F.when(close >= 3, "COVERED").when(near >= 1, "PARTIAL").when(near == 0, "MISSING")
    collect = F.when(close >= 3, 0).when(near >= 1, F.greatest(F.lit(0), 5 - close)).when(near == 0, 8).cast("long")
    d = d.withColumns({"verdict": verdict, "to_collect": collect})
    gain = F.least(F.lit(MOST_BITS), F.col("to_collect") * BITS_AN_EPISODE) * POINTS_A_BIT
    after = F.when(F.col("to_collect") > 0, F.least(F.lit(success) + gain, F.lit(100.0))).when(F.col("to_collect") == 0, F.lit(success))
    return d.select("ep", "nearest", "distance", "n_close", "n_near", "verdict", "to_collect", F.round(after, 1).alias("success_after"))


def collection_focus(failures: DataFrame, dims: tuple[str, ...], most: int = 8, digits: int = 4) -> DataFrame:
    """(ep, dim, low, high): where to collect for each failure, its mean and one and a half deviations
    (0.05 at least) on each side, of the first ``most`` dimensions."""
    f = coverage.episode_features(failures, dims[:most])
    width = lambda c: 1.5 * F.greatest(F.col(f"d_{c}"), F.lit(0.05))
    rows = F.array(*[F.struct(F.lit(c).alias("dim"), (F.col(f"m_{c}") - width(c)).alias("low"), (F.col(f"m_{c}") + width(c)).alias("high")) for c in dims[:most]])
    return f.select("ep", F.explode(rows).alias("r")).select("ep", "r.dim", F.round("r.low", digits).alias("low"), F.round("r.high", digits).alias("high"))
