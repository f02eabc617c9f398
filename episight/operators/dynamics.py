"""Dynamics, repairs and corruptions of episodes, and comparisons that rest on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import in_order, norm, share, whole

RIDGE = 1e-4
CLOSE, NEAR = 0.15, 0.30

#: The range of each figure that counts as 0 to 1 when outcomes are compared.
OUTCOME_RANGES = {"ldlj": (-30.0, 0.0), "spike_rate": (0.0, 0.20), "disc_rate": (0.0, 0.40), "dropout": (0.0, 0.20), "jitter_cv": (0.0, 0.50), "entropy": (0.0, 6.0), "contact": (0.0, 0.50)}


def tracking_and_sigma_jerk(steps: DataFrame, gap: float = 0.05, sigmas: float = 5.0, actions: tuple[str, ...] = ("a0",), states: tuple[str, ...] = ("s0",)) -> DataFrame:
    """(ep, tracking_gap, jerk_spikes): share of steps whose action is more than
    ``gap`` from the state, and share of third differences of the state whose size is over
    their mean by ``sigmas`` deviations (0 below 4 steps or without spread)."""
    if len(actions) != len(states):
        raise ValueError("actions and states have as many dimensions")
    w, d = in_order(), steps
    for k in range(3):
        before = states if k == 0 else [f"d{k}_{i}" for i in range(len(states))]
        d = d.withColumns({f"d{k + 1}_{i}": F.col(c) - F.lag(c).over(w) for i, c in enumerate(before)})
    size = lambda parts: F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
    d = d.withColumns({"j": size([F.col(f"d3_{i}") for i in range(len(states))]), "off": size([F.col(a) - F.col(s) for a, s in zip(actions, states)])})
    d = d.withColumns({"jm": F.avg("j").over(whole()), "js": F.stddev_pop("j").over(whole())})
    g = d.groupBy("ep").agg(share(F.col("off") > gap).alias("tracking_gap"), share(F.col("j") > F.col("jm") + sigmas * F.col("js")).alias("spikes"), F.max("js").alias("js"))
    return g.select("ep", "tracking_gap", F.when(F.col("js") > 0, F.col("spikes")).otherwise(F.lit(0.0)).alias("jerk_spikes"))


def _residuals(steps: DataFrame, states: tuple[str, ...], actions: tuple[str, ...], ridge: float) -> tuple[DataFrame, list[Column]]:
    """The steps with their changes d_<state>, and what a linear forecast of them leaves; see ``transition_errors``."""
    import numpy as np

    w, x = in_order(), (*states, *actions)
    d = steps.withColumns({f"d_{c}": F.lead(c).over(w) - F.col(c) for c in states})
    total = lambda a, b: F.coalesce(F.sum(F.when(F.col(f"d_{states[0]}").isNotNull(), F.col(a) * F.col(b))), F.lit(0.0))
    row = d.agg(*[total(a, b).alias(f"{a}_{b}") for a in x for b in (*x, *[f"d_{c}" for c in states])]).first()
    m = np.array(list(row), float).reshape(len(x), -1)
    fit = np.linalg.solve(m[:, : len(x)] + ridge * np.eye(len(x)), m[:, len(x) :])
    return d, [F.col(f"d_{c}") - sum((F.col(a) * float(fit[i, j]) for i, a in enumerate(x)), F.lit(0.0)) for j, c in enumerate(states)]


def transition_errors(steps: DataFrame, states: tuple[str, ...] = ("s0",), actions: tuple[str, ...] = ("a0",), ridge: float = RIDGE) -> DataFrame:
    """(ep, error): mean distance of the next state from a linear forecast out of
    state and action that all episodes share; 0 below 2 steps.

    The normal equations are sums, added up before the shuffle; a matrix of the
    dimensions is solved on the driver.
    """
    d, off = _residuals(steps, states, actions, ridge)
    return d.groupBy("ep").agg(F.coalesce(F.avg(norm(off)), F.lit(0.0)).alias("error"))


def transition_flag(steps: DataFrame, states: tuple[str, ...] = ("s0",), actions: tuple[str, ...] = ("a0",), ridge: float = RIDGE) -> DataFrame:
    """(metric, value, level): the root of the mean squared residual of the forecast
    over all steps and dimensions, a note; no row without transitions."""
    d, off = _residuals(steps, states, actions, ridge)
    squares = sum((r * r for r in off), F.lit(0.0)) / float(len(off))
    g = d.agg(F.sqrt(F.avg(squares)).alias("value")).where("value is not null")
    return g.select(F.lit("dynamics_prediction_rmse").alias("metric"), "value", F.lit("INFO").alias("level"))


def failure_diagnosis(features: DataFrame, failure: DataFrame, cols: list[str]) -> DataFrame:
    """One row: nearest, distance, n_close, n_near, verdict, to_collect of a
    failed episode (one row of the same, equally scaled columns) against all
    training episodes."""
    f = failure.select(*[F.col(c).alias(f"f_{c}") for c in cols])
    total = sum(((F.col(c) - F.col(f"f_{c}")) ** 2 for c in cols), F.lit(0.0))
    d = features.crossJoin(F.broadcast(f.limit(1))).withColumn("d", F.sqrt(total))  # one row
    g = d.agg(F.min(F.struct("d", "ep")).alias("m"), F.sum((F.col("d") < CLOSE).cast("long")).alias("n_close"), F.sum((F.col("d") < NEAR).cast("long")).alias("n_near"))
    verdict = F.when(F.col("n_close") >= 3, "COVERED").when(F.col("n_near") >= 1, "PARTIAL").otherwise("MISSING")
    collect = F.when(F.col("n_close") >= 3, 0).when(F.col("n_near") >= 1, F.greatest(F.lit(0), 5 - F.col("n_close"))).otherwise(8)
    return g.select(F.col("m.ep").alias("nearest"), F.col("m.d").alias("distance"), "n_close", "n_near", verdict.alias("verdict"), collect.cast("long").alias("to_collect"))


def unit(metric: str) -> Column:
    """A figure on the outcomes' scale; a missing one is in the middle."""
    lo, hi = OUTCOME_RANGES[metric]
    x = (F.col(metric) - lo) / (hi - lo)
    return F.when(F.col(metric).isNull(), F.lit(0.5)).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def similar_outcomes(records: DataFrame, query: DataFrame, k: int = 5, max_distance: float = 0.4, policy: str | None = None) -> DataFrame:
    """(ep, distance): the ``k`` recorded outcomes nearest to one row of figures
    within ``max_distance``; those of the same policy count as nearer by 0.7."""
    known = [m for m in OUTCOME_RANGES if m in records.columns and m in query.columns]
    q = query.select(*[unit(m).alias(f"q_{m}") for m in known]).limit(1)
    total = sum(((F.col(f"u_{m}") - F.col(f"q_{m}")) ** 2 for m in known), F.lit(0.0))
    d = records.withColumns({f"u_{m}": unit(m) for m in known}).crossJoin(F.broadcast(q)).withColumn("distance", F.sqrt(total))  # one row
    if policy is not None and "policy" in records.columns:
        d = d.withColumn("distance", F.when(F.col("policy") == policy, 0.7 * F.col("distance")).otherwise(F.col("distance")))
    return d.where(F.col("distance") <= max_distance).orderBy(F.round("distance", 9), "ep").limit(k).select("ep", "distance")


def concentration(outliers: DataFrame, n_episodes: int) -> DataFrame:
    """One row: n_episodes, n_flags, top5_share, position (start, end or spread)
    of the flags (ep, metric)."""
    per = outliers.groupBy("ep").agg(F.count("*").alias("n"))
    top = per.orderBy(F.desc("n"), "ep").limit(5).agg(F.sum("n").alias("top"))
    first, last = int(n_episodes * 0.10), int(n_episodes * 0.90)
    g = per.agg(F.count("*").alias("n_episodes"), F.sum("n").alias("n_flags"), F.sum((F.col("ep") <= first).cast("long")).alias("s"), F.sum((F.col("ep") >= last).cast("long")).alias("e"))
    one = g.crossJoin(F.broadcast(top))  # one row each
    crowded = lambda c: (F.col(c) >= 2) & (F.col(c) / F.col("n_episodes") >= 0.30)
    return one.select("n_episodes", "n_flags", (F.col("top") / F.col("n_flags")).alias("top5_share"), F.when(crowded("s"), "start").when(crowded("e"), "end").otherwise("spread").alias("position"))


def interpolate(steps: DataFrame, column: str = "a0", target_hz: float | None = None) -> DataFrame:
    """(ep, i, value): the column at even times from the first to the last one,
    as many as ``target_hz`` (or one over the mean interval) gives, linear
    between steps.  Each step gives the points up to the next one, so nothing
    is joined; of a clock that stands or goes back no points come, and episodes of fewer than two points give none."""
    w = in_order()
    d = steps.withColumns({"next_t": F.lead("t").over(w), "next": F.lead(column).over(w), "t0": F.min("t").over(whole()), "t1": F.max("t").over(whole()), "n": F.count("*").over(whole())})
    hz = F.lit(float(target_hz)) if target_hz else 1.0 / F.greatest((F.col("t1") - F.col("t0")) / (F.col("n") - 1), F.lit(1e-5))
    d = d.where("n >= 2").withColumn("m", F.bround((F.col("t1") - F.col("t0")) * hz).cast("long") + 1).where("m >= 2 and t1 > t0")
    d = d.withColumn("every", (F.col("t1") - F.col("t0")) / (F.col("m") - 1))
    last = F.col("next_t").isNull()
    lo, hi = F.ceil((F.col("t") - F.col("t0")) / F.col("every")), F.ceil((F.col("next_t") - F.col("t0")) / F.col("every")) - 1
    d = d.withColumns({"lo": F.when(last, F.col("m") - 1).otherwise(lo), "hi": F.when(last, F.col("m") - 1).otherwise(F.least(hi, F.col("m") - 2))})
    d = d.where("lo <= hi and (next_t is null or next_t > t)").withColumn("i", F.explode(F.sequence("lo", "hi")))
    at = F.col("t0") + F.col("i") * F.col("every")
    value = F.when(F.col("next_t").isNull(), F.col(column)).otherwise(F.col(column) + (F.col("next") - F.col(column)) * (at - F.col("t")) / (F.col("next_t") - F.col("t")))
    return d.select("ep", "i", value.alias("value"))


def drop_steps(steps: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """(ep, step): what is left when a share ``rate`` of each episode's steps is
    dropped by a hash of step and seed; at least 2 stay."""
    key = F.md5(F.concat_ws("|", F.col("ep").cast("string"), F.col("step").cast("string"), F.lit(str(seed))))
    d = steps.select("ep", "step", key.alias("key"))
    place = F.row_number().over(Window.partitionBy("ep").orderBy("key", "step"))
    d = d.withColumns({"place": place, "n": F.count("*").over(whole())})
    return d.where(F.col("place") <= F.greatest(F.lit(2), F.floor(F.col("n") * (1.0 - rate)))).select("ep", "step")


def bootstrap_means(m: DataFrame, draws: int = 1000, level: float = 0.95) -> DataFrame:
    """(metric, mean, low, high) of (ep, metric, value): percentiles of means
    over resampled episodes.

    An episode's weight in a draw is Poisson with mean 1, from a hash of
    both, so each draw is a sum that tasks add up before the shuffle.
    """
    d = m.where("value is not null").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = (F.pmod(F.xxhash64("ep", "draw"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weight, below, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(12):
        below += p
        weight = weight + (u >= below).cast("int")
        p /= k + 1
    d = d.withColumn("w", weight)
    means = d.groupBy("metric", "draw").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("x"))
    tail = (1 - level) / 2
    ci = means.groupBy("metric").agg(F.percentile("x", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return m.groupBy("metric").agg(F.avg("value").alias("mean")).join(ci, "metric").select("metric", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def permutation_tests(a: DataFrame, b: DataFrame, permutations: int = 199, seed: int = 42, least: int = 4) -> DataFrame:
    """(metric, delta, p_value): difference of the means of two sets of (ep,
    metric, value), and the share of random splits of both together, of the same
    sizes, with one as large; 1 if either has fewer than ``least`` values.

    A split is the order of a hash of episode, set and number.  Tasks add up counts
    and sums by the hashes' first digits, so that of each split only the
    rows are sorted whose digits are those at which it is cut, one in 256.
    """
    both = a.where("value is not null").withColumn("side", F.lit("a")).unionByName(b.where("value is not null").withColumn("side", F.lit("b")))
    is_a = F.col("side") == "a"
    seen = both.groupBy("metric").agg(F.count(F.when(is_a, 1)).alias("na"), F.count(F.when(~is_a, 1)).alias("nb"), F.sum("value").alias("total"), (F.avg(F.when(~is_a, F.col("value"))) - F.avg(F.when(is_a, F.col("value")))).alias("delta"))
    d = both.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), "side", F.col("ep").cast("string")))
    d = d.select("metric", "draw", "ep", "value", key.alias("key")).withColumn("digits", F.substring("key", 1, 2))
    bins = d.groupBy("metric", "draw", "digits").agg(F.count("*").alias("c"), F.sum("value").alias("s"))
    w = Window.partitionBy("metric", "draw").orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows a split
    bins = bins.withColumns({"c0": F.coalesce(F.sum("c").over(w), F.lit(0)), "s0": F.coalesce(F.sum("s").over(w), F.lit(0.0))}).join(F.broadcast(seen), "metric")  # a row a metric
    cut = bins.where((F.col("c0") < F.col("na")) & (F.col("c0") + F.col("c") >= F.col("na"))).select("metric", "draw", "digits", (F.col("na") - F.col("c0")).alias("more"), "s0")
    edge = d.join(F.broadcast(cut), ["metric", "draw", "digits"])  # a row a split
    edge = edge.withColumn("place", F.row_number().over(Window.partitionBy("metric", "draw").orderBy("key", "ep"))).where(F.col("place") <= F.col("more"))
    sums = edge.groupBy("metric", "draw").agg((F.first("s0") + F.sum("value")).alias("sa")).join(F.broadcast(seen), "metric")
    null = (F.col("total") - F.col("sa")) / F.col("nb") - F.col("sa") / F.col("na")
    p = sums.where("na > 0 and nb > 0").groupBy("metric").agg(F.avg((F.abs(null) >= F.abs("delta") - 1e-12).cast("double")).alias("p"))
    enough = (F.col("na") >= least) & (F.col("nb") >= least)
    return seen.join(p, "metric", "left").select("metric", F.coalesce("delta", F.lit(0.0)).alias("delta"), F.when(enough, F.col("p")).otherwise(1.0).alias("p_value"))


def compare_datasets(a: DataFrame, b: DataFrame, lower_better: tuple[str, ...], draws: int = 1000) -> DataFrame:
    """(metric, baseline, candidate, delta, significant, direction): means of two
    sets of (ep, metric, value); significant where the intervals are apart."""
    x, y = bootstrap_means(a, draws), bootstrap_means(b, draws)
    d = x.select("metric", F.col("mean").alias("baseline"), F.col("low").alias("la"), F.col("high").alias("ha")).join(y.select("metric", F.col("mean").alias("candidate"), F.col("low").alias("lb"), F.col("high").alias("hb")), "metric")
    delta = F.col("candidate") - F.col("baseline")
    better = F.when(F.col("metric").isin(*lower_better), delta < 0).otherwise(delta > 0)
    direction = F.when(F.abs(delta) < 1e-12, "unchanged").when(better, "improved").otherwise("degraded")
    return d.select("metric", "baseline", "candidate", delta.alias("delta"), ((F.col("ha") < F.col("lb")) | (F.col("hb") < F.col("la"))).alias("significant"), direction.alias("direction"))


def standalone_figures(steps: DataFrame, dims: tuple[str, ...], bins: int = 50) -> DataFrame:
    """(ep, ldlj, entropy, jitter_cv, dropout): the estimators that stand alone:
    jerk over the whole trajectory with duration n * dt, mean bits a dimension in
    ``bins`` of each episode's own range, and clock figures from two stamps on."""
    w = in_order()
    d = steps.withColumn("dt", F.col("t") - F.lag("t").over(w)).withColumn("every", F.percentile("dt", F.lit(0.5)).over(whole()))
    for k, (old, new) in enumerate((("", "v_"), ("v_", "a_"), ("a_", "j_"))):
        d = d.withColumns({f"{new}{c}": (F.col(f"{old}{c}") - F.lag(f"{old}{c}").over(w)) / F.col("every") for c in dims})
    n = F.count("*")
    g = d.groupBy("ep").agg(
        n.alias("n"), F.max("every").alias("every"), F.max(norm([f"v_{c}" for c in dims])).alias("top"), F.sum(norm([f"j_{c}" for c in dims]) ** 2).alias("jj"),
        (F.stddev_pop("dt") / F.avg("dt")).alias("cv"), share(F.col("dt") > 3.0 * F.col("every")).alias("drop"), F.avg("dt").alias("mean"),
    )
    inner = F.pow(F.col("n") * F.col("every"), F.lit(3.0)) / (F.col("top") * F.col("top")) * F.col("jj") * F.col("every")
    ldlj = F.when((F.col("n") >= 5) & (F.col("every") > 0) & (F.col("top") > 1e-12) & (inner > 0), -F.log(inner))
    long = steps.unpivot(["ep"], list(dims), "dim", "value")
    own = Window.partitionBy("ep", "dim")
    lo, hi = F.min("value").over(own), F.max("value").over(own)
    cell = long.withColumn("bin", F.when(hi > lo, F.least(F.floor((F.col("value") - lo) / ((hi - lo) / bins)), F.lit(bins - 1))).otherwise(0)).groupBy("ep", "dim", "bin").agg(F.count("*").alias("c"))
    p = cell.withColumn("p", F.col("c") / F.sum("c").over(own))
    bits = p.groupBy("ep", "dim").agg((-F.sum(F.col("p") * F.log2("p"))).alias("bits")).groupBy("ep").agg(F.avg("bits").alias("entropy"))
    clock = F.col("n") >= 2
    return g.join(bits, "ep").select("ep", ldlj.alias("ldlj"), "entropy", F.when(clock & (F.col("mean") > 0), F.col("cv")).alias("jitter_cv"), F.when(clock & (F.col("every") > 0), F.col("drop")).otherwise(0.0).alias("dropout"))


def coherence(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with coherence, the cosine of two embedding columns (arrays); 0 where one has no length."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return pairs.withColumn("coherence", F.when(size > 0, dot(left, right) / size).otherwise(0.0))


def episode_digests(steps: DataFrame, columns: tuple[str, ...], digits: int = 6) -> DataFrame:
    """(ep, digest): 16 hex digits of the columns' values in order of steps, written with so many digits."""
    row = F.concat_ws(",", *[F.coalesce(F.format_string(f"%.{digits}f", F.col(c).cast("double")), F.lit("null")) for c in columns])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", row.alias("r")))), lambda x: x["r"]), ";")
    return steps.groupBy("ep").agg(F.substring(F.sha2(text, 256), 1, 16).alias("digest"))


def content_hashes(steps: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """(ep, hash): 16 hex digits of the SHA-256 of an episode's stamps and then its
    actions, step by step, as little-endian floats of four bytes.

    Steps come sorted by episode; an episode's actions are held, as floats, until its stamps are hashed."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    n = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = steps.select(F.col("ep").cast("long").alias("ep"), F.col("step").cast("long").alias("step"), *[F.col(c).cast("double").cast("float") for c in ("t", *actions)])
    dealt = rows.repartition(n, "ep").sortWithinPartitions("ep", "step").drop("step")

    def run(batches):
        now, stamps, later = None, None, []

        def done() -> pa.RecordBatch:
            for part in later:
                stamps.update(part)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([stamps.hexdigest()[:16]])], names=["ep", "hash"])

        for b in batches:
            if not b.num_rows:
                continue
            ep = b.column(0).to_numpy()
            values = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype("<f4") for k in range(1, b.num_columns)], axis=1)
            edges = [0, *(np.flatnonzero(np.diff(ep)) + 1).tolist(), len(ep)]
            for s, e in zip(edges, edges[1:]):
                if ep[s] != now:
                    if now is not None:
                        yield done()
                    now, stamps, later = int(ep[s]), hashlib.sha256(), []
                stamps.update(np.ascontiguousarray(values[s:e, 0]).tobytes())
                later.append(np.ascontiguousarray(values[s:e, 1:]).tobytes())
        if now is not None:
            yield done()

    return dealt.mapInArrow(run, "ep long, hash string")


def batch_fingerprint(digests: DataFrame, policy: str = "") -> DataFrame:
    """One row: fingerprint (24 hex digits) of all episodes' digests and the policy.

    Digests are hashed in ranges of episodes of a fixed size and the ranges' hashes
    together, so no task holds all of them.
    """
    part = digests.groupBy(F.floor(F.col("ep") / 4096).alias("g")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ep", "digest"))), lambda x: F.concat_ws(":", x["ep"].cast("string"), x["digest"])), ","), 256).alias("h"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ",")
    return part.agg(F.substring(F.sha2(F.concat(text, F.lit("|" + policy)), 256), 1, 24).alias("fingerprint"))
