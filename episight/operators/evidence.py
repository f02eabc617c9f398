"""Tables of reviewed findings, recorded experiments and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The retention levels (percent) that a protocol asks for under each condition.
PROTOCOL = ((100.0, "full"), *((p, c) for p in (75.0, 50.0, 25.0) for c in ("random", "selected")))


def precision_table(findings: DataFrame) -> DataFrame:
    """(detector, n_reviewed, true_corruption_rate, unusual_valid_rate, ambiguous_rate, datasets) of (detector, dataset, characterization)."""
    rate = lambda x: F.avg((F.col("characterization") == x).cast("double"))
    return findings.groupBy("detector").agg(
        F.count("*").alias("n_reviewed"), rate("true_corruption").alias("true_corruption_rate"), rate("unusual_valid").alias("unusual_valid_rate"),
        rate("ambiguous").alias("ambiguous_rate"), F.array_join(F.array_sort(F.collect_set("dataset")), ",").alias("datasets"),
    )


def retention_table(records: DataFrame) -> DataFrame:
    """(experiment_id, retention_pct, condition, record_id, success): the last record of each cell."""
    last = F.max(F.struct("recorded", "record_id", "success")).alias("r")
    return records.groupBy("experiment_id", "retention_pct", "condition").agg(last).select("experiment_id", "retention_pct", "condition", "r.record_id", "r.success")


def missing_cells(records: DataFrame, protocol: tuple[tuple[float, str], ...] = PROTOCOL) -> DataFrame:
    """(experiment_id, retention_pct, condition): what the protocol asks for and no record has."""
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("retention_pct"), F.lit(c).alias("condition")) for p, c in protocol]))
    want = records.select("experiment_id").distinct().select("experiment_id", cells.alias("c")).select("experiment_id", "c.*")
    return want.join(records.select("experiment_id", "retention_pct", "condition").distinct(), ["experiment_id", "retention_pct", "condition"], "left_anti")


def matrix_coverage(records: DataFrame, cell: tuple[str, ...], protocol: tuple[tuple[float, str], ...] = PROTOCOL) -> DataFrame:
    """(cell columns, n_experiments, n_records, n_missing, complete): records of all experiments of a cell count together."""
    have = records.groupBy(*cell).agg(F.countDistinct("experiment_id").alias("n_experiments"), F.countDistinct("retention_pct", "condition").alias("n_records"), F.countDistinct(F.when(asked(protocol), F.struct("retention_pct", "condition"))).alias("met"))
    return have.select(*cell, "n_experiments", "n_records", (F.lit(len(protocol)) - F.col("met")).alias("n_missing"), (F.col("met") == len(protocol)).alias("complete"))


def asked(protocol: tuple[tuple[float, str], ...]) -> Column:
    out = F.lit(False)
    for p, c in protocol:
        out = out | ((F.col("retention_pct") == p) & (F.col("condition") == c))
    return out


def treatment_deltas(records: DataFrame, treatment: str = "selected", control: str = "random") -> DataFrame:
    """(experiment_id, retention_pct, delta): success of the treatment less the control's, null where one is missing; full retention is left out."""
    t = retention_table(records).where("retention_pct <> 100")
    pick = lambda x: F.max(F.when(F.col("condition") == x, F.col("success")))
    return t.groupBy("experiment_id", "retention_pct").agg((pick(treatment) - pick(control)).alias("delta"))


def nearest_retention(records: DataFrame, wanted: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(target_pct, condition, retention_pct, success) for each wanted (target_pct,
    condition): the recorded level nearest within ``tolerance``, the later of equals; nulls without.

    Levels are joined by whole bands of the tolerance and the two beside them.
    """
    band = F.floor(F.col("retention_pct") / tolerance)
    have = records.withColumn("band", band)
    want = wanted.withColumn("band", F.explode(F.sequence(F.floor(F.col("target_pct") / tolerance) - 1, F.floor(F.col("target_pct") / tolerance) + 1)))
    met = want.join(have, ["condition", "band"]).where(F.abs(F.col("retention_pct") - F.col("target_pct")) <= tolerance)
    best = met.groupBy("target_pct", "condition").agg(F.min(F.struct(F.abs(F.col("retention_pct") - F.col("target_pct")).alias("off"), (-F.col("recorded")).alias("late"), "retention_pct", "success")).alias("b"))
    return wanted.join(best, ["target_pct", "condition"], "left").select("target_pct", "condition", F.col("b.retention_pct").alias("retention_pct"), F.col("b.success").alias("success"))


def measured_else_simulated(cells: DataFrame, n_total: int, base_hours: float) -> DataFrame:
    """(condition, n_episodes, hours, success, measured) of (condition, n_episodes, measured_hours, measured_success, simulated): hours go with the episodes."""
    hours = F.coalesce("measured_hours", F.lit(base_hours) * F.col("n_episodes") / n_total)
    return cells.select("condition", "n_episodes", hours.alias("hours"), F.coalesce("measured_success", "simulated").alias("success"), F.col("measured_success").isNotNull().alias("measured"))


def study_status(conditions: DataFrame) -> DataFrame:
    """One row: status validated, partial or simulated, as all, some or none are measured."""
    g = conditions.agg(F.bool_and("measured").alias("a"), F.bool_or("measured").alias("o"))
    return g.select(F.when(F.col("a"), "validated").when(F.col("o"), "partial").otherwise("simulated").alias("status"))


#: Names under which comparisons know a claim's metric, and the states in which a claim counts.
CLAIM_METRICS = {"vel_disc_rate": "velocity_discontinuity_rate", "state_entropy": "action_entropy"}
ACTIVE_CLAIMS = ("active_hypothesis", "validated", "provisional")


def claim_confidence(n_supporting: Column) -> Column:
    """How far a claim is trusted, from the number of pieces of evidence that support it."""
    return F.when(n_supporting <= 0, "NOT VALIDATED").when(n_supporting == 1, "LOW-MODERATE").when(n_supporting <= 4, "MODERATE").when(n_supporting <= 9, "HIGH").otherwise("STRONG")


def judged_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``claims`` (claim_id, metric, class, status) with n_evidence, n_supporting and
    confidence; ``evidence``: (claim_id, supports), null counting as support."""
    n = evidence.groupBy("claim_id").agg(F.count("*").alias("n_evidence"), F.sum(F.coalesce("supports", F.lit(True)).cast("long")).alias("n_supporting"))
    d = claims.join(n, "claim_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_evidence", "n_supporting")})
    return d.withColumn("confidence", claim_confidence(F.col("n_supporting")))


def active_claims(claims: DataFrame, metric: str, class_name: str) -> DataFrame:
    """The claims in force for a metric (as comparisons name it) and a class, and
    those for any class; specific ones are marked."""
    d = claims.where((F.col("metric") == CLAIM_METRICS.get(metric, metric)) & F.col("status").isin(*ACTIVE_CLAIMS) & F.col("class").isin(class_name, "any"))
    return d.withColumn("specific", F.col("class") == class_name)


def lookup_baseline(profiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(detector, dataset, task_family, rate, source) for each wanted (detector,
    dataset, task_family): the profile of the dataset itself, else of its task family, of
    most episodes; nulls if there is neither.  Another task never stands in."""
    p = profiles.select("detector", F.col("dataset").alias("p_dataset"), F.col("task_family").alias("p_family"), "rate", "n_episodes")
    # one row a (detector, dataset) and a (detector, family), so that the joins keep the rows
    best = lambda by: p.groupBy("detector", by).agg(F.max(F.struct("n_episodes", F.col("rate").alias("rate"))).alias("b"))
    a = best("p_dataset").select("detector", F.col("p_dataset").alias("dataset"), F.col("b.rate").alias("own"))
    b = best("p_family").select("detector", F.col("p_family").alias("task_family"), F.col("b.rate").alias("family"))
    d = wanted.join(a, ["detector", "dataset"], "left").join(b, ["detector", "task_family"], "left")
    source = F.when(F.col("own").isNotNull(), "dataset").when(F.col("family").isNotNull(), "task_family")
    return d.select("detector", "dataset", "task_family", F.coalesce("own", "family").alias("rate"), source.alias("source"))


def blend(score: float, similar: DataFrame) -> DataFrame:
    """One row: blended, weight: a heuristic score (0 to 100) and the success
    (0 to 1) of similar outcomes (distance, success), nearer ones counting more."""
    w = 1.0 / (F.col("distance") + 1e-6)
    g = similar.agg((F.sum(w * F.col("success") * 100.0) / F.sum(w)).alias("seen"), F.count("*").alias("n"), F.min("distance").alias("near"))
    weight = F.when(F.col("n") == 0, 0.0).otherwise(0.6 * F.least(F.lit(1.0), F.col("n") / 5.0) * F.greatest(F.lit(0.0), 1.0 - F.col("near") / 0.4))
    blended = F.when(F.col("n") == 0, F.lit(score)).otherwise(F.round(F.least(F.greatest((1.0 - weight) * score + weight * F.col("seen"), F.lit(0.0)), F.lit(100.0)), 1))
    return g.select(blended.alias("blended"), F.round(weight, 3).alias("weight"))


def blind_sample(items: DataFrame, top_k: int, n_controls: int, max_flagged: int | None = None, seed: int = 0) -> DataFrame:
    """(dataset, ep, stratum, inclusion_prob, item_key): of (dataset, ep, flagged,
    priority) all flagged ones (or so many), those to be reviewed first, and
    a sample of the rest; item_key, a hash, is an order that tells nothing.

    Places are counted by window limits inside each dataset and stratum.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("dataset").cast("string"), F.col("ep").cast("string")))
    d = items.withColumn("item_key", key)
    n = d.groupBy("dataset").agg(F.sum(F.col("flagged").cast("long")).alias("n_flagged"), F.sum((~F.col("flagged")).cast("long")).alias("n_rest"))
    d = d.join(n, "dataset")
    by_hash, by_rank = Window.partitionBy("dataset", "flagged").orderBy("item_key"), Window.partitionBy("dataset", "flagged").orderBy(F.desc("priority"), "ep")
    flagged = d.where("flagged")
    most = F.col("n_flagged") if max_flagged is None else F.least(F.col("n_flagged"), F.lit(max_flagged))
    if max_flagged is not None:  # a literal, by which each task limits its groups first; without it nothing is sorted
        flagged = flagged.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= max_flagged)
    flagged = flagged.select("dataset", "ep", F.lit("flagged").alias("stratum"), (most / F.col("n_flagged")).alias("inclusion_prob"), "item_key")
    rest = d.where("not flagged").withColumn("rank", F.row_number().over(by_rank))
    review = rest.where(F.col("rank") <= top_k).select("dataset", "ep", F.lit("review_top").alias("stratum"), F.lit(1.0).alias("inclusion_prob"), "item_key")
    pool = rest.where(F.col("rank") > top_k).withColumn("place", F.row_number().over(Window.partitionBy("dataset").orderBy("item_key")))
    size = F.col("n_rest") - top_k
    control = pool.where(F.col("place") <= n_controls).select("dataset", "ep", F.lit("control").alias("stratum"), (F.least(F.lit(n_controls), size) / size).alias("inclusion_prob"), "item_key")
    return flagged.unionByName(review).unionByName(control)


def detector_scores(labels: DataFrame, key: DataFrame, snapshots: DataFrame, positive: str = "acquisition_fault") -> DataFrame:
    """(detector, n, precision, recall) of labels (item_id, label) through the key
    (item_id, dataset, revision, ep, inclusion_prob) to what snapshots (dataset,
    revision, ep, detector, fires) say; each row counts by one over its
    inclusion probability; unsure and empty labels don't count.  A key row whose dataset has
    another revision in the snapshots is an error."""
    known = labels.where("label is not null and trim(label) not in ('', 'unsure')").join(key, "item_id")
    snap = snapshots.withColumnRenamed("revision", "snap_revision")
    met = known.join(snap, ["dataset", "ep"])
    same = F.assert_true(F.col("revision").eqNullSafe(F.col("snap_revision")), F.lit("the labels are for another revision of the dataset"))
    met = met.where(same.isNull()).withColumns({"w": F.when(F.col("inclusion_prob") > 0, 1.0 / F.col("inclusion_prob")).otherwise(0.0), "bad": F.trim("label") == positive})
    s = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0))
    g = met.groupBy("detector").agg(F.count("*").alias("n"), s(F.col("fires") & F.col("bad")).alias("tp"), s(F.col("fires")).alias("f"), s(F.col("bad")).alias("b"))
    return g.select("detector", "n", F.when(F.col("f") > 0, F.col("tp") / F.col("f")).alias("precision"), F.when(F.col("b") > 0, F.col("tp") / F.col("b")).alias("recall"))


def detectors(signals: DataFrame, risk: float = 0.5, anomaly: float = 0.5) -> DataFrame:
    """(ep, and a boolean a detector): which detectors fire on each episode.

    ``signals``: ep, stage1_fail, video_fault, short_outlier (booleans), duplicate_of,
    quality_risk, anomaly.  Blocked are failures of the gate, of video, and copies; flagged
    are these and short ones.  A null counts as not fired.
    """
    fires = lambda c: F.coalesce(c, F.lit(False))
    stage1, video, copy, short = (fires(c) for c in (F.col("stage1_fail"), F.col("video_fault"), F.col("duplicate_of").isNotNull(), F.col("short_outlier")))
    return signals.select(
        "ep", (stage1 | video | copy | short).alias("flagged"), (stage1 | video | copy).alias("blocked"), copy.alias("duplicate"), short.alias("short_outlier"), stage1.alias("stage1_fail"),
        video.alias("video_fault"), fires(F.col("quality_risk") >= risk).alias("quality_risk"), fires(F.col("anomaly") >= anomaly).alias("anomaly"),
    )


def calibrated_weights(outcomes: DataFrame, cols: list[str], target: str = "success", least: int = 10) -> dict[str, float] | None:
    """Least-squares weights of the outcomes' figures (and "bias") for their
    success; None with fewer than ``least`` rows.  The sums are aggregated, a matrix of the figures is solved."""
    import numpy as np

    x = [*[F.col(c) for c in cols], F.lit(1.0)]
    row = outcomes.agg(F.count("*"), *[F.sum(a * b) for a in x for b in x], *[F.sum(a * F.col(target)) for a in x]).first()
    if row[0] < least:
        return None
    m = np.array(list(row)[1:], float)
    n = len(x)
    w = np.linalg.lstsq(m[: n * n].reshape(n, n), m[n * n :], rcond=None)[0]
    return dict(zip([*cols, "bias"], w.tolist()))


def annotations(dispositions: DataFrame, assessed: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """(episode_id, disposition, quality_risk, anomaly, coverage_value,
    integrity_flags): the sidecar of a dataset, a row an episode; ``flags``: (ep, metric)."""
    d = dispositions.join(assessed.select("ep", "quality_risk", "anomaly", "coverage_value"), "ep", "left")
    if flags is not None:
        d = d.join(flags.groupBy("ep").agg(F.array_sort(F.collect_set("metric")).alias("integrity_flags")), "ep", "left")
    else:
        d = d.withColumn("integrity_flags", F.lit(None).cast("array<string>"))
    return d.select(F.col("ep").alias("episode_id"), "disposition", "quality_risk", "anomaly", "coverage_value", F.coalesce("integrity_flags", F.array().cast("array<string>")).alias("integrity_flags"))


def write_annotations(rows: DataFrame, path: str, source_dataset: str, parquet: bool = False) -> DataFrame:
    """Write the sidecar as JSON lines (and Parquet if asked) and its manifest,
    counts by disposition; returns the manifest."""
    rows.write.json(f"{path}/annotations")
    if parquet:
        rows.write.parquet(f"{path}/annotations_parquet")
    out = rows.groupBy("disposition").agg(F.count("*").alias("n")).withColumn("source_dataset", F.lit(source_dataset))
    out.coalesce(1).write.json(f"{path}/manifest")
    return out
