"""Registered queries over the data source, sessions, embeddings, gaps between
data sets, walks in a state space, regimes and claims."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage, shared_dir
from ..operators import audit, coverage, cure, dynamics, embed, evidence, gap, gates, latent, motion, policies, report, scoring, sft, timing
from ..sources import capabilities, episode_source, video
from ..sources.episodes import table, turns
from ..streaming import session
from .analysis import REPORTED, following
from .catalog import METRICS, _long, _summary, _vectors, ev, figures, li, query, shown

FEATURES = ("a2", "a3")


def _fresh(spark, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _gone(path: str) -> None:
    files, root = episode_source.filesystem(path)
    files.delete_dir(root)


@query
def episode_directory(spark, d):
    """Lines written as a directory of episodes with pictures and read back without them."""
    path = _fresh(spark, "episodes")
    frames = li(spark, d).select(
        F.col("ep").alias("episode_index"),
        F.col("step").cast("long").alias("frame_index"),
        F.col("t").alias("timestamp"),
        F.array(*[F.col(f"a{k}").cast("float") for k in range(4)]).alias("action"),
        F.array(F.col("a2").cast("float")).alias("observation.state"),
        F.lit(b"pixels").alias("observation.images.top"),
    )
    episode_source.register(spark)
    frames.write.format("episodes").mode("overwrite").save(path)
    files, root = episode_source.filesystem(path)
    with files.open_output_stream(f"{root}/{episode_source.INFO}") as f:
        f.write(json.dumps({"features": {"observation.images.top": {"dtype": "video"}}}).encode())
    got = episode_source.load(spark, path)
    g = got.groupBy("episode_index").agg(
        F.count("*").alias("n"), F.max("frame_index").alias("last"), F.round(F.max("timestamp"), 6).alias("seconds"),
        F.round(F.sum(F.col("action")[0].cast("double")), 3).alias("action"), F.sum(F.size("obs_state")).alias("states"), F.lit(",".join(got.columns)).alias("columns"),
    )
    out = cut_lineage(g)
    _gone(path)
    return out


@query
def session_counters(spark, d):
    """Three sessions of events watched by the stateful stream: where their counters stand."""
    path = _fresh(spark, "session")
    steps = ev(spark, d).select(F.concat(F.lit("s"), F.col("ep") % 3).alias("session"), "ep", F.col("step").cast("long").alias("step"), "t", "a0", "s0")
    steps.repartition(2, "ep").write.parquet(f"{path}/in")
    out = cut_lineage(session.counters(session.run_available(spark, f"{path}/in", path, least=10, every=50)))
    _gone(path)
    return out


@query
def dataset_gap(spark, d):
    """How far the events of even users (simulated, with a camera) are from those of odd ones (real)."""
    steps = ev(spark, d)
    got = gap.sim_to_real(steps.where("ep % 2 = 0"), steps.where("ep % 2 = 1"), ("a0",), ("s0",), {"proprio", "camera_top"}, {"proprio"})
    return shown(got)


@query
def projected_embeddings(spark, d):
    e = embed.projected(li(spark, d), FEATURES)
    return shown(e.select("ep", F.posexplode("embedding").alias("j", "value")))


@query
def projected_novelty(spark, d):
    return shown(embed.novelty(embed.projected(li(spark, d), FEATURES)), digits=7)


@query
def projected_outliers(spark, d):
    return shown(embed.centroid_outliers(embed.projected(li(spark, d), FEATURES)), digits=7)


@query
def projected_flags(spark, d):
    e = cut_lineage(embed.projected(li(spark, d), FEATURES))
    return shown(embed.flags(embed.centroid_outliers(e), embed.novelty(e)), digits=7)


@query
def mean_nearest(spark, d):
    v, cols = _vectors(spark, d)
    return shown(embed.mean_nearest(v, cols))


@query
def distance_walk(spark, d):
    """Transitions of a minimal distance in quantity and price."""
    steps, states = following(spark, d), ("s0", "s1")
    t = latent.walk(steps, states, ("a2",), latent.epsilon(steps, states))
    return shown(t.select("ep", "start", "end", F.col("z")[0].alias("z0"), F.col("z")[1].alias("z1"), F.col("a")[0].alias("a"), F.col("d")[0].alias("d0"), F.col("d")[1].alias("d1")))


@query
def latent_dynamics(spark, d):
    steps, states = following(spark, d), ("s0", "s1")
    t = latent.walk(steps, states, ("a2",), latent.epsilon(steps, states))
    return shown(latent.dynamics(steps, t, states, ("a2",)), digits=5)


@query
def regime_selection(spark, d):
    """The longest episodes that pass the gate of their data set's noise regime."""
    f = figures(spark, d)
    return report.regime_selection(gates.quality_gate, f, scoring.regime(_summary(spark, d)), 0.3, strategy="influence", scores=f.select("ep", F.col("n_steps").cast("double").alias("score")))


def _claims(spark, d):
    o = table(spark, d, "orders")
    metric = F.element_at(F.array(*map(F.lit, ("velocity_discontinuity_rate", "action_entropy", "jitter_cv"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "validated").when(F.col("o_orderstatus") == "O", "active_hypothesis").otherwise("retired")
    kind = F.when(F.col("o_custkey") % 5 == 0, "any").otherwise(F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("claim_id"), metric.alias("metric"), kind.alias("class"), status.alias("status"))


@query
def claim_confidence(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_returnflag") != "R").alias("supports"))
    return evidence.judged_claims(_claims(spark, d), lines).select("claim_id", "n_evidence", "n_supporting", "confidence")


@query
def active_claims(spark, d):
    return evidence.active_claims(_claims(spark, d), "vel_disc_rate", "1-URGENT")


@query
def study_status(spark, d):
    """Of each customer's orders as conditions, measured unless pending: validated, partial or simulated over all."""
    return evidence.study_status(table(spark, d, "orders").select((F.col("o_orderstatus") != "P").alias("measured")))


def observed(spark, d):
    """Events with observations under names that differ by data set, some of them missing in some episodes."""
    e = ev(spark, d).withColumn("dataset", F.col("ep") % 4)
    one, two = F.array("s0"), F.array("s0", "a0")
    kinds = [
        F.create_map(F.lit("proprio"), two, F.lit("state"), F.array("a0")),
        F.when(F.col("ep") % 3 != 0, F.create_map(F.lit("qpos"), F.array("a0"), F.lit("joint_state"), one, F.lit("joint_position"), one)).otherwise(F.create_map(F.lit("qpos"), F.array("a0"))),
        F.create_map(F.lit("obs"), one),
        F.create_map(F.lit("force"), one),
    ]
    obs = F.when(F.col("dataset") == 0, kinds[0]).when(F.col("dataset") == 1, kinds[1]).when(F.col("dataset") == 2, kinds[2]).otherwise(kinds[3])
    return e.select("dataset", "ep", "step", F.array("a0").alias("action"), obs.alias("obs"))


@query
def resolved_state(spark, d):
    s = capabilities.with_state(observed(spark, d))
    return shown(s.groupBy("dataset", "state_key").agg(F.count("state").alias("n"), F.sum(F.get("state", F.lit(0))).alias("total")), digits=3)


@query
def shaped_state(spark, d):
    return capabilities.shaped_state_keys(observed(spark, d))


@query
def first_camera(spark, d):
    k = (F.col("vec_id") % 4).cast("int")
    frames = table(spark, d, "embeddings").select(
        F.col("label").cast("long").alias("ep"), F.element_at(F.array(*map(F.lit, ("force", "rgb_static", "wrist_image", "depth"))), k + 1).alias("camera"), k.alias("place"), "vec_id",
        F.when((k == 1) & (F.col("label") % 3 == 0), 2).otherwise(3 + F.col("label") % 2).alias("n_dims"),
    )
    return capabilities.first_cameras(frames)


@query
def video_span_problems(spark, d):
    """Lines as spans in files shared by an order: overlaps, gaps and lengths that don't fit."""
    begin = F.col("l_linenumber") * 2 - F.col("l_discount") * 20
    end = begin + F.col("l_quantity") / 25 + F.when(F.col("l_tax") > 0.065, 0.5).otherwise(0.0)
    meta = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("episode_index"), F.col("l_quantity").alias("length"), F.floor(F.col("l_orderkey") / 1000).alias("videos/top/chunk_index"),
        F.col("l_orderkey").alias("videos/top/file_index"), begin.alias("videos/top/from_timestamp"), end.alias("videos/top/to_timestamp"),
    )
    spans = video.shared_files(meta, ["top", "wrist"], "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4")
    return shown(video.span_problems(spans, 25.0))


@query
def video_files(spark, d):
    lengths = li(spark, d).groupBy(F.col("ep").alias("episode_index")).agg(F.count("*").alias("length"))
    spans = video.one_file_an_episode(lengths, ["top", "wrist"], "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4", chunk=10)
    return spans.select("ep", "camera", "path", "length")


@query
def proprio_latents(spark, d):
    return shown(embed.proprio_latents(li(spark, d), ("a0", "a2")).select("ep", F.posexplode("latent").alias("i", "value")))


@query
def visual_latents(spark, d):
    from .analysis import camera

    return shown(embed.visual_latents(camera(spark, d).select("ep", "step", F.transform("pixels", lambda x: x.cast("double")).alias("pixels"))).select("ep", F.posexplode("latent").alias("i", "value")))


@query
def reduced_vectors(spark, d):
    """Vectors on their first three singular directions, by randomised iteration."""
    return shown(embed.reduced(table(spark, d, "embeddings").select(F.col("vec_id").alias("ep"), "embedding"), "embedding", 3), digits=4)


@query
def bulk_audit(spark, d):
    """Five data sets of events in one plan; one of them has been audited."""
    steps = ev(spark, d).withColumns({"dataset": F.concat(F.lit("d"), F.col("ep") % 5), "revision": F.lit("r1")})
    done = spark.createDataFrame([("d3", "r1"), ("d2", "r0")], "dataset string, revision string")
    return shown(audit.audit(steps, ("a0",), done))


@query
def state_direction_entropy(spark, d):
    """Of the states' changes."""
    return shown(coverage.direction_entropy(following(spark, d), ("s0", "s1", "s2", "s3")))


@query
def standalone_vectors(spark, d):
    return shown(dynamics.tracking_and_sigma_jerk(following(spark, d), actions=FEATURES, states=("s2", "s3")))


@query
def approved_rows(spark, d):
    """Events of the users that the quality gate finds clean."""
    decided = gates.dispositions(gates.quality_gate(figures(spark, d)), figures(spark, d).select("ep"))
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("ep"))
    return gates.approved_rows(rows, decided)


@query
def reference_metrics(spark, d):
    """Lines by their flags as reference profiles in JSON."""
    inner = lambda *pairs: F.create_map(*[x for n, v in pairs for x in (F.lit(n), v)])
    g = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("name")).agg(F.round(F.avg("l_tax"), 9).alias("a"), F.round(F.avg("l_discount"), 9).alias("b"), F.round(F.avg("l_quantity"), 9).alias("c"))
    kind = F.when(F.col("name").startswith("A"), "whole_episode").otherwise("per_submovement_v1")
    parts = F.create_map(
        F.lit("temporal_stability"), inner(("jitter.mean_cv", F.col("a"))), F.lit("control_smoothness"), inner(("ldlj.mean_ldlj", -F.col("c")), ("jerk_spikes.mean_spike_fraction", F.col("b"))),
    )
    profile = F.to_json(F.struct(F.create_map(F.lit("ldlj_definition"), kind).alias("meta"), parts.alias("aggregate_metrics")))
    return policies.reference_metrics(g.select("name", profile.alias("profile"))).drop("profile")


@query
def coherent_gate(spark, d):
    """Pairs gated with the cosine of a vector each for instruction and response."""
    pairs = turns(table(spark, d, "conversations"))
    e = table(spark, d, "embeddings")
    n = e.count()
    own = lambda name: e.select(F.col("vec_id").alias(f"_{name}"), F.col("embedding").alias(name))
    met = pairs.withColumns({"_left": F.col("conv_id") % n, "_right": (F.col("conv_id") * 7 + F.col("turn")) % n}).join(own("left"), "_left").join(own("right"), "_right")
    fp = sft.with_coherence(sft.fingerprint(pairs), met, "left", "right")
    return shown(sft.gate(fp).select("conv_id", "turn", "coherence", "passed"))


@query
def report_drift(spark, d):
    """The flags of even and odd users side by side."""
    name = F.create_map(*[F.lit(x) for pair in REPORTED.items() for x in pair])
    m = _long(spark, d).where(F.col("metric").isin(*METRICS))
    sides = [m.where(f"ep % 2 = {k}") for k in (0, 1)]
    crit, warn = F.lit(0.05), F.lit(0.01)
    for metric, (w, c) in {"jitter_cv": (0.15, 0.30), "spike_rate": (0.02, 0.05), "disc_rate": (0.02, 0.05)}.items():
        crit, warn = F.when(F.col("metric") == metric, c).otherwise(crit), F.when(F.col("metric") == metric, w).otherwise(warn)
    level = F.when(F.col("value") >= crit, "CRITICAL").when(F.col("value") >= warn, "WARNING").otherwise("OK")
    flags = [s.groupBy("metric").agg(F.avg("value").alias("value")).withColumn("level", level).withColumn("metric", name[F.col("metric")]) for s in sides]
    tests = dynamics.permutation_tests(*sides).withColumn("metric", name[F.col("metric")])
    return shown(policies.compare_reports(*flags, tests))


@query
def corruption_reactions(spark, d):
    """What truncated episodes do to the figures, and which of them react."""
    steps = ev(spark, d)
    both = [timing.timing_metrics(s).join(motion.motion_metrics(s).drop("n_steps"), "ep") for s in (steps, cure.truncate(steps))]
    return shown(cure.reactions(cure.damage_report(*both, METRICS)))


@query
def content_hashes(spark, d):
    return dynamics.content_hashes(li(spark, d), ("a0", "a1", "a2", "a3"))
