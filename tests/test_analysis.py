"""Operators that SQL can't state, against plain NumPy; and cases at the edges."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from episight.operators import clusters, coverage, cure, dynamics, evidence, export, frames, leakage, limits, motion, policies, selection, stats, surprise, tasks
from episight.plans import catalog
from episight.sources import lerobot


def steps_of(spark, episodes, dims=1):
    """Steps (ep, step, t, a0.., s0..) from {ep: (times, actions, states)}."""
    rows = [(int(e), i, float(t), *map(float, np.atleast_1d(a)), *map(float, np.atleast_1d(s))) for e, (ts, xs, ss) in episodes.items() for i, (t, a, s) in enumerate(zip(ts, xs, ss))]
    cols = ", ".join([*(f"a{k} double" for k in range(dims)), *(f"s{k} double" for k in range(dims))])
    return spark.createDataFrame(rows, f"ep long, step long, t double, {cols}")


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(5)
    eps = {}
    for e, n in enumerate([0, 1, 2, 3, 4, 5, 9, 30, 64]):
        eps[e] = (np.cumsum(rng.uniform(0.02, 0.06, n)), rng.normal(size=(n, 2)).cumsum(0), rng.normal(size=(n, 2)).cumsum(0))
    return eps, steps_of(spark, eps, 2)


def test_savgol_is_a_local_parabola(walks):
    eps, steps = walks
    got = {(r.ep, r.step): r.value for r in cure.smooth(steps).collect()}
    for e, (_, a, _) in eps.items():
        v, n = a[:, 0] if len(a) else a, len(a)
        size = 7 if n >= 7 else n if n % 2 else n - 1
        for i in range(n):
            want = v[i]
            if size >= 3:
                first = min(max(i - size // 2, 0), n - size)
                want = np.polyval(np.polyfit(np.arange(size), v[first : first + size], 2), i - first)
            assert got[e, i] == pytest.approx(want, abs=1e-8)


def test_resampling_equals_linear_interpolation(walks):
    eps, steps = walks
    for hz in (None, 40.0):
        got = {}
        for r in dynamics.interpolate(steps, "a0", hz).collect():
            got.setdefault(r.ep, {})[r.i] = r.value
        for e, (t, a, _) in eps.items():
            if len(t) < 2:
                assert e not in got
                continue
            m = int(round((t[-1] - t[0]) * (hz or 1 / np.mean(np.diff(t))))) + 1
            want = np.interp(np.linspace(t[0], t[-1], m), t, a[:, 0]) if m >= 2 else []
            assert len(got.get(e, {})) == len(want)
            assert [got[e][i] for i in range(len(want))] == pytest.approx(want, abs=1e-9)


def test_cure_resamples_smooths_and_trims(walks):
    eps, steps = walks
    out = cure.cure(steps, ("a0", "a1"))
    assert out.columns == ["ep", "step", "t", "a0", "a1"]
    still = steps_of(__import__("pyspark").sql.SparkSession.getActiveSession(), {1: (np.arange(40) * 0.1, np.r_[np.zeros(15), np.ones(10).cumsum(), np.full(15, 10.0)], np.zeros(40))})
    kept = [r.step for r in cure.cure(still).orderBy("step").collect()]
    assert kept[0] > 5 and kept[-1] < 35 and kept == list(range(kept[0], kept[-1] + 1))


def test_relative_poses_turn_back(spark):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(20, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    p = rng.normal(size=(20, 3))

    def matrix(v):
        x, y, z, w = v
        return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])

    df = spark.createDataFrame([(1, i, *map(float, p[i]), *map(float, q[i])) for i in range(20)], "ep long, step long, x double, y double, z double, qx double, qy double, qz double, qw double")
    rows = cure.relative_poses(df).orderBy("step").collect()
    assert len(rows) == 19
    for i, r in enumerate(rows):
        a, b = matrix(q[i]), matrix(q[i + 1])
        assert [r.dx, r.dy, r.dz] == pytest.approx(a.T @ (p[i + 1] - p[i]), abs=1e-9)
        cx, sx, cy, sy, cz, sz = np.cos(r.droll), np.sin(r.droll), np.cos(r.dpitch), np.sin(r.dpitch), np.cos(r.dyaw), np.sin(r.dyaw)
        turn = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
        assert turn == pytest.approx(a.T @ b, abs=1e-9)


def test_damage_keeps_what_it_should(walks):
    eps, steps = walks
    spikes = {(r.ep, r.step): r.value for r in cure.inject_spikes(steps, 0.2).collect()}
    for e, (t, a, _) in eps.items():
        if len(t):
            assert sorted(spikes[e, i] for i in range(len(t))) == pytest.approx(sorted(a[:, 0]))
            moved = sum(spikes[e, i] != a[i, 0] for i in range(len(t)))
            most = 0 if len(t) < 4 else 2 * min(max(1, int(len(t) * 0.2)), len(t) // 4)
            assert (moved > 0 or len(t) <= 5) and moved <= most
    noisy = cure.add_jitter(steps, 50.0).orderBy("ep", "step").collect()
    assert all(x.t <= y.t for x, y in zip(noisy, noisy[1:]) if x.ep == y.ep) and len(noisy) == steps.count()
    late = {(r.ep, r.step): r.t for r in cure.delay(steps).collect()}
    assert all(0.05 <= late[e, i] - eps[e][0][i] <= 0.2001 for e, i in late)
    some = {r.ep for r in cure.delay(steps, 0.4).collect() if r.t != eps[r.ep][0][r.step]}
    present = [e for e in eps if len(eps[e][0])]
    assert len(some) == max(1, int(0.4 * len(present)))
    cut = {r.ep: r["count"] for r in cure.truncate(steps, fraction=0.4).groupBy("ep").count().collect()}
    assert sum(cut[e] < len(eps[e][0]) for e in present) <= len(some) and all(cut[e] in (len(eps[e][0]), max(2, int(len(eps[e][0]) * 0.8))) for e in present)


def test_spikes_swap_inner_steps_with_distant_ones(spark):
    """With values that are the steps themselves a swap of two shows both ends."""
    n = 200
    steps = spark.createDataFrame([(e, i, float(i)) for e in range(4) for i in range(n)], "ep long, step long, a0 double")
    got = {(r.ep, r.step): r.value for r in cure.inject_spikes(steps, 0.01).collect()}  # two swaps an episode
    for e in range(4):
        moved = {i: int(got[e, i]) for i in range(n) if got[e, i] != i}
        assert 2 <= len(moved) <= 4 and sorted(moved) == sorted(moved.values())
        assert any(abs(i - j) > 20 for i, j in moved.items())
    assert len({i % n for e in range(4) for i in range(n) if got[e, i] != i}) > 8  # not all in one half or at one distance


def test_pca_and_latent_projection(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in e], float)
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    got = {r.ep: r for r in catalog.QUERIES["latent_projection"](spark, small).collect()}
    want = np.abs(c @ vt[:3].T)
    for i, r in enumerate(e):
        assert [got[r.vec_id][f"p{k}"] for k in range(3)] == pytest.approx(want[i], abs=2e-3)
    li = catalog.li(spark, small).select("a0", "a1", "a2", "a3").toPandas().to_numpy()
    v = np.sort(np.linalg.eigvalsh(np.cov(li.T, bias=True)))[::-1]
    assert catalog.QUERIES["pca_top2"](spark, small).first()[0] == pytest.approx(v[:2].sum() / v.sum(), abs=1e-6)


def test_vector_forecasts(spark, small):
    from episight.plans.analysis import following

    pdf = following(spark, small).orderBy("ep", "step").toPandas()
    xs, ds, own = [], [], []
    for e, g in pdf.groupby("ep"):
        x, s = g[["s2", "s3", "a2", "a3"]].to_numpy(), g[["s2", "s3"]].to_numpy()
        xs.append(x[:-1])
        ds.append(np.diff(s, axis=0))
        own += [e] * (len(g) - 1)
    x, d = np.concatenate(xs), np.concatenate(ds)
    w = np.linalg.solve(x.T @ x + 1e-4 * np.eye(4), x.T @ d)
    off = np.linalg.norm(d - x @ w, axis=1)
    want = {e: off[np.array(own) == e].mean() for e in set(own)}
    got = {r.ep: r.error for r in catalog.QUERIES["vector_transitions"](spark, small).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def test_surprise_of_several_dimensions(walks):
    eps, steps = walks
    for latent in (16, 1):
        got = {r.ep: r.surprise for r in surprise.surprise(steps, ("s0", "s1"), ("a0", "a1"), latent).collect()}
        S = np.concatenate([s[:-1] for _, _, s in eps.values() if len(s) > 1])
        A = np.concatenate([a[:-1] for _, a, s in eps.values() if len(s) > 1])
        N = np.concatenate([s[1:] for _, _, s in eps.values() if len(s) > 1])
        own = np.concatenate([[e] * (len(s) - 1) for e, (_, _, s) in eps.items() if len(s) > 1])
        z, n, a = (S - S.mean(0)) / S.std(0), (N - S.mean(0)) / S.std(0), (A - A.mean(0)) / A.std(0)
        if latent == 1:
            axis = np.linalg.eigh(np.cov(z.T, bias=True))[1][:, -1:]
            z, n = z @ axis, n @ axis
        x = np.c_[z, a, np.ones(len(z))]
        w = np.linalg.solve(x.T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ n)
        mse = ((x @ w - n) ** 2).mean(1)
        e = {k: mse[own == k].mean() if (own == k).any() else 0.0 for k in eps if len(eps[k][0])}
        lo, hi = min(e.values()), max(e.values())
        assert got == pytest.approx({k: (v - lo) / (hi - lo) for k, v in e.items()}, abs=1e-8)


def test_hsic_tells_dependence(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    df = spark.createDataFrame([(i, float(v), float(v * v), float(n)) for i, (v, n) in enumerate(zip(x, rng.normal(size=300)))], "ep long, x double, y double, n double")
    assert surprise.normalised_hsic(df, ["x"], ["x"]) == pytest.approx(1)
    assert surprise.normalised_hsic(df, ["x"], ["y"]) > 5 * surprise.normalised_hsic(df, ["x"], ["n"])


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.02, (n, 2)) for c, n in ((0.1, 40), (0.5, 10), (0.9, 14))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "ep long, x double, y double")
    centres, got = clusters.k_means(df, ["x", "y"], 3)
    rows = got.collect()
    for r in rows:
        d = ((centres - [r.x, r.y]) ** 2).sum(1)
        assert r.cluster == d.argmin() and r.gap == pytest.approx(d.min())
    for c in range(3):
        own = [(r.x, r.y) for r in rows if r.cluster == c]
        if own:
            assert centres[c] == pytest.approx(np.mean(own, 0), abs=1e-9)
    two = np.concatenate([rng.normal(0, 0.1, (30, 3)), rng.normal(5, 0.1, (30, 3))])
    f = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(two)], "ep long, a double, b double, c double")
    got = clusters.trajectory_diversity(f, ["a", "b", "c"]).first()
    assert got.n_modes == 2 and got.separation > 0.95
    assert clusters.trajectory_diversity(f.limit(3), ["a", "b", "c"]).first() == (1, 0.0)
    gaps = clusters.coverage_gaps(df, ["x", "y"], 3).collect()
    assert all(g.current < g.target and g.needed == g.target - g.current and g.gain >= 0 for g in gaps)


def test_greedy_choices_and_two_stages(spark, small):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 3))
    f = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "ep long, a double, b double, c double")
    want = selection.greedy_cover(x, 25)
    exact = [r.ep for r in selection.k_center_exact(f, ["a", "b", "c"], 25, max_exact=50).orderBy("rank").collect()]
    assert exact == want
    near = selection.k_center(f, ["a", "b", "c"], 30, part=40)
    assert near.count() == 30 and near.select("ep").distinct().count() == 30
    gate = spark.createDataFrame([(i, "length" if i % 10 == 0 else "", "bad" if i % 10 == 0 else "clean") for i in range(120)], "ep long, reasons string, status string")
    got = {r.ep: r for r in selection.two_stage(gate, 0.2, "diversity", f, ["a", "b", "c"]).collect()}
    ok = [i for i in range(120) if i % 10]
    kept = {ok[i] for i in selection.greedy_cover(x[ok], 24)}
    assert {e for e, r in got.items() if r.decision == "keep"} == kept
    assert got[0].decision == "quality_fail" and got[0].reasons == "length"
    assert {r.reasons for r in got.values() if r.decision == "diversity_pruned"} == {"not_selected_diversity"}
    every = selection.two_stage(gate, 0.95, "diversity", f, ["a", "b", "c"]).where("decision = 'keep'").count()
    assert every == 108
    assert selection.keep_count(10, 0.25) == 2 and selection.keep_count(3, 0.01) == 1


def test_distances_to_a_selection(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 4))
    f = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "ep long, a double, b double, c double, d double")
    got = {r.ep: r.distance for r in selection.distance_to(f.where("ep < 7"), f, ["a", "b", "c", "d"]).collect()}
    want = np.sqrt(((x[:, None] - x[None, :7]) ** 2).sum(2)).min(1)
    assert [got[i] for i in range(50)] == pytest.approx(want)


def test_numbers_and_even_places(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "ep").repartition(7)
    assert {(r.ep, r.place) for r in export.numbered(df, "ep").collect()} == {(i, i + 1) for i in range(1000)}
    assert sorted(r.ep for r in stats.evenly_spaced(df, 5).collect()) == [0, 250, 500, 749, 999] or len(stats.evenly_spaced(df, 5).collect()) == 5
    assert stats.evenly_spaced(df.limit(3), 5).count() == 3


def test_holds_need_five_steps(spark):
    state = np.r_[np.arange(10.0), np.full(5, 9.0), np.arange(10.0, 14), np.full(6, 13.0)]
    df = steps_of(spark, {1: (np.arange(len(state)) * 0.1, state + 0.5, state)})
    held = sorted(r.step for r in tasks.hold_steps(df, ("a0",), ("s0",)).collect())
    runs = [i for i in range(1, len(state)) if state[i] == state[i - 1]]
    assert held == [i for i in runs if sum(j in runs for j in range(i - 5, i + 6)) >= 5]
    drift = tasks.calibration_drift(df.unionByName(df.withColumn("ep", F.lit(2))).unionByName(df.withColumn("ep", F.lit(3))), ("a0",), ("s0",)).first()
    assert drift.systematic and drift.level == "WARNING" and drift.mean_offset == pytest.approx(0.5)
    assert tasks.calibration_drift(df, ("a0",), ("s0",)).first().level == "INFO"


def test_velocities_by_kind(walks):
    eps, steps = walks
    a = eps[8][1]
    got = {r.step: r.a0 for r in motion.velocity(steps.where("ep = 8"), ("a0",), "acceleration").collect()}
    dt = np.median(np.diff(eps[8][0]))
    assert [got[i] for i in range(len(a))] == pytest.approx(np.cumsum(a[:, 0]) * dt)
    assert motion.velocity(steps, ("a0",), "velocity").count() == steps.count()
    with pytest.raises(ValueError):
        motion.velocity(steps, ("a0",), "jerk")


def test_holdout_ranges_are_half_open(spark):
    got = {tuple(r) for r in leakage.holdout(spark, "0:3, 7,9:10").collect()}
    assert got == {(0, 3), (7, 8), (9, 10)}


def test_chance_of_so_many(spark):
    from math import comb

    df = spark.createDataFrame([(n, k) for n in (1, 10, 300) for k in (0, 1, 3, 9)], "n long, k long")
    for r in df.select("n", "k", leakage.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect():
        want = sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k, r.n + 1))
        assert r.p == pytest.approx(want, abs=1e-9)


def test_a_revision_that_differs_is_an_error(spark):
    labels = spark.createDataFrame([("i1", "acquisition_fault")], "item_id string, label string")
    key = spark.createDataFrame([("i1", "d", "r1", 1, 0.5)], "item_id string, dataset string, revision string, ep long, inclusion_prob double")
    snap = lambda rev: spark.createDataFrame([("d", rev, 1, "x", True)], "dataset string, revision string, ep long, detector string, fires boolean")
    assert evidence.detector_scores(labels, key, snap("r1")).first().precision == 1.0
    with pytest.raises(Exception, match="another revision"):
        evidence.detector_scores(labels, key, snap("r2")).collect()


def test_weights_by_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 2))
    df = spark.createDataFrame([(float(a), float(b), float(2 * a - b + 0.5)) for a, b in x], "x double, y double, success double")
    assert evidence.calibrated_weights(df, ["x", "y"]) == pytest.approx({"x": 2, "y": -1, "bias": 0.5})
    assert evidence.calibrated_weights(df.limit(9), ["x", "y"]) is None


def test_names_of_keys():
    got = {k: lerobot.canonical(k) for k in ("joint_pos", "images.top", "images.left", "image.x", "obs/force", "robot0_eef_quat", "camera_rgb")}
    assert got == {"joint_pos": "joint_position", "images.top": "camera_top", "images.left": "camera_left", "image.x": "camera_x", "obs/force": "force", "robot0_eef_quat": "eef_orientation", "camera_rgb": "camera_rgb"}
    assert lerobot.canonical("images.top", {"images.top": "camera_bird"}) == "camera_bird"
    assert lerobot.feature_columns(["s_10", "s_2", "s_1", "sx_1", "t"], "s") == ["s_1", "s_2", "s_10"]


def test_arrays_without_dims_and_first_aliases(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], None, 5.0, "demo_12")], "v array<double>, a double, b double, name string")
    r = df.select(lerobot.without_dims(F.col("v"), (-1, 0)).alias("v"), lerobot.first_alias(df.columns, {"rate": ("a", "b")})["rate"].alias("rate"), lerobot.demo_index(F.col("name")).alias("k"), lerobot.proprio({"eef_pos": F.array(F.lit(1.0)), "joint_pos": F.col("v")}).alias("p")).first()
    assert (r.v, r.rate, r.k, r.p) == ([2.0, 3.0], 5.0, 12, [1.0, 2.0, 3.0, 4.0, 1.0])


def test_directory_round_trip(spark, tmp_path):
    rows = [(e, i, i * 0.1, [float(e), float(i)], [float(i), 1.0], float(e % 2), e % 2) for e in range(6) for i in range(4)]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, timestamp double, action array<double>, `observation.state` array<double>, `observation.joint_vel` double, task_index long")
    df.write.parquet(str(tmp_path / "data"))
    spark.createDataFrame([(0, "push"), (1, "pull")], "task_index long, task string").write.parquet(str(tmp_path / "meta/tasks.parquet"))
    frames_ = lerobot.scan_frames(spark, str(tmp_path))
    assert {"obs_state", "obs_joint_velocity"} <= set(frames_.columns)
    s = lerobot.steps(frames_, lerobot.tasks(spark, str(tmp_path)), width=2, observations={"obs_state": 2, "obs_joint_velocity": 1})
    first = s.where("ep = 1 and step = 2").first()
    assert (first.a0, first.a1, first.s0, first.s1, first.s2, first.task) == (1.0, 2.0, 2.0, 1.0, 1.0, "pull")
    assert [tuple(r) for r in lerobot.episodes(frames_).collect()] == [(e, 4) for e in range(6)]
    meta = spark.createDataFrame([(e, f"t{e}") for e in range(6)], "episode_index long, note string")
    keep = spark.createDataFrame([(1,), (4,)], "episode_index long")
    lerobot.export(frames_, keep, str(tmp_path / "out"), meta)
    out = spark.read.parquet(str(tmp_path / "out/data"))
    assert {(r.episode_index, r["index"]) for r in out.collect()} == {(e, 4 * e + i) for e in (0, 1) for i in range(4)}
    assert {(r.episode_index, r.note) for r in spark.read.json(str(tmp_path / "out/meta/episodes.jsonl")).collect()} == {(0, "t1"), (1, "t4")}


def test_sidecar_is_written_with_its_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "keep", 0.1, 0.0, None, ["x"]), (2, "drop", 0.9, 0.5, None, [])], "episode_id long, disposition string, quality_risk double, anomaly double, coverage_value double, integrity_flags array<string>")
    evidence.write_annotations(rows, str(tmp_path / "a"), "mine", parquet=True)
    lines = [json.loads(x) for p in (tmp_path / "a/annotations").glob("part-*") for x in p.read_text().splitlines()]
    assert {x["episode_id"] for x in lines} == {1, 2}
    assert spark.read.parquet(str(tmp_path / "a/annotations_parquet")).count() == 2
    assert {(r.disposition, r.n) for r in spark.read.json(str(tmp_path / "a/manifest")).collect()} == {("keep", 1), ("drop", 1)}


def test_limits_of_a_robot(spark):
    urdf = '<robot><joint name="a" type="revolute"><limit lower="-1" upper="1" velocity="2"/></joint><joint name="b" type="fixed"/><joint name="c" type="prismatic"><limit upper="3"/></joint></robot>'
    assert [tuple(r) for r in limits.parse_limits(spark, urdf).collect()] == [("a", -1.0, 1.0, 2.0), ("c", None, 3.0, None)]
    df = steps_of(spark, {1: (np.arange(5) * 1.0, np.array([-2.0, 0.0, 0.5, 4.0, 4.0]), np.zeros(5))})
    r = limits.limit_violations(df, {"a": "a0"}, limits.parse_limits(spark, urdf)).first()
    assert (r.under, r.over, r.too_fast) == (0.2, 0.4, 0.25)


def test_views_that_contradict_names(spark):
    rows = [(e, c, r) for c, rs in {"camera_top": (0.7, 0.8, 0.6), "wrist_cam": (0.4, 0.5, 0.45), "camera_side": (0.1, 0.0, 0.2), "images.laptop": (0.9, 0.9, 0.9), "front": (0.9, None, 0.9)}.items() for e, r in enumerate(rs)]
    got = {r.camera: (r.declared, r.level) for r in frames.camera_mismatch(spark.createDataFrame(rows, "ep long, camera string, r double")).collect()}
    assert got == {"camera_top": ("static", "WARNING"), "wrist_cam": ("moving", "WARNING"), "camera_side": ("static", "OK"), "images.laptop": ("unknown", "INFO")}
    low = [(e, c, r) for c, r in (("wrist_cam", 0.1), ("camera_top", 0.05), ("camera_side", 0.6)) for e in range(3)]
    got = {r.camera: r.level for r in frames.camera_mismatch(spark.createDataFrame(low[:6], "ep long, camera string, r double")).collect()}
    assert got == {"wrist_cam": "INFO", "camera_top": "OK"}
    assert {r.camera: r.level for r in frames.camera_mismatch(spark.createDataFrame(low, "ep long, camera string, r double")).collect()} == {"wrist_cam": "WARNING", "camera_top": "OK", "camera_side": "WARNING"}


def test_lags_equal_full_correlation(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for e, (n, shift) in enumerate([(2, 0), (8, 0), (30, 4), (30, -3), (12, 0)]):
        x = rng.normal(size=n + 10)
        a, b = x[5 : 5 + n], x[5 - shift : 5 - shift + n]
        if e == 4:
            b = np.ones(n)
        rows += [(e, i, float(p), float(q)) for i, (p, q) in enumerate(zip(a, b))]
        if n >= 3 and b.std() > 0:
            full = np.correlate((a - a.mean()) / a.std(), (b - b.mean()) / b.std(), "full")
            want[e] = int(full.argmax()) - (n - 1)
        else:
            want[e] = None
    got = {r.ep: r.lag for r in frames.correlation_lags(spark.createDataFrame(rows, "ep long, step long, x double, y double"), "x", "y").collect()}
    assert got == want


def test_ladders_and_ranks(spark):
    names = "hz double, ldlj double, mean_length double, n_dims int"
    one, other = spark.createDataFrame([(50.0, -5.0, 100.0, 7)], names), spark.createDataFrame([(20.0, None, 90.0, 7)], names)
    got = {r.aspect: r.level for r in policies.transfer(one, other).collect()}
    assert got == {"action_dims": "DIRECT", "frequency": "ADAPT", "smoothness": "ADAPT", "episode_length": "DIRECT", "overall": "ADAPT"}
    wide, narrow = spark.createDataFrame([(50.0, -5.0, 100.0, 8)], names), spark.createDataFrame([(50.0, -5.0, 100.0, 6)], names)
    assert {r.aspect: r.level for r in policies.transfer(wide, one).collect()}["action_dims"] == "ADAPT"
    assert {r.aspect: r.level for r in policies.transfer(narrow, one).collect()}["overall"] == "DIFFICULT"
    a = spark.createDataFrame([(0.0, 5.0, 1.0), (10.0, 6.0, 1.0)], "x double, y double, z double")
    b = spark.createDataFrame([(5.0, 0.0, 3.0), (15.0, 10.0, 3.0)], "x double, y double, z double")
    share = policies.range_covered(a, b, ("x", "y", "z"), ("x", "y", "z"))
    assert share.first().covered == pytest.approx((0.5 + 0.1) / 2)
    assert {r.aspect: r.level for r in policies.transfer(one, other, share).collect()}["action_range"] == "DIFFICULT"
    r = spark.range(1).select(policies.landmark_rank(F.lit(15.0), F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(None).cast("double")).alias("x"), policies.direction(F.lit("mean_LDLJ"), F.lit(1.0)).alias("d"), policies.drift_level(F.lit("degraded"), F.lit(True), F.lit("CRITICAL")).alias("l")).first()
    assert (r.x, r.d, r.l) == (None, "improved", "CRITICAL")


def test_pairs_chosen_by_gate_and_coverage(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 2))
    fp = spark.createDataFrame([(i, i % 4 > 0) for i in range(40)], "ep long, passed boolean")
    emb = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "ep long, u double, v double")
    got = {r.ep: r.decision for r in selection.select_pairs(fp, emb, ["u", "v"], 0.25).collect()}
    assert sum(d == "keep" for d in got.values()) == 10 and all(d == "quality_fail" for e, d in got.items() if e % 4 == 0)


def test_vectors_of_the_submovement_figure(spark):
    """One smooth reach has one sub-movement, whose figure is that of the whole."""
    t = np.linspace(0, 1, 101)
    x = 10 * t**3 - 15 * t**4 + 6 * t**5
    df = steps_of(spark, {1: (t, x, x)})
    got = motion.submovement_ldlj(df, ("a0",)).first().ldlj
    dt = 0.01
    v = np.diff(x) / dt
    j = np.diff(v, 2) / dt**2
    want = -np.log((len(v) * dt) ** 3 / v.max() ** 2 * (j**2).sum() * dt)
    assert got == pytest.approx(want, rel=0.05)


def test_coverage_features_of_one_dimension(walks):
    _, steps = walks
    f = coverage.episode_features(steps, ("a0",))
    assert f.where("ep = 1").first().d_a0 == 0.0
