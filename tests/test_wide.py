"""Many data sets in one plan, observations and videos that differ by data set, and latent vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episight.operators import audit, embed, report
from episight.sources import capabilities, video


def many(spark, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for name, jitter in (("calm", 0.0), ("noisy", 0.02), ("late", 0.004)):
        for e in range(6):
            t = np.cumsum(0.05 + rng.normal(0, jitter, 40)) if jitter else np.arange(40) * 0.05
            a = np.sin(np.arange(40) / 6) + rng.normal(0, jitter, 40)
            rows += [(name, "r2", e, i, float(x), float(y)) for i, (x, y) in enumerate(zip(t, a))]
    return spark.createDataFrame(rows, "dataset string, revision string, ep long, step long, t double, a0 double").repartition(3)


def test_one_plan_equals_one_run_a_data_set(spark):
    steps = many(spark)
    got = {}
    for r in audit.flags(audit.figures(steps, ("a0",))).collect():
        got.setdefault(r.dataset, {})[r.metric] = (r.value, r.level)
    for name in ("calm", "noisy", "late"):
        alone = {r.metric: (r.value, r.level) for r in report.flags(steps.where(F.col("dataset") == name), ("a0",), ()).collect()}
        assert set(got[name]) == set(audit.LADDERS) | {"timestamp_non_monotonic"}
        for m, (value, level) in got[name].items():
            assert level == alone[m][1] and value == pytest.approx(alone[m][0])
    assert got["calm"]["timestamp_jitter_cv"][1] == "INFO"


def test_audited_revisions_are_left_out(spark):
    done = spark.createDataFrame([("calm", "r2"), ("late", "r1")], "dataset string, revision string")
    got = audit.audit(many(spark), ("a0",), done).orderBy("rank").collect()
    assert {r.dataset for r in got} == {"noisy", "late"} and [r.rank for r in got] == [1, 2] and all(r.n_episodes == 6 for r in got)
    assert {r.dataset for r in audit.audit(many(spark), ("a0",)).collect()} == {"calm", "noisy", "late"}


def test_first_keys(spark):
    rows = [("x", 1, 0, {"state": [1.0], "qpos": [2.0]}, [0.0]), ("x", 2, 0, {"proprio": [3.0, 4.0]}, [0.0]), ("y", 3, 0, {"qpos": [5.0]}, [0.0]), ("y", 3, 1, {}, [0.0]), ("z", 4, 0, None, [0.0]), ("z", 4, 1, {"force": [1.0]}, [0.0])]
    steps = spark.createDataFrame(rows, "dataset string, ep long, step long, obs map<string,array<double>>, action array<double>")
    assert {r.dataset: r.state_key for r in capabilities.state_keys(steps).collect()} == {"x": "proprio", "y": "qpos", "z": None}
    assert {(r.ep, r.step): r.state for r in capabilities.with_state(steps).collect()} == {(1, 0): None, (2, 0): [3.0, 4.0], (3, 0): [5.0], (3, 1): None, (4, 0): None, (4, 1): None}
    shaped = {r.ep: r.state_key for r in capabilities.shaped_state_keys(steps).collect()}
    assert shaped == {1: "state", 2: None, 3: None, 4: None}
    frames = spark.createDataFrame([(1, "force", 0, 0, 4), (1, "rgb", 1, 0, 4), (1, "Depth", 2, 0, 3), (1, "Depth", 2, 1, 3), (2, "image", 0, 0, 2), (2, "image", 0, 1, 2)], "ep long, camera string, place int, step long, n_dims int")
    assert [tuple(r) for r in capabilities.first_cameras(frames).collect()] == [(1, "Depth")]


def test_spans_of_shared_files(spark):
    meta = spark.createDataFrame(
        [(0, 10, 0, 0, 0.0, 1.0), (1, 10, 0, 0, 1.0, 2.0), (2, 10, 0, 0, 1.5, 2.5), (3, 10, 0, 0, 4.0, 5.0), (4, 30, 0, 1, 0.0, 1.0), (5, 10, None, None, None, None), (6, 10, 0, 1, 3.0, 3.0)],
        "episode_index long, length long, `videos/a/chunk_index` long, `videos/a/file_index` long, `videos/a/from_timestamp` double, `videos/a/to_timestamp` double",
    )
    spans = video.shared_files(meta, ["a", "b"], "v/{video_key}/{chunk_index:03d}/f{file_index:02d}.mp4")
    assert {r.path for r in spans.collect()} == {"v/a/000/f00.mp4", "v/a/000/f01.mp4"} and spans.count() == 6
    got = {(r.ep, r.problem): round(r.seconds, 6) for r in video.span_problems(spans, 10.0).collect()}
    assert got == {(2, "overlap"): 0.5, (3, "gap"): 1.5, (4, "length"): 2.0, (6, "empty"): 0.0, (6, "gap"): 2.0, (6, "length"): 1.0}
    files = video.one_file_an_episode(meta.select("episode_index", "length"), ["a"], "c{episode_chunk:02d}/{video_key}/e{episode_index:03d}%.mp4", 4)
    assert {r.path for r in files.where("ep = 6").collect()} == {"c01/a/e006%.mp4"}
    with pytest.raises(ValueError):
        video.shared_files(meta, ["b"], "x")
    with pytest.raises(ValueError):
        video.formatted("{what}", {})


def test_singular_directions_equal_a_plain_svd(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 60)) * 4 + rng.normal(size=(300, 60)) * 0.05 + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ep long, v array<double>").repartition(4)
    mean, values, directions = embed.singular_directions(df, "v", 3)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(mean, x.mean(0)) and np.allclose(values, s[:3], rtol=1e-6)
    assert np.allclose(np.abs((directions * vt[:3]).sum(1)), 1, atol=1e-6)
    got = {(r.ep, r.component): r.value for r in embed.reduced(df, "v", 3).collect()}
    want = (x - x.mean(0)) @ directions.T
    assert all(got[i, k] == pytest.approx(want[i, k]) for i in range(300) for k in range(3))


def test_projected_embeddings_equal_the_definition(spark):
    rng = np.random.default_rng(4)
    eps = {e: rng.normal(size=(n, 3)) for e, n in enumerate([1, 5, 40])}
    steps = spark.createDataFrame([(e, i, *map(float, r)) for e, v in eps.items() for i, r in enumerate(v)], "ep long, step long, x double, y double, z double").repartition(3)
    p = np.random.default_rng(42 + 3).normal(size=(3, 64))
    for r in embed.projected(steps, ("x", "y", "z")).collect():
        want = (eps[r.ep] @ p).mean(0) + (eps[r.ep] @ p).std(0)
        assert r.embedding == pytest.approx((want / np.linalg.norm(want)).tolist(), abs=1e-7)
    few = embed.novelty(embed.projected(steps.where("ep = 1"), ("x", "y", "z")))
    assert few.count() == 0


def test_content_hashes_are_of_the_floats(spark):
    import hashlib

    from episight.operators import dynamics

    rng = np.random.default_rng(9)
    eps = {e: rng.normal(size=(n, 3)) for e, n in enumerate([1, 4, 500])}
    rows = [(e, i, *map(float, r)) for e, v in eps.items() for i, r in enumerate(v)]
    steps = spark.createDataFrame(rows, "ep long, step long, t double, a0 double, a1 double").repartition(5)
    want = {e: hashlib.sha256(v[:, 0].astype("<f4").tobytes() + v[:, 1:].astype("<f4").tobytes()).hexdigest()[:16] for e, v in eps.items()}
    assert {r.ep: r.hash for r in dynamics.content_hashes(steps, ("a0", "a1")).collect()} == want


def test_reports_side_by_side(spark):
    from episight.operators import policies

    a = spark.createDataFrame([("jerk_spike_rate", 0.01, "OK", 0.005, 0.015), ("ldlj", -10.0, "OK", None, None), ("only_here", 1.0, "OK", None, None), ("timestamp_jitter_cv", 0.0, "OK", None, None)], "metric string, value double, level string, low double, high double")
    b = spark.createDataFrame([("jerk_spike_rate", 0.05, "CRITICAL", 0.03, 0.07), ("ldlj", -12.0, "WARNING", None, None), ("timestamp_jitter_cv", 0.2, "WARNING", None, None)], "metric string, value double, level string, low double, high double")
    tests = spark.createDataFrame([("ldlj", 0.2), ("timestamp_jitter_cv", 0.01)], "metric string, p_value double")
    got = {r.metric: (r.significant, r.direction, r.level, r.relative_change) for r in policies.compare_reports(a, b, tests).collect()}
    assert got == {"jerk_spike_rate": (True, "degraded", "CRITICAL", pytest.approx(4.0)), "ldlj": (False, "degraded", "INFO", pytest.approx(-0.2)), "timestamp_jitter_cv": (True, "degraded", "WARNING", None)}
