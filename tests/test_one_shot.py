import math

import numpy as np
import pytest

from episight.operators import dynamics, evidence, frames, gates, one_shot, scoring, sft, timing

FLAGS = "metric string, value double, level string"


def test_phase_bounds_and_interval(spark):
    def levels(contact, approach):
        p = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(zip(approach, contact))], "ep long, approach double, contact double")
        return {r.metric: r.level for r in one_shot.phase_flags(p).collect()}

    assert levels([0.05, 0.05], [0.9, 0.8]) == {"contact_phase_fraction": "CRITICAL", "approach_phase_dominance": "INFO"}
    assert levels([0.1, 0.1], [0.8, 0.8]) == {"contact_phase_fraction": "WARNING", "approach_phase_dominance": "OK"}
    assert levels([0.3, 0.1], [0.5, 0.5]) == {"contact_phase_fraction": "OK", "approach_phase_dominance": "OK"}
    assert levels([], []) == {}
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 0.5, 200)
    p = spark.createDataFrame([(i, 0.5, float(v)) for i, v in enumerate(x)], "ep long, approach double, contact double")
    got = {r.metric: r for r in one_shot.phase_flags(p, draws=500).collect()}
    c = got["contact_phase_fraction"]
    means = [rng.choice(x, len(x)).mean() for _ in range(2000)]
    assert c.low == pytest.approx(np.percentile(means, 2.5), abs=0.01)
    assert c.high == pytest.approx(np.percentile(means, 97.5), abs=0.01)
    assert got["approach_phase_dominance"].low is None


def test_copies_know_order_length_nulls_and_repeats(spark):
    episodes = {
        5: [(0, 1.0), (1, 2.0), (2, None)],
        2: [(0, 1.0), (1, 2.0), (2, None)],  # copy, earlier number
        9: [(0, 1.0), (1, 2.0), (2, None)],
        3: [(0, 2.0), (1, 1.0), (2, None)],  # another order
        4: [(0, 1.0), (1, 2.0)],  # shorter
        6: [(0, 1.0), (1, 2.0), (2, 0.0)],  # null is not 0
        7: [(0, 1.0), (0, 1.0), (1, 3.0), (1, 3.0)],  # repeated rows don't cancel
        8: [(0, 2.0), (0, 2.0), (1, 4.0), (1, 4.0)],
    }
    df = spark.createDataFrame([(e, s, a) for e, rows in episodes.items() for s, a in rows], "ep long, step long, a0 double")
    assert sorted(tuple(r) for r in one_shot.copies(df, ("a0",)).collect()) == [(5, 2), (9, 2)]
    (f,) = one_shot.copies_flag(df, ("a0",)).collect()
    assert (f.value, f.level) == (0.25, "CRITICAL")
    (f,) = one_shot.copies_flag(df.where("ep not in (5, 9)"), ("a0",)).collect()
    assert (f.value, f.level) == (0.0, "OK")
    (f,) = one_shot.copies_flag(df.where("false"), ("a0",)).collect()
    assert (f.value, f.level) == (0.0, "OK")


def test_notes_leave_a_category_unjudged(spark):
    rows = [
        ("timestamp_jitter_cv", 0.1, "INFO"), ("camera_lag_std[top]", 1.0, "INFO"), ("short_episode_fraction", 0.0, "OK"), ("duplicate_episode_fraction", 0.1, "CRITICAL"),
        ("jerk_spike_rate", 0.03, "WARNING"), ("velocity_discontinuity_rate", 0.0, "OK"), ("ldlj", -30.0, "CRITICAL"),
    ]
    flagged = spark.createDataFrame(rows, FLAGS)
    got = {r.category: (r.n_flags, r.level) for r in one_shot.categories(flagged).collect()}
    assert got == {"Timestamps & sync": (2, None), "Episode structure": (2, "CRITICAL"), "Camera feed": (0, None), "Motion & control": (2, "WARNING")}
    # 1, 0, 0.5 and 1 of four: 62.5, rounded to even; ldlj isn't a question of trust
    assert tuple(one_shot.integrity(flagged).first()) == (62, "Critical")
    assert tuple(one_shot.integrity(flagged.where("level = 'INFO'")).first()) == (100, "Healthy")


@pytest.mark.parametrize("redundancy, n, want", [(None, 9, 0.5), (0.3, 9, 0.7), (0.01, 9, 0.85), (0.99, 9, 0.15), (0.3, 4, 0.5)])
def test_keep_fraction(spark, redundancy, n, want):
    one = one_shot.one_shot(spark.createDataFrame([], FLAGS), spark.createDataFrame([(redundancy,)], "redundancy double"), spark.range(n).withColumnRenamed("id", "ep")).first()
    assert (one.n_episodes, one.n_critical, one.n_warning, one.score, one.keep_fraction) == (n, 0, 0, 100, want)


def test_families_and_weights():
    assert [one_shot.family(p) for p in ("ACT", "pi0-fast", "Diffusion Policy", "octo")] == ["act", "act", "diffusion", "other"]
    assert one_shot.rules() == scoring.OUTCOME
    act = one_shot.rules("act", {"spike_rate": 10.0})
    assert act["spike_rate"] == (10.0, 25.0, 0.005, 0.01)
    assert act["contact"] == (10.0, 20.0, 0.04, 0.02)
    assert act["dropout"] == scoring.OUTCOME["dropout"]


def plain_outcome(figures, rules, scripted, similar):
    score, hits = 100.0, 0
    for k, (w, c, warn, crit) in rules.items():
        v = figures.get(k)
        if v is None:
            continue
        less = 0.4 if scripted and k in ("ldlj", "spike_rate", "disc_rate") else 1.0
        x = (v - warn) / (crit - warn)
        if x >= 0:
            score, hits = score - less * (w + (c - w) * min(x, 1)), hits + 1
    score = max(score, 0.0)
    weight, mixed = 0.0, score
    if similar:
        d = np.array([s[0] for s in similar])
        inv = 1 / (d + 1e-6)
        weight = 0.6 * min(1, len(d) / 5) * max(0, 1 - d.min() / 0.4)
        mixed = round((1 - weight) * score + weight * float((inv * [100 * s[1] for s in similar]).sum() / inv.sum()), 1)
    margin = min(15.0, 5 + 2.0 * hits) * (1 - 0.5 * weight)
    return score, mixed, weight, max(0, mixed - margin), min(100, mixed + margin)


@pytest.mark.parametrize("policy", [None, "act", "diffusion", "octo"])
@pytest.mark.parametrize("scripted", [False, True])
def test_prediction_by_policy_with_and_without_records(spark, policy, scripted):
    schema = "ldlj double, spike_rate double, disc_rate double, dropout double, jitter_cv double, entropy double, contact double"
    figures = {"ldlj": -12.0, "spike_rate": 0.03, "disc_rate": 0.06, "dropout": 0.0, "jitter_cv": 0.1, "entropy": 1.4, "contact": None}
    one = spark.createDataFrame([tuple(figures.values())], schema)
    rows = [(i, 0.2 + 0.1 * i, *[None if v is None else v * (1 + 0.05 * i) for v in figures.values()]) for i in range(3)]
    records = spark.createDataFrame(rows, f"ep long, success double, {schema}")
    rules = one_shot.rules(policy)
    scales = {"ldlj": 30, "spike_rate": 0.2, "disc_rate": 0.4, "dropout": 0.2, "jitter_cv": 0.5, "entropy": 6, "contact": 0.5}
    similar = [(math.sqrt(sum(((r[k + 2] or 0) - (v or 0)) ** 2 / scales[m] ** 2 for k, (m, v) in enumerate(figures.items()))), r[1]) for r in rows]
    for recs, sim in ((records, similar), (records.where("false"), [])):
        got = one_shot.predicted(one, recs, policy, scripted).first()
        want = plain_outcome(figures, rules, scripted, sim)
        assert (got.heuristic, got.score, got.weight, got.low, got.high) == pytest.approx(want, abs=0.06)


def test_rates_of_short_and_broken_clocks(spark):
    clocks = {0: [0.0], 1: [0.0, 0.5], 2: [3.0, 2.0, 1.0], 3: [0.0, 0.1, 0.2, 0.3, 1.3], 4: [1.0, 1.0, 1.0]}
    df = spark.createDataFrame([(e, s, t) for e, ts in clocks.items() for s, t in enumerate(ts)], "ep long, step long, t double")
    got = {r.ep: r for r in timing.frame_rate_summary(df).collect()}
    assert (got[0].n_frames, got[0].mean_fps, got[0].std_fps, got[0].cv, got[0].dropout_rate) == (1, 0, 0, 0, 0)
    assert (got[1].mean_fps, got[1].std_fps, got[1].cv, got[1].dropout_rate) == (2, 0, 0, 0)
    assert (got[2].cv, got[2].dropout_rate, got[2].mean_fps) == (0, 0, None)
    assert (got[4].cv, got[4].dropout_rate, got[4].mean_fps) == (0, 0, None)
    dt = np.diff(clocks[3])
    assert got[3].mean_fps == pytest.approx((1 / dt).mean()) and got[3].std_fps == pytest.approx((1 / dt).std())
    assert got[3].cv == pytest.approx(dt.std() / dt.mean()) and got[3].dropout_rate == 0.25


COLS = ["m_x", "d_x", "m_y", "d_y"]
FEATURES = "ep long, m_x double, d_x double, m_y double, d_y double"


def test_failures_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    train = np.concatenate([rng.uniform(0, 1, (150, 4)), 0.6 + rng.normal(0, 0.05, (150, 4)), np.tile([0.2, 0.2, 0.9, 0.9], (40, 1))])
    failed = np.concatenate([rng.uniform(0, 1, (40, 4)), train[[0, 160, 320]], [[0.0, 0.0, 0.0, 0.0], [0.3, 0.6, 0.9, 0.3]]])
    rows = lambda x: [(i, *map(float, r)) for i, r in enumerate(x)]
    extra = [(900, None, 0.1, 0.1, 0.1), (901, float("nan"), 0.1, 0.1, 0.1)]
    got = {r.ep: r for r in one_shot.diagnose(spark.createDataFrame(rows(failed) + extra, FEATURES), spark.createDataFrame(rows(train) + extra, FEATURES), COLS, 99.5).collect()}
    assert len(got) == len(failed) + 2
    seen = set()
    for i, f in enumerate(failed):
        d = np.sqrt(((train - f) ** 2).sum(1))
        close, near = int((d < 0.15).sum()), int((d < 0.30).sum())
        verdict = "COVERED" if close >= 3 else "PARTIAL" if near >= 1 else "MISSING"
        collect = {"COVERED": 0, "PARTIAL": max(0, 5 - close), "MISSING": 8}[verdict]
        seen.add(verdict)
        r = got[i]
        assert r.distance == pytest.approx(d.min(), abs=1e-9) and d[r.nearest] == pytest.approx(d.min(), abs=1e-9)
        assert (r.n_close, r.n_near, r.verdict, r.to_collect) == (close, near, verdict, collect)
        assert r.success_after == pytest.approx(round(min(100, 99.5 + min(0.5, collect * 0.03) / 0.15), 1) if collect else 99.5, abs=0.051)
    assert seen == {"COVERED", "PARTIAL", "MISSING"}
    for e in (900, 901):
        assert (got[e].n_close, got[e].verdict, got[e].to_collect, got[e].nearest) == (None, None, None, None)


def test_no_training_data_misses_everything(spark):
    failed = spark.createDataFrame([(1, 0.1, 0.1, 0.1, 0.1)], FEATURES)
    (r,) = one_shot.diagnose(failed, failed.where("false"), COLS, 50.0).collect()
    assert (r.nearest, r.verdict, r.to_collect) == (None, "MISSING", 8)


def test_failure_scales(spark):
    steps = spark.createDataFrame([(0, 0, 1.0, 5.0), (0, 1, 3.0, 5.0), (1, 0, 2.0, 2.0)], "ep long, step long, x double, y double")
    own = {r.ep: tuple(r)[1:] for r in one_shot.failure_features(steps, ("x", "y")).collect()}
    assert own[0] == pytest.approx((2 / 5, 1.0, 1 / 5, 0.0))  # means 2 and 5, deviations 1 and 0
    assert own[1] == pytest.approx((1.0, 1.0, 0.0, 0.0))
    span = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 0.5), (1, 4.0, 3.0, 0.0, 0.5)], "ep long, m_x double, m_y double, d_x double, d_y double")
    other = {r.ep: r for r in one_shot.failure_features(steps, ("x", "y"), span).collect()}
    assert (other[0].m_x, other[0].m_y, other[0].d_x, other[0].d_y) == (0.5, 1.0, 1.0, 0.0)
    focus = {(r.ep, r.dim): (r.low, r.high) for r in one_shot.collection_focus(steps, ("x", "y")).collect()}
    assert focus[0, "x"] == (0.5, 3.5) and focus[0, "y"] == (4.925, 5.075)


def test_characterised_episodes(spark):
    gate = spark.createDataFrame([(0, "", "clean"), (1, "spike_rate", "bad"), (2, "", "clean"), (3, "", "not_evaluated")], "ep long, reasons string, status string")
    assessed = spark.createDataFrame([(0, 0.1234, 0.0, 0.25), (1, 1.0, 0.9, None), (2, None, None, 0.5)], "ep long, quality_risk double, anomaly double, coverage_value double")
    lengths = spark.createDataFrame([(i, 10 * i) for i in range(3)], "ep long, n_steps long")
    got = {r.ep: r for r in gates.characterised(gate, spark.createDataFrame([(0,), (1,)], "ep long"), lengths, assessed, "downweight").collect()}
    assert [got[i].disposition for i in range(4)] == ["keep", "drop", "downweight", "review"]
    assert [got[i].score for i in range(4)] == [87.7, 0.0, None, None]
    assert [got[i].redundancy for i in range(4)] == [0.75, None, 0.5, None]
    assert [got[i].integrity_flags for i in range(4)] == ["", "spike_rate", "", ""]
    assert [got[i].n_steps for i in range(4)] == [0, 10, 20, None]


def test_detectors_take_nulls_as_silent(spark):
    schema = "ep long, stage1_fail boolean, video_fault boolean, short_outlier boolean, duplicate_of long, quality_risk double, anomaly double"
    rows = [(0, True, False, False, None, 0.5, 0.49), (1, None, None, None, None, None, None), (2, False, True, False, 7, 0.1, 0.5), (3, False, False, True, None, 0.1, 0.1)]
    got = {r.ep: r.asDict() for r in evidence.detectors(spark.createDataFrame(rows, schema)).collect()}
    fired = {e: {k for k, v in r.items() if v is True} for e, r in got.items()}
    assert fired == {0: {"flagged", "blocked", "stage1_fail", "quality_risk"}, 1: set(), 2: {"flagged", "blocked", "duplicate", "video_fault", "anomaly"}, 3: {"flagged", "short_outlier"}}
    assert all(v is not None for r in got.values() for v in r.values())


def test_transition_residuals_equal_a_plain_fit(spark):
    rng = np.random.default_rng(5)
    episodes = {e: rng.normal(size=(int(n), 4)) for e, n in enumerate((30, 2, 1, 45))}
    df = spark.createDataFrame([(e, s, *map(float, r)) for e, x in episodes.items() for s, r in enumerate(x)], "ep long, step long, s0 double, s1 double, a0 double, a1 double")
    x = np.concatenate([v[:-1] for v in episodes.values()])
    dy = np.concatenate([np.diff(v[:, :2], axis=0) for v in episodes.values()])
    w = np.linalg.solve(x.T @ x + 1e-4 * np.eye(4), x.T @ dy)
    left = dy - x @ w
    flag = dynamics.transition_flag(df, ("s0", "s1"), ("a0", "a1")).first()
    assert flag.value == pytest.approx(np.sqrt((left**2).mean())) and (flag.metric, flag.level) == ("dynamics_prediction_rmse", "INFO")
    per = {r.ep: r.error for r in dynamics.transition_errors(df, ("s0", "s1"), ("a0", "a1")).collect()}
    assert per[0] == pytest.approx(np.linalg.norm(left[:29], axis=1).mean()) and per[2] == 0.0
    assert dynamics.transition_flag(df.where("ep = 2"), ("s0", "s1"), ("a0", "a1")).count() == 0


def test_whole_text_figures(spark):
    schema = "coherence double, repetition double, template double, words double"
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 4.0), (2, 3.0, 5.0)], "ep long, x double, y double")
    fp = spark.createDataFrame([(0.2, 0.1, 0.0, 10.0), (None, 0.3, 0.2, 20.0)], schema)
    got = sft.whole_aggregate(fp, points, ["x", "y"]).first()
    assert tuple(got) == pytest.approx((0.2, 0.2, 0.1, 15.0, (5 + 1 + 1) / 3))
    assert tuple(sft.whole_aggregate(fp.where("false"), points.where("false"), ["x", "y"]).first()) == (0, 0, 0, 0, 0)
    assert sft.whole_aggregate(fp.where("coherence is null"), points, ["x", "y"]).first().coherence is None


def test_duplicate_rate_has_an_interval(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 0.3, 150)
    e = spark.createDataFrame([(i, 1.0, float(v), 0) for i, v in enumerate(x)] + [(999, 1.0, None, None)], "ep long, sharpness double, duplicate_fraction double, freeze_run long")
    got = {r.metric: r for r in frames.frame_flags(e, draws=500).collect()}
    means = [rng.choice(x, len(x)).mean() for _ in range(2000)]
    d = got["duplicate_frame_rate"]
    assert (d.low, d.high) == pytest.approx((np.percentile(means, 2.5), np.percentile(means, 97.5)), abs=0.01)
    assert d.value == pytest.approx(x.mean()) and got["camera_freeze_events"].low is None
    plain = {r.metric: tuple(r) for r in frames.frame_flags(e).collect()}
    assert plain == {m: (r.metric, r.value, r.level) for m, r in got.items()}
