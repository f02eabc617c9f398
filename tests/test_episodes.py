"""Per-episode figures against NumPy on episodes of every short length."""

import numpy as np
import pytest

from episight.operators import coverage, motion, tasks, timing


def frame(spark, episodes):
    rows = [(k, i, float(t), float(a), float(s)) for k, (ts, xs) in enumerate(episodes) for i, (t, a, s) in enumerate(zip(ts, xs, np.roll(xs, 1)))]
    return spark.createDataFrame(rows, "ep long, step int, t double, a0 double, s0 double")


@pytest.fixture(scope="module")
def episodes():
    rng = np.random.default_rng(5)
    out = [(np.cumsum(rng.random(n)), rng.normal(size=n)) for n in (1, 2, 3, 4, 5, 9, 40)]
    out.append((np.arange(20) * 0.1, np.ones(20)))  # constant
    out.append((np.zeros(6), rng.normal(size=6)))  # a clock that stands still
    return out


def test_jitter_and_dropout(spark, episodes):
    got = {r.ep: r for r in timing.timing_metrics(frame(spark, episodes)).collect()}
    for k, (t, _) in enumerate(episodes):
        dt = np.diff(t)
        if len(t) < 3 or dt.mean() <= 0:
            assert got[k].jitter_cv is None and got[k].dropout == 0.0
        else:
            assert got[k].jitter_cv == pytest.approx(dt.std() / dt.mean())
            assert got[k].dropout == pytest.approx((dt > 3 * np.median(dt)).mean())


def test_spikes_and_discontinuities(spark, episodes):
    got = {r.ep: r for r in motion.motion_metrics(frame(spark, episodes)).collect()}
    for k, (t, x) in enumerate(episodes):
        runs = len(t) > 1 and np.median(np.diff(t)) > 0
        j, v, dv = np.abs(np.diff(x, n=3)), np.abs(np.diff(x)), np.abs(np.diff(x, n=2))
        if not runs or len(x) < 5:
            assert got[k].spike_rate is None
        else:
            assert got[k].spike_rate == pytest.approx((j > 5 * np.median(j)).mean() if np.median(j) > 1e-12 else 0.0)
        if not runs or len(x) < 3:
            assert got[k].disc_rate is None
        else:
            assert got[k].disc_rate == pytest.approx((dv > 0.2 * v.max()).mean() if v.max() > 1e-12 else 0.0)


def test_submovement_jerk_is_null_or_finite(spark, episodes):
    got = {r.ep: r.ldlj for r in motion.submovement_ldlj(frame(spark, episodes), ("a0",)).collect()}
    assert got[0] is None and got[7] is None
    assert all(x is None or np.isfinite(x) for x in got.values())


def test_entropy_of_a_constant_is_zero_and_matches_numpy(spark, episodes):
    got = {r.ep: r.entropy for r in coverage.trajectory_entropy(frame(spark, episodes), ("a0",)).collect()}
    for k, (_, x) in enumerate(episodes):
        n = np.histogram(x, 20)[0]
        p = n[n > 0] / n.sum()
        assert got[k] == pytest.approx(-(p * np.log2(p)).sum() + 0.0, abs=1e-12)


def test_runs(spark):
    mask = [0, 1, 1, 0, 1, 1, 1, 0, 1]
    df = spark.createDataFrame([(0, i, float(m)) for i, m in enumerate(mask)] + [(1, 0, 0.0)], "ep long, step int, a0 double")
    from pyspark.sql import functions as F

    got = {r.ep: r for r in tasks.sustained_runs(df, F.col("a0") > 0, 2).collect()}
    assert (got[0].longest, got[0].first_run, got[0].last_run) == (3, 1, 6)
    assert (got[1].longest, got[1].first_run, got[1].last_run) == (0, None, None)


def test_empty_table(spark):
    df = spark.createDataFrame([], "ep long, step int, t double, a0 double, s0 double")
    assert timing.timing_metrics(df).count() == motion.motion_metrics(df).count() == 0
    assert coverage.trajectory_entropy(df, ("a0",)).count() == 0
