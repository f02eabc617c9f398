import numpy as np
import pytest

from episight.operators import dynamics, selection


def test_forecast_errors_vanish_for_linear_motion(spark):
    rng = np.random.default_rng(0)
    rows = []
    for ep in range(4):
        s = rng.normal()
        for i in range(30):
            a = rng.normal()
            rows.append((ep, i, i * 0.1, float(a), float(s)))
            s = 0.9 * s + 0.5 * a
    rows.append((9, 0, 0.0, 1.0, 1.0))
    got = {r.ep: r.error for r in dynamics.transition_errors(spark.createDataFrame(rows, "ep long, step int, t double, a0 double, s0 double")).collect()}
    assert got[9] == 0.0 and all(got[k] < 1e-4 for k in range(4))


def test_interpolation_equals_numpy(spark):
    t = np.array([0.0, 0.1, 0.25, 0.3, 0.7, 0.8])
    x = np.array([1.0, 2.0, -1.0, 0.0, 4.0, 4.0])
    df = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x))] + [(1, 0, 0.0, 1.0)], "ep long, step int, t double, a0 double")
    got = sorted((r.i, r.value) for r in dynamics.interpolate(df).collect())
    grid = np.linspace(t[0], t[-1], 6)  # the mean interval gives six even points, both ends among them
    assert [i for i, _ in got] == list(range(6))
    assert [v for _, v in got] == pytest.approx(list(np.interp(grid, t, x)))


def test_dropping_steps_keeps_the_wanted_number(spark):
    df = spark.createDataFrame([(e, i) for e, n in ((0, 50), (1, 2), (2, 1), (3, 7)) for i in range(n)], "ep long, step int")
    got = {}
    for r in dynamics.drop_steps(df, 0.3).collect():
        got[r.ep] = got.get(r.ep, 0) + 1
    assert got == {0: 35, 1: 2, 2: 1, 3: 4}


def test_bootstrap_interval_is_near_the_normal_one(spark):
    x = np.random.default_rng(3).normal(5, 2, 400)
    m = spark.createDataFrame([(i, "m", float(v)) for i, v in enumerate(x)], "ep long, metric string, value double")
    r = dynamics.bootstrap_means(m, draws=300).first()
    half = 1.96 * x.std() / 20
    assert r["mean"] == pytest.approx(x.mean()) and r["low"] == pytest.approx(x.mean() - half, abs=0.06) and r["high"] == pytest.approx(x.mean() + half, abs=0.06)


def test_outcomes_and_concentration(spark):
    recs = spark.createDataFrame([(0, 0.1, 0.1, None), (1, 0.1, 0.1, "p"), (2, 0.2, 0.4, None)], "ep long, spike_rate double, disc_rate double, policy string")
    q = spark.createDataFrame([(0.1, 0.14)], "spike_rate double, disc_rate double")
    got = [(r.ep, round(r.distance, 6)) for r in dynamics.similar_outcomes(recs, q, policy="p").collect()]
    assert got == [(1, 0.07), (0, 0.1)]
    flags = spark.createDataFrame([(1, "a"), (1, "b"), (3, "a"), (95, "a")], "ep long, metric string")
    assert tuple(dynamics.concentration(flags, 100).first()) == (3, 4, 1.0, "start")


def test_composed_core_set_covers_nearly_as_well(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.05, (150, 2)) for c in ((0, 0), (9, 0), (0, 9), (9, 9))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "ep long, x double, y double")
    picked = [r.ep for r in selection.k_center(df, ["x", "y"], 4, part=100).collect()]
    assert {p // 150 for p in picked} == {0, 1, 2, 3}


def test_k_center_is_exact_beyond_the_driver(spark):
    x = np.random.default_rng(5).normal(0, 1, (700, 3)).round(2)
    x[[20, 21]] = x[19]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "ep long, x double, y double, z double").repartition(5)
    got = [r.ep for r in selection.k_center_exact(df, ["x", "y", "z"], 45, max_exact=100).orderBy("rank").collect()]
    assert got == selection.greedy_cover(x, 45)
    assert [r.ep for r in selection.k_center(df, ["x", "y", "z"], 45, part=100).orderBy("rank").collect()] != got


@pytest.mark.parametrize("part, partitions", [(64, 1), (64, 5), (250, 3)])
def test_merge_tree_keeps_its_radius(spark, part, partitions):
    """Planted balls of radius 1 around far centres: the best radius for as many picks is at most 1."""
    rng = np.random.default_rng(part)
    k = 12
    centre = rng.normal(size=(k, 3)) * 100
    own = rng.integers(0, k, 3000)
    own[: k] = np.arange(k)
    off = rng.normal(size=(3000, 3))
    x = centre[own] + off / np.linalg.norm(off, axis=1, keepdims=True) * rng.random((3000, 1))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "ep long, a double, b double, c double").repartition(partitions)
    got = [r.ep for r in selection.k_center(df, ["a", "b", "c"], k, part=part).orderBy("rank").collect()]
    radius = np.sqrt(((x[:, None] - x[got][None]) ** 2).sum(2)).min(1).max()
    levels = selection.merge_levels(3000, k, part)
    assert levels >= 1 and len(set(got)) == k
    assert radius <= 2 * (levels + 1)
    assert {own[i] for i in got} == set(range(k))  # far balls can't share a pick within that radius
    with pytest.raises(ValueError):
        selection.merge_levels(3000, 40, 64)
