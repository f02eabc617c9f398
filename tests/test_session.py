"""Stateful sessions over several starts against one batch, and models from moments against least squares on rows."""

import numpy as np
import pytest

from episight.operators import moments, surprise
from episight.streaming import session


def arriving(spark, path, eps, seed=3):
    rng = np.random.default_rng(seed)
    for e in eps:
        n = int(rng.integers(12, 30))
        s = np.cumsum(rng.normal(size=n)) + e
        rows = [("one" if e % 3 else "two", e, i, i * 0.05, float(a), float(x)) for i, (a, x) in enumerate(zip(rng.normal(size=n), s))]
        spark.createDataFrame(rows, session.STEPS).coalesce(1).write.mode("append").parquet(path)


def test_restarts_give_the_batch_result(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for start, eps in enumerate([range(1, 7), range(7, 9), range(9, 26)]):
        arriving(spark, path, eps, seed=start)
        log = session.run_available(spark, path, out)
    steps = spark.read.schema(session.STEPS).parquet(path)
    for name in ("one", "two"):
        got = log.where(f"session = '{name}'").collect()
        order = [r.ep for r in sorted(got, key=lambda r: r.seq) if r.kind == "episode"]
        assert sorted(order) == [e for e in range(1, 26) if (e % 3 > 0) == (name == "one")]
        fits = {r.fitted for r in got if r.kind == "score"}
        assert fits == {n for n in range(5, len(order) + 1, 5)}
        for n in fits:
            want = {r.ep: r.surprise for r in surprise.surprise(steps.where(steps.ep.isin(order[:n])), ("s0",), ("a0",)).collect()}
            have = {r.ep: r.surprise for r in got if r.fitted == n}
            assert have == pytest.approx(want, abs=1e-6) and all(r.label == session.label(r.surprise) for r in got if r.fitted == n)
    judged = session.summaries(steps).groupBy("session", "verdict").count().collect()
    want = {(r.session, r.verdict): r["count"] for r in judged}
    for r in session.counters(log).collect():
        assert (r.n_pass, r.n_warn, r.n_fail) == tuple(want.get((r.session, v), 0) for v in ("PASS", "WARN", "FAIL"))


def test_files_delivered_twice_change_nothing(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    arriving(spark, path, range(1, 6), seed=1)
    before = session.counters(session.run_available(spark, path, out)).collect()
    spark.read.schema(session.STEPS).parquet(path).coalesce(1).write.mode("append").parquet(path)  # all again, in one file
    log = session.run_available(spark, path, out)
    assert session.counters(log).collect() == before
    assert log.where("kind = 'episode'").count() == 5


def test_labels():
    assert [session.label(x) for x in (None, 0.0, 0.35, 0.65)] == ["learning", "redundant", "familiar", "novel"]


def test_models_from_moments_equal_least_squares(spark):
    rng = np.random.default_rng(5)
    rows = [(e, i, *map(float, rng.normal(size=5) + 10)) for e in range(6) for i in range(1 + 9 * e)]
    names = "ep long, step long, s0 double, s1 double, s2 double, a0 double, a1 double"
    rows.append((2, 19, None, 1.0, 1.0, 1.0, 1.0))
    steps = spark.createDataFrame(rows, names).repartition(3)
    parts = moments.moments(steps, ("s0", "s1", "s2"), ("a0", "a1"))
    assert {r.ep: r.n for r in parts.collect()} == {e: max(0, 9 * e) for e in range(6)}
    m = moments.total(parts)
    by = {}
    for r in sorted(r for r in rows if r[2] is not None):
        by.setdefault(r[0], []).append(r[2:])
    f = np.array([x for v in by.values() for x in v[:-1]])
    y = np.array([x[:3] for v in by.values() for x in v[1:]])
    w = np.linalg.solve(f.T @ f + 1e-4 * np.eye(5), f.T @ (y - f[:, :3]))
    assert np.allclose(moments.change_weights(m, 3), w, atol=1e-6)
    assert moments.change_rmse(m, w, 3) == pytest.approx(np.sqrt(np.mean((y - f[:, :3] - f @ w) ** 2)))
    for latent in (16, 2):
        want = {r.ep: r.surprise for r in surprise.surprise(steps.where("s0 is not null"), ("s0", "s1", "s2"), ("a0", "a1"), latent).collect()}
        model = moments.Forecast(m, 3, latent)
        got = moments.scaled_errors({r.ep: model.error(moments.matrix(r.moments)) for r in parts.collect()})
        assert got == pytest.approx(want, abs=1e-6)


def test_no_transitions(spark):
    one = spark.createDataFrame([(1, 0, 2.0, 3.0)], "ep long, step long, s0 double, a0 double")
    m = moments.total(moments.moments(one, ("s0",), ("a0",)))
    assert moments.Forecast(m, 1).error(m) == 0.0 and moments.change_rmse(m, moments.change_weights(m, 1), 1) == 0.0
