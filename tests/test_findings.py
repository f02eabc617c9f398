"""What reviewers found at other sizes, on small data."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from episight.functions.exprs import out
from episight.operators import clusters, gates, leakage, limits, moments, neighbours, policies
from episight.streaming import session


def counted(spark, rows):
    """``rows``, and an accumulator of how many were computed."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return rows.mapInArrow(run, rows.schema), seen


def test_clusters_compute_their_features_once(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rng.random((60, 3)))], "ep long, a double, b double, c double")
    plain = clusters.trajectory_diversity(rows, ["a", "b", "c"]).first()
    f, seen = counted(spark, rows)
    assert clusters.trajectory_diversity(f, ["a", "b", "c"]).first() == pytest.approx(plain)
    assert 60 <= seen.value <= 120


def test_gaps_compute_their_features_once(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rng.random((60, 2)) ** 2)], "ep long, a double, b double")
    plain = clusters.coverage_gaps(rows, ["a", "b"], 3).collect()
    f, seen = counted(spark, rows)
    assert plain and clusters.coverage_gaps(f, ["a", "b"], 3).collect() == plain
    assert 60 <= seen.value <= 120


#: Risks whose score lies on a half that doubles don't hold.
HALVES = [0.3605, 0.3665, 0.3705, 0.3765, 0.3805, 0.25, 0.12345]


def sql_scores():
    return [r[0] for r in duckdb.sql(f"select round(100 * (1 - r), 1) from (select unnest({HALVES}::double[]) as r)").fetchall()]


def test_headline_scores_round_as_sql(spark):
    a = spark.createDataFrame([(i, r, 0.0) for i, r in enumerate(HALVES)], "ep long, quality_risk double, coverage_value double")
    assert [r.score for r in policies.headline_scores(a).orderBy("ep").collect()] == sql_scores()


def test_characterised_scores_round_as_sql(spark):
    n = len(HALVES)
    gate = spark.createDataFrame([(i, "", "clean") for i in range(n)], "ep long, reasons string, status string")
    a = spark.createDataFrame([(i, r, 0.0, 0.5) for i, r in enumerate(HALVES)], "ep long, quality_risk double, anomaly double, coverage_value double")
    got = gates.characterised(gate, gate.select("ep"), gate.selectExpr("ep", "10L as n_steps"), a)
    assert [r.score for r in got.orderBy("ep").collect()] == sql_scores()


def test_moves_at_the_limit_are_within_it(spark):
    """A steady clock in doubles; every move is exactly as fast as the joint may."""
    steps = spark.createDataFrame([(1, i, i * 0.02, 30.0 * (i % 2)) for i in range(695)], "ep long, step long, t double, a0 double")
    top = spark.createDataFrame([("lift", 0.0, 30.0, 1500.0)], limits.SCHEMA)
    r = limits.limit_violations(steps, {"lift": "a0"}, top).first()
    assert (r.under, r.over, r.too_fast) == (0.0, 0.0, 0.0)


def test_shown_figures_round_as_sql(spark):
    shares = [k / 640 for k in range(641)] + [-41 / 640, 1e9 + 0.0000005]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(shares)], "i long, x double").select("i", out(F.col("x")).alias("x"))
    want = [r[0] for r in duckdb.sql(f"select round(x, 6) + 0.0 from (select unnest({shares}::double[]) as x)").fetchall()]
    assert [r.x for r in got.orderBy("i").collect()] == want


def test_sessions_are_whole_or_an_error(spark, tmp_path):
    """A stream that takes longer than it may isn't read half way."""
    rows = [("s", e, i, i * 0.05, float((e * i) % 7), float(i % 5)) for e in range(40) for i in range(12)]
    spark.createDataFrame(rows, session.STEPS).repartition(4, "ep").write.parquet(str(tmp_path / "in"))
    with pytest.raises(TimeoutError):
        session.run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), timeout=1)
    log = session.run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted(r.ep for r in log.where("kind = 'episode'").collect()) == list(range(40))


def test_errors_of_many_are_those_of_each():
    rng = np.random.default_rng(4)
    u = [np.c_[rng.normal(size=(k, 2)) + 3, np.ones(k), rng.normal(size=k)] for k in (0, 1, 5, 30)]
    m = np.array([x.T @ x for x in u])
    model = moments.Forecast(m.sum(0), 1)
    assert model.errors(m) == pytest.approx([model.error(x) for x in m], abs=1e-12)


def test_queries_are_not_sent_to_each_list(spark, monkeypatch):
    """Without structure a query needs almost all lists; what is written must not grow with them."""
    monkeypatch.setattr(neighbours, "LIST", 10)
    seen, search = [], neighbours._search

    def counted(rows, *rest):
        seen.append(rows.where("kind = 1").count())
        return search(rows, *rest)

    monkeypatch.setattr(neighbours, "_search", counted)
    v = np.random.default_rng(3).standard_normal((300, 12))
    cols = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(v)], f"ep long, {', '.join(c + ' double' for c in cols)}")
    got = {r.ep: r.neighbour for r in neighbours.nearest(df, df, cols, exclude_self=True).collect()}
    d = ((v[:, None] - v[None]) ** 2).sum(2) + np.diag(np.full(300, np.inf))
    assert got == dict(enumerate(d.argmin(1).tolist()))
    assert len(seen) == 2 and max(seen) <= 300


def test_blocks_are_exact_far_from_the_origin():
    """Products lose all digits there; differences decide."""
    rng = np.random.default_rng(8)
    y = 1e8 + np.round(rng.standard_normal((500, 5)) * 4) / 4
    x = np.concatenate([y[:200], 1e8 + rng.standard_normal((100, 5))])
    q, own = np.r_[np.arange(200), np.arange(1000, 1100)], np.arange(500)
    best, name = np.full(300, np.inf), np.full(300, np.iinfo(np.int64).max)
    neighbours._better(q, x, best, name, (own, y, np.full(500, neighbours.NONE)), True)
    d = np.where(q[:, None] == own, np.inf, neighbours._squares(x, y))
    assert (best == d.min(1)).all() and (name == d.argmin(1)).all()


def test_leakage_sends_no_query_to_each_list(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 10)
    seen, search = [], neighbours._search

    def counted(rows, *rest):
        seen.append(rows.where("kind = 1").count())
        return search(rows, *rest)

    monkeypatch.setattr(neighbours, "_search", counted)
    rng = np.random.default_rng(9)
    rows = [(e, i, float(rng.normal()), float(rng.normal())) for e in range(120) for i in range(8)]
    steps = spark.createDataFrame(rows, "ep long, step long, a0 double, s0 double")
    pairs, one = leakage.near_leakage(steps, leakage.held(steps, leakage.holdout(spark, "0:5")), ("a0", "s0"), 8)
    assert one.first().n_train == 115 and max(seen) <= 115
