"""Inverted lists against a search through everything."""

import numpy as np
import pytest

from episight.operators import neighbours


def brute(query, ref, exclude):
    keys = np.array(sorted(ref))
    v = np.array([ref[k] for k in keys])
    out = {}
    for q, x in query.items():
        d = ((v - x) ** 2).sum(1)
        if exclude:
            d = np.where(keys == q, np.inf, d)
        if np.isfinite(d).any():
            out[q] = (int(keys[d.argmin()]), float(np.sqrt(d.min() / v.shape[1])))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, *map(float, x)) for k, x in rows.items()], "ep long, x double, y double, z double").repartition(4)


@pytest.mark.parametrize("shape", ["scattered", "clusters", "grid", "copies"])
@pytest.mark.parametrize("sizes", [(1024, 4096), (40, 4096), (60, 15)])
def test_exact_whatever_the_lists(spark, monkeypatch, shape, sizes):
    monkeypatch.setattr(neighbours, "LIST", sizes[0])
    monkeypatch.setattr(neighbours, "BLOCK", sizes[1])
    rng = np.random.default_rng(6)
    n = 700
    v = rng.standard_normal((n, 3))
    if shape == "clusters":
        v = rng.standard_normal((9, 3))[rng.integers(0, 9, n)] * 50 + v * 0.1
    if shape == "grid":
        v = np.round(v * 2)
    if shape == "copies":
        v[rng.random(n) < 0.4] = 1.5
    keys = rng.permutation(2 * n)[:n] + 2**60
    ref = dict(zip(keys.tolist(), v))
    got = {r.ep: (r.neighbour, r.distance) for r in neighbours.nearest(frame(spark, ref), frame(spark, ref), ["x", "y", "z"], exclude_self=True).collect()}
    want = brute(ref, ref, True)
    assert {k: g[0] for k, g in got.items()} == {k: w[0] for k, w in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-12) for k in want)
    other = {k: rng.standard_normal(3) * 3 for k in range(50)}
    got = {r.ep: r.neighbour for r in neighbours.nearest(frame(spark, other), frame(spark, ref), ["x", "y", "z"]).collect()}
    assert got == {k: w[0] for k, w in brute(other, ref, False).items()}


def test_clusters_are_pruned(spark, monkeypatch):
    """With clusters far apart hardly a query is sent to a second list."""
    monkeypatch.setattr(neighbours, "LIST", 50)
    seen = []
    search = neighbours._search

    def counted(rows, *rest):
        seen.append(rows.where("kind = 1").count())
        return search(rows, *rest)

    monkeypatch.setattr(neighbours, "_search", counted)
    rng = np.random.default_rng(1)
    v = np.repeat(rng.standard_normal((20, 3)) * 1000, 50, axis=0) + rng.standard_normal((1000, 3)) * 0.01
    neighbours.nearest(frame(spark, dict(enumerate(v))), frame(spark, dict(enumerate(v))), ["x", "y", "z"], exclude_self=True).count()
    assert seen[0] == 1000 and seen[1] < 6000


def test_nulls_one_row_and_none(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, None, 1.0), (3, float("nan"), 0.0), (4, 3.0, 5.0)], "ep long, x double, y double")
    got = {r.ep: (r.neighbour, r.distance) for r in neighbours.nearest(df, df, ["x", "y"], exclude_self=True).collect()}
    assert got == {1: (4, pytest.approx(np.sqrt(25 / 2))), 4: (1, pytest.approx(np.sqrt(25 / 2)))}
    one = df.where("ep = 1")
    assert neighbours.nearest(one, one, ["x", "y"], exclude_self=True).count() == 0
    assert neighbours.nearest(one, one, ["x", "y"]).first().neighbour == 1
    none = neighbours.nearest(df, df.limit(0), ["x", "y"])
    assert none.columns == ["ep", "neighbour", "distance"] and none.count() == 0
