"""Quantiles, ranks and neighbours in an order against numpy."""

import numpy as np
import pytest

from episight.operators import dynamics, order


@pytest.mark.parametrize("shape", ["normal", "ties", "wide", "one", "two"])
@pytest.mark.parametrize("fine", [50_000, 5])
def test_quantiles_equal_numpy(spark, shape, fine):
    rng = np.random.default_rng(1)
    x = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 4, 2000).astype(float), "wide": np.exp(rng.normal(size=1500) * 40), "one": np.array([3.0]), "two": np.array([1.0, 2.0])}[shape]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(3)
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    assert order.exact_quantiles(df, "v", shares, fine) == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-9)
    assert order.exact_quantiles(df.limit(0), "v", shares) is None


def test_counts_below(spark):
    rng = np.random.default_rng(2)
    v, q = rng.integers(0, 50, 500).astype(float), rng.integers(-5, 60, 80) / 2
    values = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(4)
    asked = spark.createDataFrame([(i, float(x)) for i, x in enumerate(q)], "k long, v double")
    got = {r.k: r.below for r in order.counted_below(values, asked, "v", "k").collect()}
    assert got == {i: int((v < x).sum()) for i, x in enumerate(q)}
    assert {r.below for r in order.counted_below(values.limit(0), asked, "v", "k").collect()} == {0}


def test_previous_values(spark):
    x = np.random.default_rng(3).permutation(400)[:150].tolist()
    got = {r.v: r.p for r in order.with_previous(spark.createDataFrame([(v,) for v in x], "v long").repartition(5), "v", "p").collect()}
    s = sorted(x)
    assert got == dict(zip(s, [None, *s[:-1]]))


def test_permutations_equal_sorting_each_split(spark):
    import hashlib

    rng = np.random.default_rng(4)
    a = [(e, "m", float(v)) for e, v in enumerate(rng.normal(0, 1, 60))]
    b = [(e, "m", float(v)) for e, v in enumerate(rng.normal(0.4, 1, 45))]
    got = dynamics.permutation_tests(spark.createDataFrame(a, "ep long, metric string, value double"), spark.createDataFrame(b, "ep long, metric string, value double")).first()
    rows = [("a", *r) for r in a] + [("b", *r) for r in b]
    delta = np.mean([r[2] for r in b]) - np.mean([r[2] for r in a])
    hits = 0
    for draw in range(199):
        s = sorted(rows, key=lambda r: (hashlib.md5(f"42|{draw}|{r[0]}|{r[1]}".encode()).hexdigest(), r[1]))
        x = np.array([r[3] for r in s])
        hits += abs(x[60:].mean() - x[:60].mean()) >= abs(delta) - 1e-12
    assert (got.delta, got.p_value) == (pytest.approx(delta), pytest.approx(hits / 199))
