"""The walk of a minimal distance against a plain loop, whatever the partitions, and its figures against numpy."""

import numpy as np
import pytest

from episight.operators import latent


def plain(episodes, eps):
    out = []
    for e, (z, a) in sorted(episodes.items()):
        t = 0
        while t < len(z) - 1:
            n = t + 1
            while n < len(z) and np.sqrt(((z[n] - z[t]) ** 2).sum()) <= eps:
                n += 1
            if n < len(z):
                out.append((e, t, n, *z[t], *a[t:n].mean(0), *(z[n] - z[t])))
            t = n
    return np.array(out)


def made(seed, lengths):
    rng = np.random.default_rng(seed)
    return {e: (np.cumsum(rng.normal(size=(n, 2)) * rng.choice([0.01, 1.0], (n, 1)), axis=0), rng.normal(size=(n, 1))) for e, n in enumerate(lengths)}


def frame(spark, episodes):
    rows = [(e, i, float(z[i][0]), float(z[i][1]), float(a[i][0])) for e, (z, a) in episodes.items() for i in range(len(z))]
    return spark.createDataFrame(rows, "ep long, step long, s0 double, s1 double, a0 double").repartition(3)


@pytest.mark.parametrize("lengths", [[30, 1, 2, 55], [900], [5, 400, 3, 300, 1], [1], [2]])
@pytest.mark.parametrize("partitions", [1, 3, 11])
def test_walk_equals_a_plain_loop(spark, lengths, partitions):
    episodes = made(len(lengths) + partitions, lengths)
    for eps in (0.5, 3.0):
        got = latent.walk(frame(spark, episodes), ("s0", "s1"), ("a0",), eps, partitions).collect()
        got = np.array(sorted([r.ep, r.start, r.end, *r.z, *r.a, *r.d] for r in got))
        want = plain(episodes, eps)
        assert got.shape == want.shape and np.allclose(got, want)


def test_epsilon_and_single_steps(spark):
    episodes = made(1, [20, 30])
    df = frame(spark, episodes)
    far = np.concatenate([np.linalg.norm(np.diff(z, axis=0), axis=1) for z, _ in episodes.values()])
    assert latent.epsilon(df, ("s0", "s1")) == pytest.approx(3 * np.median(far))
    assert latent.single_steps(df, ("s0", "s1"), ("a0",)).count() == 48


def test_dynamics_against_numpy(spark):
    episodes = made(7, [200, 150, 90])
    df = frame(spark, episodes)
    got = latent.dynamics(df, latent.walk(df, ("s0", "s1"), ("a0",), 1.0), ("s0", "s1"), ("a0",)).first()
    t = plain(episodes, 1.0)
    z, a, d = t[:, 3:5], t[:, 5:6], t[:, 6:8]

    def ridge(x):
        x = np.hstack([x, np.ones((len(x), 1))])
        r = d - x @ np.linalg.solve(x.T @ x + 1e-4 * np.eye(x.shape[1]), x.T @ d)
        return r, 1 - (r**2).sum() / ((d - d.mean(0)) ** 2).sum()

    res, r2 = ridge(np.hstack([z, a]))
    assert (got.predictability, got.controllability) == (pytest.approx(r2), pytest.approx(ridge(a)[1]))
    norm = np.linalg.norm(res, axis=1)
    mad = max(np.median(np.abs(norm - np.median(norm))), 1e-6)
    assert got.n_transitions == len(t) and got.n_outliers == (norm > np.median(norm) + 3.5 * mad).sum()

    def axes(x, k):
        x = x - x.mean(0)
        return x @ np.linalg.svd(x, full_matrices=False)[2][:k].T

    def entropy(x):
        h = np.histogram2d(*axes(x, 2).T, bins=20)[0].ravel()
        p = h[h > 0] / h.sum()
        return -(p * np.log2(p)).sum()

    states = np.concatenate([z for z, _ in episodes.values()])
    assert got.state_entropy == pytest.approx(entropy(states), abs=0.02) and got.transition_entropy == pytest.approx(entropy(d), abs=0.02)
    voxel = lambda x, k: 1 - len({tuple(r) for r in np.round(axes(x, k) / 0.5)}) / len(x)
    assert got.transition_redundancy == pytest.approx(voxel(np.hstack([z, a, d]), 3), abs=0.02)
    levels = {r.metric: r.level for r in latent.dynamics_flags(latent.dynamics(df, latent.walk(df, ("s0", "s1"), ("a0",), 1.0), ("s0", "s1"), ("a0",))).collect()}
    assert levels["dynamics_predictability_r2"] == ("WARNING" if r2 < 0.2 else "OK") and len(levels) == 4
