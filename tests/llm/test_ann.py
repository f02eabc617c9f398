"""Neighbours against brute force: recall, exact scores and order."""

import numpy as np
import pytest

from episight.llm import ann

SCHEMA = "vec_id long, embedding array<double>, label int, id int, v string, h string, rank string"


def usable(rows):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            seen[i] = min(seen.get(i, v), v)
    sizes = [len(v) for v in seen.values()]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    return {i: np.array(v, float) for i, v in seen.items() if len(v) == d}


def brute(rows, queries, k=20):
    ids = np.array(sorted(rows))
    v = np.array([rows[i] for i in ids])
    out = {}
    for q in queries:
        s = (v * rows[q]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def answer(df, queries, **options):
    got = {}
    for r in sorted(ann.nearest_neighbours(df, queries, **options).collect()):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert all([x[0] for x in g] == list(range(1, len(g) + 1)) for g in got.values())
    return {q: [x[1:] for x in g] for q, g in got.items()}


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / max(1, sum(map(len, want.values())))


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, "v", "h", "r") for i, v in vectors], SCHEMA).repartition(5)


@pytest.mark.parametrize("shape", ["scattered", "clusters", "shifted", "norms"])
def test_recall_and_scores(spark, shape):
    rng = np.random.default_rng(2)
    n, d = 6000, 24
    v = rng.standard_normal((n, d))
    if shape == "clusters":
        v = rng.standard_normal((60, d))[rng.integers(0, 60, n)] * 3 + v * 0.3
    if shape == "shifted":
        v = v + 20
    if shape == "norms":
        v = v * rng.exponential(1, (n, 1))
    rows = {i: x for i, x in enumerate(np.round(v, 3))}
    df = frame(spark, [(i, x.tolist()) for i, x in rows.items()])
    got = answer(df, df.where("vec_id % 20 = 0"), leaf=100)
    want = brute(rows, range(0, n, 20))
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    assert recall(got, want) >= 0.9
    for q, g in got.items():
        assert np.allclose([s for _, s in g], [(rows[i] * rows[q]).sum() for i, _ in g], rtol=1e-12, atol=1e-12)
        assert g == sorted(g, key=lambda x: (-x[1], x[0])) and q not in {i for i, _ in g}


def test_clusters_need_few_candidates(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((40, 16))[rng.integers(0, 40, 8000)] * 3 + rng.standard_normal((8000, 16)) * 0.2
    df = frame(spark, [(i, x.tolist()) for i, x in enumerate(v)])
    rows, d = ann.usable(df)
    mean, far, n = ann.centre(rows, d)
    hashes = ann.Hashes(mean, far, 10, 7)
    index, asking = ann.hashed(rows, d, hashes, False), ann.hashed(rows.where("id % 20 = 0"), d, hashes, True)
    leaves = ann.find_leaves(index, n, 10, 100)
    assert all(c.sum() == 8000 for c in leaves.count)
    assert ann.fit(index, asking, d, leaves, 20, 0.96, 128) < 0.3 * 8000 * 10


def test_hot_copies_and_near_copies(spark):
    rng = np.random.default_rng(4)
    one = rng.standard_normal(12)
    rows = {i: one if i % 3 == 0 else one + rng.standard_normal(12) * 1e-9 if i % 3 == 1 else rng.standard_normal(12) for i in range(1500)}
    df = frame(spark, [(i, x.tolist()) for i, x in rows.items()])
    got, want = answer(df, df.where("vec_id % 20 = 0"), leaf=50), brute(rows, range(0, 1500, 20))
    assert recall(got, want) >= 0.9
    assert all([s for _, s in got[q]] == pytest.approx([s for _, s in want[q]]) for q in want if q % 3 == 0)


def test_ties_nulls_repeats_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(i, [float(i % 3), 1.0, 0.0]) for i in range(0, 60)] + [(0, [0.0, 1.0, 0.0])] * 3
    vectors += [(20, [9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0]), (100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [1.0, nan, 0.0]), (104, [inf, 0.0, 0.0]), (105, [1.0, 2.0]), (120, []), (140, [-1.0, -1.0, -1.0])]
    df = frame(spark, vectors)
    rows = usable(vectors)
    got, want = answer(df, df.where("vec_id % 20 = 0")), brute(rows, [q for q in rows if q % 20 == 0])
    assert got == want and 101 not in rows and set(got) == {0, 20, 40, 140}
    few = frame(spark, vectors[:7])
    assert answer(few, few.where("vec_id = 0"))[0] == brute(usable(vectors[:7]), [0])[0]
    assert answer(df, df.where("vec_id = 105")) == {} and answer(df, df.limit(0)) == {} and answer(df.limit(0), df) == {}


def test_given_embeddings(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = usable([(r.vec_id, r.embedding) for r in df.collect()])
    want = brute(rows, [q for q in rows if q % 20 == 0])
    got = answer(df, df.where("vec_id % 20 = 0"))
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in g] for q, g in want.items()}
    assert recall(answer(df, df.where("vec_id % 20 = 0"), leaf=16), want) >= 0.9
