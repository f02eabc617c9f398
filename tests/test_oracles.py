"""Every registered query beside its SQL on the smallest tables."""

import math

import duckdb
import pytest

from episight.plans import catalog, oracles

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, small, duck, name):
    got = catalog.QUERIES[name](spark, small)
    want = duck.sql(oracles.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_queries_without_sql_are_named():
    assert set(catalog.QUERIES) - set(oracles.SQL) == {
        "submovement_ldlj", "pca_top2", "kcenter_coreset", "approx_coreset", "dataset_comparison", "coreset_diversity", "coverage_gaps",
        "cure_episodes", "latent_projection", "trajectory_diversity", "vector_transitions", "latent_dynamics", "reduced_vectors", "content_hashes",
    }
