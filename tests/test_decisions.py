import numpy as np
import pytest

from episight.operators import coverage, neighbours, export, gates, selection, stats
from episight.streaming import watch

FIGURES = "ep long, n_steps long, spike_rate double, disc_rate double, dropout double, ldlj double"


def test_gate_reasons_and_status(spark):
    rows = [(0, 5, 0.9, 0.9, 0.9, -99.0), (1, 50, 0.2, 0.01, 0.5, -31.0), (2, 50, 0.0, 0.0, 0.0, None), (3, 50, None, None, None, None)]
    got = {r.ep: r for r in gates.quality_gate(spark.createDataFrame(rows, FIGURES)).collect()}
    assert (got[0].reasons, got[0].status) == ("length", "bad")
    assert (got[1].reasons, got[1].status) == ("spike_rate,dropout,ldlj", "bad")
    assert (got[2].reasons, got[2].status) == ("", "clean")
    assert (got[3].reasons, got[3].status) == ("", "not_evaluated")


def test_quality_risk_weights(spark):
    rows = [(0, 50, 0.10, 0.25, 0.10, -30.0), (1, 50, None, None, None, None), (2, 50, 0.05, 0.0, 0.0, -3.0)]
    got = {r.ep: r.quality_risk for r in gates.quality_risk(spark.createDataFrame(rows, FIGURES)).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 0.175}


def test_ranks_are_the_share_up_to_a_value(spark):
    rows = [(i, "m", v) for i, v in enumerate([1.0, 2.0, 2.0, 5.0, None])]
    got = {r.ep: r["rank"] for r in stats.percentile_ranks(spark.createDataFrame(rows, "ep long, metric string, value double")).collect()}
    assert got == {0: 0.25, 1: 0.75, 2: 0.75, 3: 1.0, 4: None}


def test_planted_outlier_is_found_alone(spark):
    rows = [(i, "m", 1.0 + 0.01 * (i % 7)) for i in range(30)] + [(30, "m", 9.0)]
    got = stats.mad_outliers(spark.createDataFrame(rows, "ep long, metric string, value double")).collect()
    assert [r.ep for r in got] == [30]


def test_consecutive_groups_over_chunk_edges(spark):
    eps = [3, 4, 5, 9, 15, 16, 17, 18, 31, 32]
    df = spark.createDataFrame([(e,) for e in eps], "ep long")
    got = sorted((r.first, r.last, r.size) for r in stats.consecutive_groups(df, chunk=4).collect())
    assert got == [(3, 5, 3), (9, 9, 1), (15, 18, 4), (31, 32, 2)]


@pytest.mark.parametrize("n, fraction, want", [(0, 0.3, 1), (10, 0.25, 2), (10, 0.35, 4), (7, 1.0, 7)])
def test_keep_count_rounds_halves_to_even(n, fraction, want):
    assert selection.keep_count(n, fraction) == want


def test_greedy_cover_takes_each_cluster_first():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.01, (20, 2)) for c in ((0, 0), (9, 0), (0, 9), (9, 9))])
    assert {i // 20 for i in selection.greedy_cover(x, 4)} == {0, 1, 2, 3}
    assert selection.greedy_cover(np.zeros((0, 2)), 3) == []


def test_nearest_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (60, 3)).astype(float)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "ep long, x double, y double, z double")
    got = {r.ep: (r.neighbour, r.distance) for r in neighbours.nearest(df, df, ["x", "y", "z"], exclude_self=True).collect()}
    for i in range(60):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert got[i][0] == int(d.argmin()) and got[i][1] == pytest.approx(d.min() / np.sqrt(3))


def test_offsets_are_dense_and_gapless(spark):
    lengths = [(3, 10), (7, 5), (8, 1), (20, 4)]
    got = [tuple(r) for r in export.episode_offsets(spark.createDataFrame(lengths, "episode_index long, length long")).orderBy("old").collect()]
    assert got == [(3, 0, 10, 0, 10), (7, 1, 5, 10, 15), (8, 2, 1, 15, 16), (20, 3, 4, 16, 20)]


def test_stream_verdicts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"episode_id":"a","spike_rate":0.01,"disc_rate":0.03,"dropout":0.0,"ldlj":-20.0}', '{"episode_id":"b","spike_rate":0.0,"disc_rate":0.0,"dropout":0.0,"ldlj":-5.0}', '{"episode_id":"c","dropout":0.02}']
    for i, x in enumerate(lines):
        (tmp_path / "in" / f"{i}.json").write_text(x + "\n")
    q = watch.watch(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.episode_id: (r.verdict, r.metric) for r in spark.sql("select * from watched").collect()}
    assert got == {"a": ("FAIL", "ldlj"), "b": ("PASS", None), "c": ("WARN", "dropout")}
