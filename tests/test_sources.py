from pyspark.sql import functions as F

from episight.functions import text
from episight.sources import lerobot


def test_lerobot_round_trip(spark, tmp_path):
    rows = [(e, i, i * 0.02, [float(e), float(i)], [0.5], e % 2) for e in range(5) for i in range(10)]
    frames = spark.createDataFrame(rows, "episode_index long, frame_index long, timestamp double, action array<float>, `observation.state` array<float>, task_index long")
    frames.write.parquet(str(tmp_path / "src" / "data" / "chunk-000"))
    (tmp_path / "src" / "meta").mkdir()
    (tmp_path / "src" / "meta" / "tasks.jsonl").write_text('{"task_index":0,"task":"pick"}\n{"task_index":1,"task":"place"}\n')
    got = lerobot.scan_frames(spark, str(tmp_path / "src"))
    steps = lerobot.steps(got, lerobot.tasks(spark, str(tmp_path / "src")), width=2)
    assert steps.count() == 50
    assert {(r.ep, r.task) for r in steps.select("ep", "task").distinct().collect()} == {(e, "place" if e % 2 else "pick") for e in range(5)}
    keep = spark.createDataFrame([(1,), (4,)], "episode_index long")
    spans = lerobot.export(got, keep, str(tmp_path / "out")).orderBy("old").collect()
    assert [tuple(r) for r in spans] == [(1, 0, 10, 0, 10), (4, 1, 10, 10, 20)]
    back = spark.read.parquet(str(tmp_path / "out" / "data"))
    assert sorted(r["index"] for r in back.collect()) == list(range(20))


def test_observation_names():
    assert lerobot.canonical("proprio") == "state"
    assert lerobot.canonical("images.wrist") == "camera_wrist" and lerobot.canonical("camera_wrist") == "camera_wrist"
    assert lerobot.canonical("force") == "force"


def test_text_figures(spark):
    rows = [(None,), ("",), ("a b c",), ("a b a b",), ("Sure, here is the plan",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "x string").select(text.word_count(F.col("x")), text.repetition(F.col("x")), text.template_share(F.col("x"))).collect()]
    assert got[:4] == [(0, 0.0, 0.0), (0, 0.0, 0.0), (3, 0.0, 0.0), (4, 1 - 2 / 3, 0.0)]
    assert got[4][2] > 0


def test_arriving_episodes_are_analysed(spark, tmp_path):
    import numpy as np

    from episight.streaming import watch

    rng = np.random.default_rng(0)
    for e in range(7):
        rows = [(e, i, i * 0.05, float(a), float(s)) for i, (a, s) in enumerate(rng.normal(size=(20, 2)))]
        spark.createDataFrame(rows, watch.STEPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    watch.watch_steps(spark, str(tmp_path / "in"), out).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(f"{out}/verdicts").collect()
    assert {r.ep for r in got} == set(range(7)) and {r.verdict for r in got} <= {"PASS", "WARN", "FAIL"}
    scored = {r.batch: r.n for r in spark.read.parquet(f"{out}/surprise").groupBy("batch").count().withColumnRenamed("count", "n").collect()}
    assert sorted(scored.values()) == [5]


def test_verdict_of_a_report(spark):
    from episight.streaming import watch

    df = spark.createDataFrame([("b", "WARNING"), ("a", "WARNING"), ("c", "OK")], "metric string, level string")
    assert tuple(watch.report_verdict(df).first()) == ("WARN", "a")
    assert tuple(watch.report_verdict(df.where("level = 'OK'")).first()) == ("PASS", None)
    assert tuple(watch.report_verdict(df.limit(0)).first()) == ("PASS", None)


def test_examples_with_an_input(spark, tmp_path):
    from episight.operators import sft

    (tmp_path / "x.jsonl").write_text('{"instruction": "Do", "input": "this", "output": "done"}\n{"instruction": "Go", "output": "gone"}\n')
    got = sorted((r.instruction, r.output) for r in sft.with_input(spark.read.json(str(tmp_path / "x.jsonl"))).collect())
    assert got == [("Do\nthis", "done"), ("Go", "gone")]
