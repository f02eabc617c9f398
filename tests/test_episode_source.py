"""The data source over directories: planning, pushed filters, order, formats; and its writer's commits."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from episight.sources import episode_source as S

SCHEMA = "episode_index long, frame_index long, timestamp double, action array<float>, `observation.state` array<float>, `observation.images.top` binary, note string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Nine episodes over five shards, some cut between two, out of order in the files."""
    at = tmp_path_factory.mktemp("set")
    rows = [(e, i, i * 0.1, [float(e), float(i)], [0.5], b"pixels", None if i % 3 else "x") for e in range(9) for i in range(20 + e)]
    rows = rows[::2] + rows[1::2]
    for k in range(5):
        part = rows[k * len(rows) // 5 : (k + 1) * len(rows) // 5]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(at / "data" / f"chunk-{k:03d}"))
    (at / "meta").mkdir()
    features = {"action": {"dtype": "float32"}, "observation.images.top": {"dtype": "video"}, "observation.state": {"dtype": "float32"}}
    (at / "meta" / "info.json").write_text(json.dumps({"features": features}))
    S.register(spark)
    return str(at)


def test_image_columns_of_the_features():
    info = {"features": {"a": {"dtype": "image"}, "b": {"dtype": "float32", "info": {"encoding": "h264"}}, "wrist_rgb": {"dtype": "float32"}, "state": {"dtype": "float32"}, "odd": 3}}
    assert S.image_columns(info) == {"a", "b", "wrist_rgb"} and S.image_columns({}) == set()


def test_rows_come_in_order_and_whole(spark, folder):
    df = S.load(spark, folder, rowsPerPartition="60")
    assert df.columns == ["episode_index", "frame_index", "timestamp", "action", "obs_state", "note"]
    assert dict(df.dtypes)["action"] == "array<float>"
    assert df.rdd.getNumPartitions() > 2
    got = [(r.episode_index, r.frame_index) for r in df.collect()]
    assert got == sorted(got) and len(got) == sum(20 + e for e in range(9))
    parts = df.select("episode_index", F.spark_partition_id().alias("p")).distinct().groupBy("episode_index").count()
    assert parts.where("count > 1").count() == 0
    images = spark.read.format("episodes").option("images", "true").load(folder)
    assert "obs_camera_top" in images.columns and images.select("obs_camera_top").first()[0] == b"pixels"
    few = S.load(spark, folder, columns="frame_index,obs_state")
    assert few.columns == ["frame_index", "obs_state"] and few.count() == len(got)
    with pytest.raises(Exception, match="no column"):
        S.load(spark, folder, columns="nothing").count()


@pytest.mark.parametrize("where", ["episode_index = 3", "episode_index > 6", "episode_index between 2 and 4 and frame_index < 5", "episode_index in (0, 8) and note = 'x'", "episode_index < 0", "episode_index = 2 or frame_index = 1", "note is null and episode_index <= 1"])
def test_filters_give_the_rows_that_they_should(spark, folder, where):
    want = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/data").where(where).select("episode_index", "frame_index")
    got = S.load(spark, folder, rowsPerPartition="60").where(where).select("episode_index", "frame_index")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pushed_filters_prune_partitions(spark, folder):
    options = {"path": folder, "rowsPerPartition": "60"}
    reader = S.EpisodeReader(options, S.Layout(options).schema())
    every = reader.partitions()
    left = list(reader.pushFilters([S.EqualTo(("episode_index",), 3), S.EqualTo(("note",), "x"), S.GreaterThan(("frame_index",), 4)]))
    assert left == [S.EqualTo(("note",), "x")]
    few = reader.partitions()
    assert len(few) < len(every) and all(p.low <= 3 < p.high for p in few)
    df = S.load(spark, folder, rowsPerPartition="60").where("episode_index = 3")
    assert df.rdd.getNumPartitions() == 1 and "Filter (" not in df._jdf.queryExecution().executedPlan().toString()


def test_directories_by_episode_and_without_metadata(spark, tmp_path):
    rows = [(e, i, float(i)) for e in (4, 7) for i in range(3)]
    spark.createDataFrame(rows, "episode_index long, frame_index long, timestamp double").write.partitionBy("episode_index").parquet(str(tmp_path / "x" / "data"))
    got = S.load(spark, str(tmp_path / "x"))
    assert got.columns == ["frame_index", "timestamp"] and got.count() == 6
    with pytest.raises(ValueError):
        S.load(spark, str(tmp_path / "none"))


def test_further_formats(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"episode_index": 2, "timestamp": [0.0, 0.5], "action": [[1.0], [2.0]]}\n')
    assert [tuple(r) for r in S.load(spark, str(tmp_path / "e.jsonl")).collect()] == [(2, 0, 0.0, [1.0]), (2, 1, 0.5, [2.0])]

    class Ranges(S.EpisodeFormat):
        name = "ranges"

        def can_read(self, files, path):
            return path.endswith(".range")

        def load(self, spark, path, **options):
            return spark.range(3).withColumnRenamed("id", "episode_index")

    before = list(S.FORMATS)
    try:
        S.register_format(Ranges(), first=True)
        S.register_format(Ranges(), first=True)
        assert len(S.FORMATS) == len(before) + 1
        assert S.load(spark, "/nowhere.range").count() == 3 and S.load(spark, "/x", format="ranges").count() == 3
    finally:
        S.FORMATS[:] = before
    with pytest.raises(ValueError):
        S.load(spark, "/x", format="ranges")


def test_written_sets_are_read_back(spark, folder, tmp_path):
    path = str(tmp_path / "out")
    df = S.load(spark, folder)
    df.where("episode_index < 5").repartition(3).write.format("episodes").mode("overwrite").save(path)
    assert S.load(spark, path).count() == sum(20 + e for e in range(5))
    df.where("episode_index = 8").write.format("episodes").mode("append").save(path)
    assert {r[0] for r in S.load(spark, path).select("episode_index").distinct().collect()} == {0, 1, 2, 3, 4, 8}
    df.where("episode_index = 7").write.format("episodes").mode("overwrite").save(path)
    assert S.load(spark, path).count() == 27
    manifest = json.loads((tmp_path / "out" / "meta" / "manifest.json").read_text())
    files = {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out" / "data").iterdir()}
    assert files == {f["path"] for f in manifest["files"]} and manifest["rows"] == 27


@pytest.mark.parametrize("layout", ["parquet", "npz", "jsonl"])
def test_a_failed_task_leaves_nothing(spark, tmp_path, layout):
    S.register(spark)
    path = tmp_path / "out"
    good = spark.range(100).select((F.col("id") % 5).alias("episode_index"), F.col("id").alias("frame_index")).repartition(4, "episode_index").sortWithinPartitions("episode_index")
    good.write.format("episodes").option("layout", layout).mode("overwrite").save(str(path))
    before = (path / "meta" / "manifest.json").read_text()
    files = sorted(p.name for p in (path / "data").iterdir())
    bad = good.withColumn("frame_index", F.when(F.col("frame_index") == 63, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("frame_index")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            bad.write.format("episodes").option("layout", layout).mode(mode).save(str(path))
        assert (path / "meta" / "manifest.json").read_text() == before
        assert sorted(p.name for p in (path / "data").iterdir()) == files
    fresh = tmp_path / "fresh"
    with pytest.raises(Exception, match="broken"):
        bad.write.format("episodes").option("layout", layout).mode("overwrite").save(str(fresh))
    assert not (fresh / "meta").exists() and not (fresh / "data").exists()


def test_files_by_episode(spark, tmp_path):
    rows = [(e, i, [float(i), 1.0]) for e in (3, 5, 6) for i in range(4 + e)]
    steps = spark.createDataFrame(rows, "ep long, step long, action array<double>").repartition(4)
    manifest = S.write_by_episode(steps, str(tmp_path / "cured"))
    assert sorted((f["first"], f["rows"]) for f in manifest["files"]) == [(3, 7), (5, 9), (6, 10)]
    for f in manifest["files"]:
        got = np.load(tmp_path / "cured" / f["path"])
        assert got["step"].tolist() == list(range(f["rows"])) and got["action"].shape == (f["rows"], 2)


def test_label_sheet(spark, tmp_path):
    from episight.operators import evidence

    items = spark.createDataFrame([("d", e, e % 4 == 0, float(e)) for e in range(30)], "dataset string, ep long, flagged boolean, priority double")
    sample = evidence.blind_sample(items, 3, 5)
    S.write_label_sheet(sample, str(tmp_path / "review"))
    sheet = "".join(p.read_text() for p in sorted((tmp_path / "review" / "sheet" / "data").iterdir()))
    keys = [json.loads(x) for p in (tmp_path / "review" / "key" / "data").iterdir() for x in p.read_text().splitlines()]
    assert "stratum" not in sheet and '"label","notes"' in sheet
    assert len(keys) == sample.count() and all(k["item_id"] in sheet for k in keys)
    assert {k["stratum"] for k in keys} == {"flagged", "review_top", "control"}
