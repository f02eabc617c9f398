"""Executors that have no copy of the package, and clusters without a shared folder."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
RUN = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("OFF")


def look(_):
    try:
        import episight
    except ImportError:
        return ["none"]
    return [episight.__file__]


print("workers have", spark.sparkContext.parallelize([0], 1).mapPartitions(look).collect())
for name in {names!r}:
    print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_where_workers_lack_the_package(tmp_path):
    script = tmp_path / "run.py"
    names = ["op1_license_scan", "op2_lm_score", "op5_simhash", "op6_bpe_round_trip", "op9_media_columns", "op10_sharding", "pipeline"]
    script.write_text(RUN.format(repo=str(REPO), shared=str(tmp_path / "shared"), names=names))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert got.returncode == 0, got.stderr[-2000:]
    assert "workers have ['none']" in got.stdout and all(f"{n} " in got.stdout for n in names)


def test_a_cluster_needs_a_shared_folder():
    from episight.functions.lineage import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
