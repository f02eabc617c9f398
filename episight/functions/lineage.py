"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local master (tests, a laptop) gets a
    folder of its own; on a cluster it is an error, as each machine would
    write to a folder that the others can't see.
    """
    sc = spark.sparkContext
    local = sc.master.split("[")[0] == "local"
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(sc, "_episight_dir", None)
        if at is None:
            at = sc._episight_dir = tempfile.mkdtemp(prefix="episight-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so that a lost
    executor costs a read and not the work behind it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
