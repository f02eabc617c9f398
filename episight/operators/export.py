"""Renumbering of what a filter keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut_lineage


def episode_offsets(lengths: DataFrame) -> DataFrame:
    """(old, episode_index, length, first, end) from (episode_index, length):
    dense numbers in order of the old ones, and the running range of frames.

    The running sums are over episodes, not frames: ranges of episodes are
    summed apart and then shifted by what lies before them, so no task sees
    them all.
    """
    n = lengths.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # written down, as a range partitioning that is made anew may cut elsewhere
    ranged = cut_lineage(lengths.repartitionByRange(int(n), "episode_index").withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy("episode_index")
    local = ranged.withColumns({"k": F.row_number().over(own) - 1, "end": F.sum("length").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    parts = local.groupBy("part").agg(F.count("*").alias("n"), F.sum("length").alias("frames"))  # a row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("frames").over(before), F.lit(0)).alias("f0"))
    met = local.join(F.broadcast(shift), "part")
    return met.select(F.col("episode_index").alias("old"), (F.col("k") + F.col("n0")).alias("episode_index"), "length", (F.col("end") - F.col("length") + F.col("f0")).alias("first"), (F.col("end") + F.col("f0")).alias("end"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with place, 1 and on in the order of a column, found as in ``episode_offsets``."""
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = cut_lineage(rows.repartitionByRange(int(n), order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) + F.col("_before")
    return ranged.join(F.broadcast(shift), "_part").withColumn("place", place).drop("_part", "_before")


def manifest(decisions: DataFrame) -> DataFrame:
    """(disposition, n) of an annotation manifest."""
    return decisions.groupBy("disposition").agg(F.count("*").alias("n"))
