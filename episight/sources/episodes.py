"""Episodes as step tables: ep, step (from 0), t (seconds), action columns
a0, a1, ..., state columns s0, ... and what else the source has.

Trajectories stay in this long form, so that every per-episode figure is a
window or a group over one exchange by episode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The time between a supplier's lines, seconds.
LINE_PERIOD = 0.02


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_steps(events: DataFrame) -> DataFrame:
    """One episode a user, in order of time and id: the value is the action, k of props the state."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("ep"),
        (F.row_number().over(w) - 1).alias("step"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        F.col("value").alias("a0"),
        F.get_json_object("props", "$.k").cast("double").alias("s0"),
        "event_type",
    )


def line_steps(lineitem: DataFrame) -> DataFrame:
    """One episode a supplier, with four action dimensions and a steady clock."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    step = F.row_number().over(w) - 1
    return lineitem.select(
        F.col("l_suppkey").alias("ep"),
        step.alias("step"),
        (step * F.lit(LINE_PERIOD)).alias("t"),
        F.col("l_quantity").alias("a0"),
        F.col("l_extendedprice").alias("a1"),
        F.col("l_discount").alias("a2"),
        F.col("l_tax").alias("a3"),
        "l_returnflag",
    )


LINE_DIMS = ("a0", "a1", "a2", "a3")


def order_lengths(lineitem: DataFrame) -> DataFrame:
    """(ep, n_steps): one episode an order, of which only the length counts."""
    return lineitem.groupBy(F.col("l_orderkey").alias("ep")).agg(F.count("*").alias("n_steps"))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, instruction, output): each user turn with the assistant turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    follow = conversations.withColumns({"next_role": F.lead("role").over(w), "output": F.lead("text").over(w)})
    return follow.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("instruction"), "output")


def dimensions(steps: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(ep, step, dim, value): action dimensions as rows."""
    return steps.unpivot(["ep", "step"], list(dims), "dim", "value")
