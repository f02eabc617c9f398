"""Joint limits of a robot description, and steps beyond them."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import in_order, median, share, whole

SCHEMA = "joint string, lower double, upper double, velocity double"


def parse_limits(spark: SparkSession, urdf: str) -> DataFrame:
    """(joint, lower, upper, velocity) of the moving joints of a URDF text, in
    its order; missing limits are null.  A description has few joints."""
    rows = []
    for joint in ET.fromstring(urdf).iter("joint"):
        limit = joint.find("limit")
        if joint.get("type") in ("revolute", "prismatic", "continuous") and limit is not None:
            number = lambda k: None if limit.get(k) is None else float(limit.get(k))  # noqa: E731, B023
            rows.append((joint.get("name"), number("lower"), number("upper"), number("velocity")))
    return spark.createDataFrame(rows, SCHEMA)


def limit_violations(steps: DataFrame, joints: dict[str, str], limits: DataFrame) -> DataFrame:
    """(ep, joint, under, over, too_fast): shares of steps below and above the
    joint's range, and of moves faster than its limit (differences over the
    episode's median interval).  Intervals count to the nanosecond: differences of clocks
    in doubles are a little beside a steady period, and moves at the limit would be beyond it.  ``joints``: columns by joint; the limits, a row a joint, are broadcast."""
    w = in_order()
    d = steps.withColumn("dt", F.round(F.col("t") - F.lag("t").over(w), 9)).withColumn("every", median("dt").over(whole()))
    d = d.withColumns({f"v_{c}": F.abs(F.col(c) - F.lag(c).over(w)) / F.col("every") for c in joints.values()})
    rows = F.explode(F.array(*[F.struct(F.lit(j).alias("joint"), F.col(c).alias("q"), F.col(f"v_{c}").alias("v")) for j, c in joints.items()])).alias("r")
    met = d.select("ep", rows).select("ep", "r.*").join(F.broadcast(limits), "joint")
    return met.groupBy("ep", "joint").agg(share(F.col("q") < F.col("lower")).alias("under"), share(F.col("q") > F.col("upper")).alias("over"), share(F.col("v") > F.col("velocity")).alias("too_fast"))
