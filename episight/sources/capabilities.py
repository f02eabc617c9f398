"""Which of its observations stands for a data set's state, and which camera for its pictures.

Steps carry their observations in a map (``obs``: name -> values), as data sets
differ in what they have.  What is there is aggregated first, a row a data set or
episode, and joined back as one resolved column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Observations that can stand for the state, the first that any episode has; and those that must have the actions' shape.
STATE_KEYS = ("proprio", "state", "joint_state", "joint_pos", "robot_state", "qpos", "obs")
SHAPED_KEYS = ("state", "joint_position", "proprio")
#: Parts of names that mean pictures.
VISUAL_WORDS = ("camera", "image", "rgb", "depth", "visual")


def _first(have: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(c, F.lit(k)) for k, c in have.items()])


def state_keys(steps: DataFrame, keys: tuple[str, ...] = STATE_KEYS, by: str = "dataset") -> DataFrame:
    """(by, state_key): for each data set the first of ``keys`` that any of its steps has; null without."""
    has = {k: F.bool_or(F.coalesce(F.map_contains_key("obs", k), F.lit(False))) for k in keys}
    return steps.groupBy(by).agg(*[c.alias(f"_{i}") for i, c in enumerate(has.values())]).select(by, _first({k: F.col(f"_{i}") for i, k in enumerate(has)}).alias("state_key"))


def with_state(steps: DataFrame, keys: tuple[str, ...] = STATE_KEYS, by: str = "dataset") -> DataFrame:
    """``steps`` with state_key and state (null where an episode lacks the data set's key); clashing names are replaced."""
    kept = steps.drop("state_key", "state")
    resolved = kept.join(state_keys(kept, keys, by), by, "left")
    return resolved.withColumn("state", F.when(F.col("state_key").isNotNull(), F.try_element_at("obs", F.col("state_key"))))


def shaped_state_keys(steps: DataFrame, keys: tuple[str, ...] = SHAPED_KEYS, action: str = "action") -> DataFrame:
    """(ep, state_key): for each episode the first of ``keys`` that has, at every step, as many values as the action; null without."""
    fits = {k: F.bool_and(F.coalesce(F.size(F.try_element_at("obs", F.lit(k))) == F.size(action), F.lit(False))) for k in keys}
    return steps.groupBy("ep").agg(*[c.alias(f"_{i}") for i, c in enumerate(fits.values())]).select("ep", _first({k: F.col(f"_{i}") for i, k in enumerate(fits)}).alias("state_key"))


def first_cameras(frames: DataFrame) -> DataFrame:
    """(ep, camera): for each episode the first stream, by ``place`` among its
    observations, whose name means pictures, with two frames or more of three or
    four dimensions (with their time); ``frames``: (ep, camera, place, step, n_dims)."""
    visual = F.lit(False)
    for word in VISUAL_WORDS:
        visual = visual | F.lower("camera").contains(word)
    streams = frames.where(visual).groupBy("ep", "camera").agg(F.min("place").alias("place"), F.count("*").alias("n"), F.max("n_dims").alias("dims"))
    return streams.where("n >= 2 and dims in (3, 4)").groupBy("ep").agg(F.min_by("camera", F.struct("place", "camera")).alias("camera"))
