"""A directory of robot episodes: Parquet shards of frames, and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canonical names of observation keys; exact ones first, then what replaces a prefix.
ALIASES = {
    "images.top": "camera_top",
    "images.wrist": "camera_wrist",
    "images.wrist_cam": "camera_wrist",
    "images.overhead": "camera_overhead",
    "images.side": "camera_side",
    "images.front": "camera_front",
    "images.camera0": "camera_0",
    "images.camera1": "camera_1",
    "images.camera2": "camera_2",
    "images.camera3": "camera_3",
    "image": "camera_main",
    "image.camera0": "camera_0",
    "image.camera1": "camera_1",
    "image.top": "camera_top",
    "image.wrist": "camera_wrist",
    "state": "state",
    "proprio": "state",
    "proprio_state": "state",
    "proprioception": "state",
    "obs/proprio": "state",
    "joint_pos": "joint_position",
    "joint_position": "joint_position",
    "joint_positions": "joint_position",
    "joint_vel": "joint_velocity",
    "joint_velocity": "joint_velocity",
    "joint_velocities": "joint_velocity",
    "joint_torque": "joint_torque",
    "joint_torques": "joint_torque",
    "eef_pos": "eef_position",
    "eef_position": "eef_position",
    "eef_vel": "eef_velocity",
    "eef_velocity": "eef_velocity",
    "eef_quat": "eef_orientation",
    "eef_orientation": "eef_orientation",
    "robot0_eef_pos": "eef_position",
    "robot0_eef_quat": "eef_orientation",
    "robot0_gripper_qpos": "gripper_state",
    "robot0_joint_pos": "joint_position",
    "robot0_joint_vel": "joint_velocity",
    "obs/camera_rgb": "camera_main",
    "obs/proprio_state": "state",
    "depth": "camera_depth",
    "depth_image": "camera_depth",
    "images.depth": "camera_depth",
    "image_primary": "camera_main",
    "image_wrist": "camera_wrist",
    "gripper": "gripper_state",
    "gripper_state": "gripper_state",
    "gripper_pos": "gripper_state",
}
PREFIXES = (("images.", "camera_"), ("image.", "camera_"), ("obs/", ""), ("robot0_", ""))

#: The kinematic observations of which a state vector is put together, in this order.
KINEMATIC_KEYS = ("joint_pos", "joint_vel", "eef_pos", "eef_quat", "gripper_qpos")


def canonical(key: str, extra: dict[str, str] | None = None) -> str:
    """An observation key's canonical name: exact alias (the caller's first), else first prefix rule, else itself."""
    known = ALIASES | (extra or {})
    if key in known:
        return known[key]
    for old, new in PREFIXES:
        if key.startswith(old):
            return new + key[len(old) :]
    return key


def canonical_keys(keys: Column, extra: dict[str, str] | None = None) -> Column:
    """``canonical`` for a column of keys."""
    known = ALIASES | (extra or {})
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    out = keys
    for old, new in reversed(PREFIXES):
        out = F.when(keys.startswith(old), F.concat(F.lit(new), F.substring(keys, len(old) + 1, 1 << 20))).otherwise(out)
    return F.coalesce(table[keys], out)


def mapped_column(raw: Column, patterns: dict[str, tuple[str, ...]]) -> Column:
    """The first canonical column, in the order of ``patterns``, one of whose parts a raw name contains; null without."""
    out = F.lit(None).cast("string")
    for name, parts in reversed(patterns.items()):
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.lower(raw).contains(part)
        out = F.when(hit, name).otherwise(out)
    return out


def without_dims(vector: Column, dims: tuple[int, ...]) -> Column:
    """An array without some places; negative ones count from its end, modulo its length."""
    gone = F.transform(F.array(*[F.lit(d).cast("int") for d in dims]), lambda d: F.pmod(d, F.size(vector)))
    return F.filter(vector, lambda x, i: ~F.array_contains(gone, i))


def feature_columns(columns: list[str], feature: str) -> list[str]:
    """The flat columns f_0, f_1, ... of a vector feature in order, or the feature itself."""
    import re

    if feature in columns:
        return [feature]
    flat = [c for c in columns if re.match(re.escape(feature) + r"_\d+$", c)]
    return sorted(flat, key=lambda c: int(c.rsplit("_", 1)[1]))


def episode_features(frames: DataFrame, features: list[str], episode: int) -> DataFrame:
    """(frame_index, features) of one episode in order; vectors that are spread over columns come as arrays.  The filter and the columns reach the scan."""
    cols = []
    for f in features:
        flat = feature_columns(frames.columns, f)
        if not flat:
            raise ValueError(f"no column {f}")
        cols.append(F.col(f"`{f}`") if flat == [f] else F.array(*[F.col(f"`{c}`") for c in flat]).alias(f))
    return frames.where(F.col("episode_index") == episode).select("frame_index", *cols).orderBy("frame_index")


def episodes(frames: DataFrame) -> DataFrame:
    """(episode_index, n_frames), in order."""
    return frames.groupBy("episode_index").agg(F.count("*").alias("n_frames")).orderBy("episode_index")


def by_offsets(rows: DataFrame, ends: DataFrame, index: str = "row") -> DataFrame:
    """``rows`` with ep and step, from the exclusive ends (ep, end) of the episodes in one running index.

    The range join is an equality of blocks: an episode stands in every block
    that it reaches into.
    """
    from ..operators.order import with_previous

    block = 4096
    spans = with_previous(ends, "end", "start").withColumn("start", F.coalesce("start", F.lit(0)))
    spans = spans.where("end > start").withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    met = rows.withColumn("b", F.floor(F.col(index) / block)).join(spans, "b").where((F.col(index) >= F.col("start")) & (F.col(index) < F.col("end")))
    return met.withColumn("step", F.col(index) - F.col("start")).drop("b", "start", "end")


def proprio(observations: dict[str, Column], keys: tuple[str, ...] = KINEMATIC_KEYS) -> Column:
    """One state vector from the kinematic keys that are there, in a fixed order."""
    return F.concat(*[observations[k] for k in keys if k in observations])


def demo_index(name: Column) -> Column:
    """The number of ``demo_N``, else null."""
    return F.nullif(F.regexp_extract(name, r"^demo_(\d+)$", 1), F.lit("")).cast("long")


def first_alias(columns: list[str], aliases: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """For each canonical name the first of its aliases that is a column and not null."""
    return {name: F.coalesce(*[F.col(f"`{a}`") for a in known if a in columns]) for name, known in aliases.items() if any(a in columns for a in known)}


def scan_frames(spark: SparkSession, path: str, images: bool = False) -> DataFrame:
    """All frames below ``path``/data; image columns (binary or struct) are left unread unless asked for.

    Observation columns ``observation.x`` become ``obs_x`` under their canonical name; if
    two meet in one name the last wins.
    """
    df = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/data")
    plain = [f for f in df.schema.fields if images or f.dataType.typeName() not in ("binary", "struct")]
    named: dict[str, str] = {}
    for f in plain:
        new = "obs_" + canonical(f.name.removeprefix("observation.")) if f.name.startswith("observation.") else f.name
        named[new] = f.name
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in named.items()])


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """(task_index, task) from meta/tasks.parquet (two columns, or the text as an index) or meta/tasks.jsonl."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(f"{path}/meta/tasks.parquet")
    except AnalysisException:
        return spark.read.schema("task_index long, task string").json(f"{path}/meta/tasks.jsonl")
    name = "task" if "task" in df.columns else next(c for c in df.columns if c != "task_index")
    return df.select(F.col("task_index").cast("long").alias("task_index"), F.col(f"`{name}`").alias("task"))


def steps(frames: DataFrame, task_table: DataFrame | None = None, default_task: str | None = None, width: int = 1, observations: dict[str, int] | None = None) -> DataFrame:
    """Frames as steps; ``width`` action dimensions become columns a0, ..., and
    of each observation (obs_x) so many as s0, ... in the order given.  The task is
    that of the episode's first frame, looked up if there is a table."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("episode_index").orderBy("frame_index")
    states, k = [], 0
    for name, n in (observations or {}).items():
        vector = frames.schema[name].dataType.typeName() == "array"
        for i in range(n):
            states.append((F.get(name, F.lit(i)) if vector else F.col(name)).cast("double").alias(f"s{k}"))
            k += 1
    base = frames.select(
        F.col("episode_index").alias("ep"),
        (F.row_number().over(w) - 1).alias("step"),
        F.col("timestamp").cast("double").alias("t"),
        *[F.get("action", F.lit(k)).cast("double").alias(f"a{k}") for k in range(width)],
        *states,
        *([F.first("task_index").over(w).alias("task_index")] if "task_index" in frames.columns else []),
    )
    if task_table is None or "task_index" not in base.columns:
        return base.withColumn("task", F.lit(default_task).cast("string"))
    return base.join(task_table, "task_index", "left").withColumn("task", F.coalesce("task", F.lit(default_task)))


def remap_meta(meta: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of episode metadata (episode_index, ...) of the kept episodes, renumbered."""
    new = spans.select(F.col("old").alias("episode_index"), F.col("episode_index").alias("_new"))
    return meta.join(new, "episode_index").withColumn("episode_index", F.col("_new")).drop("_new")


def export(frames: DataFrame, keep: DataFrame, path: str, meta: DataFrame | None = None) -> DataFrame:
    """Write the frames of the episodes in ``keep`` (episode_index), renumbered
    densely from 0, partitioned by episode, and their metadata; returns (old, episode_index, length, first, end)."""
    from ..operators.export import episode_offsets

    kept = frames.join(keep.select("episode_index").distinct(), "episode_index", "left_semi")
    spans = episode_offsets(kept.groupBy("episode_index").agg(F.count("*").alias("length")))
    remap = spans.select(F.col("old").alias("episode_index"), F.col("episode_index").alias("new"), "first")
    out = kept.join(remap, "episode_index")
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("new").orderBy("frame_index")) - 1
    out = out.withColumns({"episode_index": F.col("new"), "index": F.col("first") + place}).drop("new", "first")
    # chunk folders of a thousand episodes, then one folder an episode
    out = out.withColumn("chunk", F.format_string("%03d", F.floor(F.col("episode_index") / 1000).cast("int")))
    out.write.partitionBy("chunk", "episode_index").parquet(f"{path}/data")
    if meta is not None:
        remap_meta(meta, spans).write.json(f"{path}/meta/episodes.jsonl")
    return spans
