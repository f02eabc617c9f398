"""Where an episode's video is: files and spans of time in them, and spans that can't be right."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPANS = ["ep", "camera", "path", "begin", "end", "length"]


def formatted(template: str, values: dict[str, Column]) -> Column:
    """A template such as ``videos/{video_key}/chunk-{chunk_index:03d}.mp4`` over columns."""
    text, used = "", []
    for literal, name, spec, _ in string.Formatter().parse(template):
        text += literal.replace("%", "%%")
        if name is not None:
            if name not in values:
                raise ValueError(f"the template names {name}")
            number = spec.endswith("d")
            text += f"%{spec}" if number else "%s"
            used.append(values[name].cast("long") if number else values[name].cast("string"))
    return F.format_string(text, *used) if used else F.lit(template)


def one_file_an_episode(lengths: DataFrame, cameras: list[str], template: str, chunk: int = 1000) -> DataFrame:
    """Spans of (episode_index, length) where each episode and camera has its own file: begin and end are null."""
    d = lengths.select(F.col("episode_index").alias("ep"), "length", F.explode(F.array(*map(F.lit, cameras))).alias("camera"))
    path = formatted(template, {"episode_chunk": F.floor(F.col("ep") / chunk), "video_key": F.col("camera"), "episode_index": F.col("ep")})
    return d.select("ep", "camera", path.alias("path"), F.lit(None).cast("double").alias("begin"), F.lit(None).cast("double").alias("end"), "length")


def shared_files(meta: DataFrame, cameras: list[str], template: str) -> DataFrame:
    """Spans of episode metadata with the wide columns videos/<camera>/chunk_index,
    file_index, from_timestamp and to_timestamp; cameras without a file are left out."""
    rows = []
    for camera in cameras:
        names = [f"videos/{camera}/{x}" for x in ("chunk_index", "file_index", "from_timestamp", "to_timestamp")]
        if names[0] in meta.columns and names[1] in meta.columns:
            got = [F.col(f"`{n}`") if n in meta.columns else F.lit(None) for n in names]
            rows.append(F.struct(F.lit(camera).alias("camera"), got[0].cast("long").alias("chunk"), got[1].cast("long").alias("file"), got[2].cast("double").alias("begin"), got[3].cast("double").alias("end")))
    if not rows:
        raise ValueError("no camera has its files named in the metadata")
    d = meta.select(F.col("episode_index").alias("ep"), "length", F.explode(F.array(*rows)).alias("v")).where("v.chunk is not null and v.file is not null")
    path = formatted(template, {"video_key": F.col("v.camera"), "chunk_index": F.col("v.chunk"), "file_index": F.col("v.file")})
    return d.select("ep", "v.camera", path.alias("path"), "v.begin", "v.end", "length")


def span_problems(spans: DataFrame, fps: float, tolerance: float = 1.0) -> DataFrame:
    """(ep, camera, path, problem, seconds): spans of a shared file that begin
    before an earlier one has ended (overlap), or after a hole behind all earlier ones (gap), by over
    ``tolerance`` frames; spans without a length in time (empty); and spans whose time isn't
    that of the episode's frames (length).  Seconds say by how much.

    One sorted sweep inside each file: the latest end so far is a running maximum.
    """
    slack = tolerance / fps
    own = Window.partitionBy("path").orderBy("begin", "end", "ep").rowsBetween(Window.unboundedPreceding, -1)
    d = spans.where("begin is not null and end is not null").withColumn("reached", F.max("end").over(own))
    late = F.col("begin") - F.col("reached")
    off = (F.col("end") - F.col("begin")) - F.col("length") / fps
    found = F.array_compact(
        F.array(
            F.when(F.col("end") <= F.col("begin"), F.struct(F.lit("empty").alias("problem"), (F.col("begin") - F.col("end")).alias("seconds"))),
            F.when(late < -slack, F.struct(F.lit("overlap").alias("problem"), (-late).alias("seconds"))),
            F.when(late > slack, F.struct(F.lit("gap").alias("problem"), late.alias("seconds"))),
            F.when(F.abs(off) > slack, F.struct(F.lit("length").alias("problem"), F.abs(off).alias("seconds"))),
        )
    )
    return d.select("ep", "camera", "path", F.explode(found).alias("f")).select("ep", "camera", "path", "f.problem", "f.seconds")
