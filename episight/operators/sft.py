"""Figures and gate for instruction and response pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import repetition_of, template_share, words


def fingerprint(pairs: DataFrame) -> DataFrame:
    """conv_id, turn, repetition, template, words of the responses; coherence needs embeddings and stays null without.
    The word array is made in a step of its own, as its figures read it several times."""
    out = F.col("output")
    d = pairs.select("conv_id", "turn", words(F.lower(out)).alias("w"), template_share(out).alias("template"))
    return d.select("conv_id", "turn", repetition_of(F.col("w")).alias("repetition"), "template", F.size("w").alias("words"))


def with_coherence(fp: DataFrame, pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``fp`` with the cosine of the instruction's and the response's embeddings, columns of ``pairs`` (conv_id, turn, ...)."""
    from .dynamics import coherence

    return fp.join(coherence(pairs, left, right).select("conv_id", "turn", "coherence"), ["conv_id", "turn"], "left")


def with_input(examples: DataFrame, instruction: str = "instruction", extra: str = "input", output: str = "output") -> DataFrame:
    """(conv_id, turn, instruction, output) of examples read from JSON lines; an optional input is put under the instruction."""
    more = F.col(extra) if extra in examples.columns else F.lit(None).cast("string")
    text = F.when(F.trim(F.coalesce(more, F.lit(""))) == "", F.col(instruction)).otherwise(F.concat_ws("\n", F.col(instruction), more))
    ident = F.col("conv_id") if "conv_id" in examples.columns else F.xxhash64(instruction, output)
    return examples.select(ident.alias("conv_id"), F.lit(0).cast("long").alias("turn"), text.alias("instruction"), F.col(output).alias("output"))


def gate(fp: DataFrame) -> DataFrame:
    """Adds passed: repetition up to 0.40, template up to 0.50, at least 5 words, and coherence of at least 0.10 if it is known."""
    ok = (F.col("repetition") <= 0.40) & (F.col("template") <= 0.50) & (F.col("words") >= 5)
    if "coherence" in fp.columns:
        ok = ok & F.coalesce(F.col("coherence") >= 0.10, F.lit(True))
    return fp.withColumn("passed", ok)


def whole_aggregate(fp: DataFrame, points: DataFrame, cols: list[str], key: str = "ep") -> DataFrame:
    """One row: means of the figures and of the coherence (null where it isn't known), and
    diversity, the mean distance to the nearest other of ``points`` (a row a kept pair; a sample, as
    the figure is defined).  Without pairs all are 0."""
    from .embed import mean_nearest

    figures = fp.agg(*[F.coalesce(F.avg(c), F.when(F.count("*") == 0, 0.0)).alias(c) for c in ("coherence", "repetition", "template", "words")])
    return figures.crossJoin(mean_nearest(points, cols, key).withColumnRenamed("distance", "diversity"))  # one row each


def aggregate(fp: DataFrame) -> DataFrame:
    """One row: means of the figures."""
    return fp.agg(F.avg("repetition").alias("repetition"), F.avg("template").alias("template"), F.avg("words").alias("words"))
