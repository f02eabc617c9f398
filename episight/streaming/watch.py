"""Verdicts on episodes as they arrive.

Stateless: each row is judged by the first figure that fails, so there is no
watermark and nothing to keep; counts by verdict are a complete-mode query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "episode_id string, spike_rate double, disc_rate double, dropout double, ldlj double"

#: Fixed values: (warning, failure) in the order in which figures are looked at.
LADDER = {"spike_rate": (0.02, 0.05), "disc_rate": (0.02, 0.05), "dropout": (0.01, 0.05), "ldlj": (-10.0, -15.0)}


def _beyond(metric: str, bound: float) -> Column:
    c = F.col(metric)
    return c <= bound if LADDER[metric][1] < LADDER[metric][0] else c >= bound


def verdicts(rows: DataFrame) -> DataFrame:
    """Adds verdict (PASS, WARN, FAIL) and metric, the first that fails or else warns."""
    fail = [F.when(_beyond(m, b[1]), m) for m, b in LADDER.items()]
    warn = [F.when(_beyond(m, b[0]), m) for m, b in LADDER.items()]
    d = rows.withColumns({"failed": F.coalesce(*fail), "warned": F.coalesce(*warn)})
    d = d.withColumn("verdict", F.when(F.col("failed").isNotNull(), "FAIL").when(F.col("warned").isNotNull(), "WARN").otherwise("PASS"))
    return d.withColumn("metric", F.coalesce("failed", "warned")).drop("failed", "warned")


def watch(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A streaming frame of verdicts on JSON lines that arrive in ``path``."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).json(path)
    return verdicts(rows)


def counts(watched: DataFrame) -> DataFrame:
    """Verdicts so far; for output mode complete."""
    return watched.groupBy("verdict").agg(F.count("*").alias("n"))


STEPS = "ep long, step long, t double, a0 double, s0 double"


def report_verdict(flags: DataFrame) -> DataFrame:
    """One row: verdict (FAIL, WARN or PASS, as the worst level of (metric, level) is) and the metric that has it, the first by name."""
    rank = F.when(F.col("level") == "CRITICAL", 2).when(F.col("level") == "WARNING", 1).otherwise(0)
    worst = flags.agg(F.min(F.struct((-rank).alias("r"), "metric")).alias("w"))
    r = F.coalesce(F.col("w.r"), F.lit(0))
    return worst.select(F.when(r == -2, "FAIL").when(r == -1, "WARN").otherwise("PASS").alias("verdict"), F.when(r < 0, F.col("w.metric")).alias("metric"))


def episode_verdicts(steps: DataFrame) -> DataFrame:
    """(ep, figures, verdict, metric) of whole episodes."""
    from ..operators import motion, timing

    figures = timing.timing_metrics(steps).join(motion.motion_metrics(steps).drop("n_steps"), "ep").join(motion.whole_ldlj(steps, ("a0",)), "ep")
    return verdicts(figures)


def watch_steps(spark: SparkSession, path: str, out: str, min_episodes: int = 5, retrain_every: int = 5):
    """A stream writer that analyses the episodes arriving in ``path`` (Parquet
    of STEPS, each episode whole in one file) and judges them.

    Each micro-batch writes its verdicts to ``out``/verdicts and its steps to
    ``out``/steps, in a folder named by the batch, which a retry overwrites.  Once there are
    ``min_episodes``, and after every ``retrain_every`` more, the forecast of the dynamics is fitted
    anew to all steps so far and the scores go to ``out``/surprise.
    """
    from ..operators.surprise import surprise

    def process(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/steps/batch={number}")
        steps = spark.read.schema(STEPS).parquet(f"{out}/steps/batch={number}")
        episode_verdicts(steps).write.mode("overwrite").parquet(f"{out}/verdicts/batch={number}")
        known = spark.read.parquet(f"{out}/steps").select("ep", "batch").distinct().groupBy("batch").agg(F.count("*").alias("n")).collect()  # a row a batch
        n = sum(r.n for r in known)
        before = sum(r.n for r in known if r.batch != number)
        if n >= min_episodes and (before < min_episodes or n // retrain_every > before // retrain_every):
            surprise(spark.read.parquet(f"{out}/steps").drop("batch"), ("s0",), ("a0",)).write.mode("overwrite").parquet(f"{out}/surprise/batch={number}")

    return spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(path).writeStream.foreachBatch(process).option("checkpointLocation", f"{out}/checkpoint")
