"""Camera frames as arrays of pixels: sharpness, repeats, freezes, and how
frames move with the actions.

Frames are rows (ep, step, pixels), ``pixels`` a flat array of ``width`` wide
rows.  An array is worked on by higher-order functions inside its row; what
compares neighbours is a window over one exchange by episode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import in_order, median, upper_level, whole
from .tasks import islands

#: Words of a camera's name that say that it moves, that it stands, or nothing.
MOVING = ("wrist", "gripper", "hand", "eih", "eyeinhand", "inhand", "eye", "handeye")
STATIC = (
    "top", "bottom", "front", "back", "rear", "left", "right", "side", "overhead", "birdview", "bird", "high", "low", "center", "centre",
    "angled", "angle", "diagonal", "agentview", "external", "exo", "exterior", "third", "thirdperson", "fixed", "base", "scene", "room", "table", "corner",
)

HIGH, LOW, MARGIN = 0.5, 0.15, 0.1


def sharpness(frames: DataFrame, width: int, height: int) -> DataFrame:
    """(ep, step, sharpness): variance of the discrete Laplacian over a frame's inner pixels."""
    inner = F.array(*[F.lit(r * width + c) for r in range(1, height - 1) for c in range(1, width - 1)])
    at = lambda i: F.get("pixels", i)
    lap = F.transform(inner, lambda i: at(i - 1) + at(i + 1) + at(i - width) + at(i + width) - 4.0 * at(i))
    d = frames.select("ep", "step", lap.alias("lap"))
    n = F.size("lap").cast("double")
    total = lambda f: F.aggregate("lap", F.lit(0.0), lambda a, x: a + f(x))
    d = d.withColumn("mean", total(lambda x: x) / n)
    return d.select("ep", "step", (total(lambda x: (x - F.col("mean")) * (x - F.col("mean"))) / n).alias("sharpness"))


def transitions(frames: DataFrame, tolerance: float = 2.0, min_changed: float = 5e-4) -> DataFrame:
    """(ep, step, activity, repeated) for each frame but an episode's first:
    mean change of a pixel, and whether fewer than ``min_changed`` of them
    changed by more than ``tolerance`` of 255 (frames of up to 1 are scaled)."""
    top = F.max(F.array_max("pixels")).over(whole())
    d = frames.withColumns({"before": F.lag("pixels").over(in_order()), "scale": F.when(top <= 1.0, 255.0).otherwise(1.0)})
    d = d.where("before is not null").withColumn("change", F.zip_with("pixels", "before", lambda a, b: F.abs(a - b)))
    n = F.size("change").cast("double")
    mean = F.aggregate("change", F.lit(0.0), lambda a, x: a + x) / n
    moved = F.size(F.filter("change", lambda x: x * F.col("scale") > tolerance)) / n
    keep = [c for c in frames.columns if c not in ("ep", "step", "pixels")]
    return d.select("ep", "step", *keep, mean.alias("activity"), (moved < min_changed).alias("repeated"))


def episode_frames(frames: DataFrame, width: int, height: int, tolerance: float = 2.0, min_changed: float = 5e-4) -> DataFrame:
    """(ep, sharpness, duplicate_fraction, freeze_run): mean sharpness, share of
    repeated transitions and the longest run of them."""
    t = transitions(frames, tolerance, min_changed)
    runs = islands(t, F.col("repeated")).groupBy("ep").agg(F.max("length").alias("freeze_run"))
    dup = t.groupBy("ep").agg(F.avg(F.col("repeated").cast("double")).alias("duplicate_fraction"))
    d = sharpness(frames, width, height).groupBy("ep").agg(F.avg("sharpness").alias("sharpness"))
    return d.join(dup, "ep", "left").join(runs, "ep", "left").withColumn("freeze_run", F.when(F.col("duplicate_fraction").isNotNull(), F.coalesce("freeze_run", F.lit(0))))


def blur_outliers(episodes: DataFrame) -> DataFrame:
    """(ep, sharpness, blurry): below the lower fence of the episodes' mean sharpness; none with fewer than 4."""
    q = episodes.where("sharpness is not null").agg(F.percentile("sharpness", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    d = episodes.where("sharpness is not null").crossJoin(F.broadcast(q))  # one row
    fence = F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0])
    return d.select("ep", "sharpness", ((F.col("n") >= 4) & (F.col("sharpness") < fence)).alias("blurry"))


def frame_flags(episodes: DataFrame, min_run: int = 5, draws: int = 0, level_of_interval: float = 0.95) -> DataFrame:
    """(metric, value, level) of duplicate frames, freezes and blur over all
    episodes.  With ``draws`` the duplicate rate also gets low and high, percentiles of resampled means."""
    blur = blur_outliers(episodes).agg(F.avg(F.col("blurry").cast("double")).alias("value")).select(F.lit("blurry_episode_fraction").alias("metric"), "value", upper_level(F.col("value"), 0.05, 0.15).alias("level"))
    dup = episodes.agg(F.avg("duplicate_fraction").alias("value")).select(F.lit("duplicate_frame_rate").alias("metric"), "value", upper_level(F.col("value"), 0.05, 0.15).alias("level"))
    froze = episodes.where("freeze_run is not null").agg(F.avg((F.col("freeze_run") >= min_run).cast("double")).alias("value"))
    level = F.when(F.col("value") >= 0.10, "CRITICAL").when(F.col("value") > 0, "WARNING").otherwise("OK")
    out = blur.unionByName(dup).unionByName(froze.select(F.lit("camera_freeze_events").alias("metric"), "value", level.alias("level")))
    if draws:
        from .dynamics import bootstrap_means

        rates = episodes.select(F.lit("duplicate_frame_rate").alias("metric"), "ep", F.col("duplicate_fraction").alias("value"))
        out = out.join(bootstrap_means(rates, draws, level_of_interval).drop("mean"), "metric", "left")
    return out


def motion_pairs(frames: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(ep, step, activity, motion): change of the frame and of the actions from the step before."""
    total = sum(((F.col(c) - F.lag(c).over(in_order())) ** 2 for c in dims), F.lit(0.0))
    moved = frames.withColumn("motion", F.sqrt(total))
    return transitions(moved.select("ep", "step", "pixels", "motion")).select("ep", "step", "activity", "motion")


def egomotion(frames: DataFrame, dims: tuple[str, ...], min_transitions: int = 5) -> DataFrame:
    """(ep, r): correlation of frame and action changes; null for short or constant ones."""
    g = motion_pairs(frames, dims).groupBy("ep").agg(F.count("*").alias("n"), F.corr("activity", "motion").alias("r"), F.stddev_pop("activity").alias("sa"), F.stddev_pop("motion").alias("sm"))
    ok = (F.col("n") >= min_transitions) & (F.col("sa") >= 1e-9) & (F.col("sm") >= 1e-9)
    return g.select("ep", F.when(ok, F.col("r")).alias("r"))


def viewpoint(key: Column) -> Column:
    """What a camera's name says: moving, static or unknown; moving wins."""
    words = F.split(F.lower(key), "[^a-z0-9]+")
    has = lambda known: F.arrays_overlap(words, F.array(*map(F.lit, known)))
    return F.when(has(MOVING), "moving").when(has(STATIC), "static").otherwise("unknown")


def camera_mismatch(correlations: DataFrame, min_episodes: int = 3) -> DataFrame:
    """(camera, declared, median_r, level) of (ep, camera, r).  WARNING: the static
    camera that moves most with the arm and the moving one that does least, if the first
    beats the second by a margin, and any static one that moves with the arm.  INFO: a camera of an unknown
    view that moves with the arm, and a moving one that hardly does."""
    g = correlations.where("r is not null").groupBy("camera").agg(median("r").alias("median_r"), F.count("*").alias("n")).where(F.col("n") >= min_episodes)
    g = g.withColumn("declared", viewpoint(F.col("camera")))
    ends = g.agg(F.max(F.when(F.col("declared") == "static", F.col("median_r"))).alias("top_static"), F.min(F.when(F.col("declared") == "moving", F.col("median_r"))).alias("low_moving"))
    d = g.crossJoin(F.broadcast(ends))  # one row
    static, moving = F.col("declared") == "static", F.col("declared") == "moving"
    apart = F.col("top_static") > F.col("low_moving") + MARGIN
    beside = apart & ((static & (F.col("median_r") == F.col("top_static"))) | (moving & (F.col("median_r") == F.col("low_moving"))))
    high, low = F.col("median_r") >= HIGH, F.col("median_r") <= LOW
    level = F.when(F.coalesce(beside, F.lit(False)) | (static & high), "WARNING").when(((F.col("declared") == "unknown") & high) | (moving & low), "INFO").otherwise("OK")
    return d.select("camera", "declared", "median_r", level.alias("level"))


def correlation_lags(pairs: DataFrame, x: str, y: str, min_steps: int = 3) -> DataFrame:
    """(ep, lag): the shift of ``x`` against ``y`` (both z-scored) with the
    largest sum of products over all overlaps, the smallest of equals; null where one is constant."""
    w = whole()
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)
    d = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumns({"zx": F.when(F.stddev_pop(x).over(w) > 1e-9, z(x)), "zy": F.when(F.stddev_pop(y).over(w) > 1e-9, z(y))})

    def run(batches):
        """One episode after another: all overlaps at once, as a product of transforms."""
        import numpy as np
        import pyarrow as pa

        now, held = None, []

        def lag():
            zx, zy = (np.concatenate(c) for c in zip(*held))
            n = len(zx)
            if n < min_steps or np.isnan(zx).any() or np.isnan(zy).any():
                return None
            size = 1 << (2 * n - 1).bit_length()
            full = np.fft.irfft(np.fft.rfft(zx, size) * np.conj(np.fft.rfft(zy, size)), size)
            sums = np.round(np.concatenate([full[size - n + 1 :], full[:n]]), 8)  # shifts 1 - n to n - 1
            return int(sums.argmax()) - (n - 1)

        for b in batches:
            if not b.num_rows:
                continue
            ep = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(ep)) + 1).tolist(), len(ep)]
            eps, lags = [], []
            for s, e in zip(edges, edges[1:]):
                if held and ep[s] != now:
                    eps.append(now)
                    lags.append(lag())
                    held = []
                now = int(ep[s])
                held.append([b.column(k)[s:e].to_numpy(zero_copy_only=False).astype(float) for k in (1, 2)])
            yield pa.RecordBatch.from_arrays([pa.array(eps, pa.int64()), pa.array(lags, pa.int64())], names=["ep", "lag"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([lag()], pa.int64())], names=["ep", "lag"])

    # the windows have dealt the steps by episode
    return d.repartition("ep").sortWithinPartitions("ep", "step").select(F.col("ep").cast("long"), "zx", "zy").mapInArrow(run, "ep long, lag long")


def physics_drift(lags: DataFrame, warning: int = 2, critical: int = 5) -> DataFrame:
    """One row: drift (the median lag, cut to whole frames) and level."""
    g = lags.agg(median("lag").alias("m")).select(F.col("m").cast("long").alias("drift"))
    off = F.abs("drift")
    return g.select("drift", F.when(off >= critical, "CRITICAL").when(off >= warning, "WARNING").when(off.isNotNull(), "OK").otherwise("INFO").alias("level"))
