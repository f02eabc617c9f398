"""Coresets: top-k by a score, and greedy coverage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage

#: One task makes the greedy choice of up to this many rows; beyond, so many picks at most are made by a job each.
MAX_EXACT, MAX_JOBS = 50_000, 256


def keep_count(n: int, fraction: float) -> int:
    """How many to keep of ``n``: at least one, halves to even."""
    return max(1, round(n * fraction))


def top_k(scores: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` episodes with the largest scores, the smaller number first on ties."""
    return scores.orderBy(F.desc_nulls_last(column), "ep").limit(k)


def calm_top_k(scores: DataFrame, column: str, error: str, k: int) -> DataFrame:
    """As ``top_k`` after the worst tenth by ``error`` is left out, if there are over ten."""
    cut = scores.agg(F.percentile(error, F.lit(0.9)).alias("cut"), F.count("*").alias("n"))
    kept = scores.crossJoin(F.broadcast(cut)).where((F.col("n") <= 10) | (F.col(error) <= F.col("cut")))  # one row
    return top_k(kept.drop("cut", "n"), column, k)


def greedy_cover(x: np.ndarray, k: int) -> list[int]:
    """Rows chosen one by one, each the farthest from those before; the first
    is the farthest from the centroid, and the lowest row wins ties."""
    if not len(x) or k <= 0:
        return []
    k = min(k, len(x))
    picked = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    near = ((x - x[picked[0]]) ** 2).sum(1)
    near[picked[0]] = -1.0
    while len(picked) < k:
        p = int(near.argmax())
        picked.append(p)
        near = np.minimum(near, ((x - x[p]) ** 2).sum(1))
        near[picked] = -1.0
    return picked


def merge_levels(n: int, k: int, part: int) -> int:
    """How often parts are reduced before the last choice."""
    levels = 0
    while n > part:
        parts = -(-n // part)
        if 2 * parts * k > n:
            raise ValueError("with more picks than half a part has rows, parts don't get smaller")
        n, levels = parts * k, levels + 1
    return levels


def k_center(features: DataFrame, cols: list[str], k: int, key: str = "ep", part: int = 4096) -> DataFrame:
    """(key, rank): ``k`` rows that cover the features, with a proven radius.

    A merge tree of composable core-sets: rows lie in hashed parts, each part
    keeps the ``k`` that cover it greedily, the kept ones lie in new parts, and so on until one
    part is left, which makes the choice.  With L levels (``merge_levels``) no row
    is farther from a pick than 2 (L + 1) times the best possible radius, however
    rows fall into parts: each level moves a row's stand-in by twice that radius at most, and so does
    the last choice.  Parts have max(``part``, 4 k) rows, a task's memory; nothing comes to the driver.

    A ``k`` of more than an eighth of all rows can't be composed so: then each part
    gives its share of the picks, which has no such bound.
    """
    df = features.select(F.col(key).cast("long").alias("k"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    n, k = df.count(), max(k, 0)

    def chosen(df: DataFrame, parts: int, each: int) -> DataFrame:
        def pick(pdf):
            pdf = pdf.sort_values("k", kind="stable")
            got = pdf.iloc[greedy_cover(np.array(pdf["x"].tolist()), each)][["k", "x"]]
            return got.assign(rank=np.arange(len(got), dtype=np.int32))

        return df.groupBy(F.pmod(F.xxhash64("k"), F.lit(parts))).applyInPandas(pick, "k long, x array<double>, rank int")

    part = max(part, 4 * k)
    if n > part and 8 * k > n:
        parts = -(-n // part)
        own = cut_lineage(chosen(df, parts, -(-k // parts)))
        return own.orderBy("rank", "k").limit(k).select(F.col("k").alias(key), "rank")
    while n > part:
        df = cut_lineage(chosen(df, -(-n // part), k).select("k", "x"))
        n = df.count()
    return chosen(df, 1, k).select(F.col("k").alias(key), "rank")


def k_center_exact(features: DataFrame, cols: list[str], k: int, key: str = "ep", max_exact: int = MAX_EXACT, cut: int = 8) -> DataFrame:
    """(key, rank): ``k`` rows that cover the features, as ``greedy_cover``
    chooses them at any size.

    Up to ``max_exact`` rows one task chooses; beyond, each pick is one
    distributed argmax over a table of running distances, which is written
    anew every ``cut`` picks.  Only the picked rows come to the driver.  That is for few picks: ``MAX_JOBS``.
    """
    df = features.select(F.col(key).cast("long").alias("k"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    n = df.count()
    if n <= max_exact:  # one part, so the choice is exact
        return k_center(features, cols, k, key, max_exact)
    centre = np.array(df.agg(*[F.avg(F.col("x")[i]) for i in range(len(cols))]).first())
    # the table holds each row's squared distance to the nearest pick; the first argmax is by the distance to the centroid
    held = cut_lineage(df.select(F.monotonically_increasing_id().alias("id"), "k", "x", F.lit(float("inf")).alias("near")))

    def moved(points: list[np.ndarray], ids: list[int]) -> DataFrame:
        import pyarrow as pa

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                near = b.column(3).to_numpy().copy()
                for p in points:
                    near = np.minimum(near, ((x - p) ** 2).sum(1))
                near[np.isin(b.column(0).to_numpy(), ids)] = -1.0
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(near)], names=["id", "k", "x", "near"])

        return held.mapInArrow(run, "id long, k long, x array<double>, near double")

    picked: list[tuple[int, int]] = []
    points: list[np.ndarray] = []
    ids: list[int] = []
    while len(picked) < min(k, n):
        far = moved(points if picked else [centre], ids).orderBy(F.desc("near"), "k", "x", "id").first()
        picked.append((far.k, len(picked)))
        points.append(np.array(far.x))
        ids.append(far.id)
        if len(points) == cut:
            held = cut_lineage(moved(points, ids))
            points, ids = [], []
    return features.sparkSession.createDataFrame(picked, f"{key} long, rank int")


def distance_to(selected: DataFrame, rows: DataFrame, cols: list[str], key: str = "ep") -> DataFrame:
    """(key, distance): of each row to the nearest selected one, through inverted lists, whatever the selection's size."""
    from .neighbours import nearest

    d = nearest(rows.select(key, *cols), selected.select(key, *cols), cols, key)
    return d.select(key, (F.col("distance") * float(len(cols)) ** 0.5).alias("distance"))


def weighted_features(features: DataFrame, action: list[str], quality: list[str], entropy: str | None = None, diversity_weight: float = 0.7, entropy_weight: float = 0.0) -> tuple[DataFrame, list[str]]:
    """(features, columns): each column scaled to 0..1, then the action block times
    its weight, the entropy times its own, and the quality block times what is left."""
    from .coverage import scaled

    cols = [*action, *quality, *([entropy] if entropy else [])]
    d = scaled(features.select("ep", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]), cols)
    rest = max(0.0, 1.0 - diversity_weight - entropy_weight)
    weight = {c: diversity_weight for c in action} | {c: rest for c in quality} | ({entropy: entropy_weight} if entropy else {})
    return d.select("ep", *[(F.col(c) * weight[c]).alias(c) for c in cols]), cols


def two_stage(gate: DataFrame, fraction: float, strategy: str = "diversity", features: DataFrame | None = None, cols: list[str] | None = None, scores: DataFrame | None = None, error: str | None = None, exact: bool = True) -> DataFrame:
    """(ep, decision, reasons): keep, quality_fail or diversity_pruned for each
    episode of ``gate`` (ep, reasons, status).

    Those that the gate refuses go.  Of the others ``fraction`` of all episodes
    stay (halves to even, at least one; all if there are no more), chosen by ``strategy``: "diversity" covers
    ``features`` (ep, cols), exactly for up to ``MAX_EXACT`` episodes or ``MAX_JOBS`` picks and by ``k_center`` beyond; any other name ("novelty", "influence", "world-model") takes the largest
    ``scores`` (ep, score), missing ones as 0; "energy" does so after the worst tenth by ``error`` is left out.
    """
    passed = gate.where("status <> 'bad'").select("ep")
    n, n_pass = gate.agg(F.count("*"), F.coalesce(F.sum((F.col("status") != "bad").cast("long")), F.lit(0))).first()
    k = keep_count(n, fraction)
    if k >= n_pass:
        kept = passed
    elif strategy == "diversity":
        own = features.join(passed, "ep", "left_semi")
        few = exact and (n_pass <= MAX_EXACT or k <= MAX_JOBS)  # else the merge tree, with its bound
        kept = (k_center_exact if few else k_center)(own, cols, k).select("ep")
    else:
        own = passed.join(scores, "ep", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        kept = (calm_top_k(own, "score", error, k) if strategy == "energy" else top_k(own, "score", k)).select("ep")
    d = gate.join(kept.withColumn("kept", F.lit(True)), "ep", "left")
    decision = F.when(F.col("status") == "bad", "quality_fail").when(F.col("kept"), "keep").otherwise("diversity_pruned")
    reasons = F.when(F.col("status") == "bad", F.col("reasons")).when(F.col("kept"), "").otherwise(f"not_selected_{strategy.replace('-', '_')}")
    return d.select("ep", decision.alias("decision"), reasons.alias("reasons"))


def entropy_ranking(entropy: DataFrame) -> DataFrame:
    """(ep, entropy, rank) from (ep, entropy), the largest first."""
    from .export import numbered

    d = entropy.withColumn("_o", F.struct((-F.round("entropy", 9)).alias("e"), "ep"))
    return numbered(d, "_o").select("ep", "entropy", F.col("place").alias("rank"))


def select_pairs(fingerprint: DataFrame, embedding: DataFrame, cols: list[str], fraction: float = 0.5) -> DataFrame:
    """(ep, decision) of instruction and response pairs: those that fail their
    gate (ep, passed) go, and of the others so many stay as cover their embeddings (ep, cols)."""
    gate = fingerprint.select("ep", F.lit("").alias("reasons"), F.when(F.col("passed"), "clean").otherwise("bad").alias("status"))
    return two_stage(gate, fraction, "diversity", embedding, cols).select("ep", "decision")


def influence(features: DataFrame) -> DataFrame:
    """(ep, influence) from (ep, novelty, entropy, contact): 0.4, 0.3 and 0.3 of
    each scaled to 0..1; a constant one counts as 1."""
    from .coverage import scaled

    d = scaled(features, ["novelty", "entropy", "contact"], constant=1.0)
    return d.select("ep", (0.4 * F.col("novelty") + 0.3 * F.col("entropy") + 0.3 * F.col("contact")).alias("influence"))
