"""Recording sessions that are watched while they run.

The first stream judges the episodes of each arriving file and keeps what a
model of the dynamics needs of them: their moments, a few numbers.  The second
is stateful: for each session it holds the counters, the sum of the moments, and the
moments of each episode.  A refit solves the sum and scores all episodes from
their moments; no step is read twice, however long the session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import moments as mo
from .watch import episode_verdicts

STEPS = "session string, ep long, step long, t double, a0 double, s0 double"
SUMMARIES = "session string, ep long, verdict string, metric string, n long, moments array<double>"
#: kind is episode (a log entry with the counters after it) or score (of an episode, after a refit to ``fitted`` episodes)
LOG = "session string, kind string, seq long, ep long, verdict string, metric string, n_pass long, n_warn long, n_fail long, fitted long, surprise double, label string"
#: Scores from which an episode is called novel or familiar.
NOVEL, FAMILIAR = 0.65, 0.35


def label(score: float | None) -> str:
    if score is None:
        return "learning"
    return "novel" if score >= NOVEL else "familiar" if score >= FAMILIAR else "redundant"


def summaries(steps: DataFrame) -> DataFrame:
    """A row an episode of whole episodes (STEPS; numbers of episodes are the sessions' own to keep apart)."""
    judged = episode_verdicts(steps).select("ep", "verdict", "metric")
    kept = mo.moments(steps, ("s0",), ("a0",), by=("session", "ep"))
    return kept.join(judged, "ep").select("session", "ep", "verdict", "metric", "n", "moments")


class Session(StatefulProcessor):
    """Counts, logs and scores one session's episodes.  An episode that comes
    again replaces what was known of it, so a file that is delivered twice changes nothing."""

    def __init__(self, least: int = 5, every: int = 5, n_states: int = 1):
        self.least, self.every, self.n_states = least, every, n_states

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "n long, n_pass long, n_warn long, n_fail long, seq long, moments array<double>")
        self.episodes = handle.getMapState("episodes", "ep long", "verdict string, moments array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import numpy as np
        import pandas as pd

        names = [f.split()[0] for f in LOG.split(", ")]
        types = {c: "Int64" for c in ("seq", "ep", "n_pass", "n_warn", "n_fail", "fitted")} | {"surprise": "float64"}

        def kept(keys, all_, done):
            """Episodes by number, with those that came or came again."""
            last = {ep: own for ep, own in done}
            if not last:
                return keys, all_
            new = np.array(sorted(last))
            old = ~np.isin(keys, new)
            keys, all_ = np.concatenate([keys[old], new]), np.concatenate([all_[old], [mo.matrix(last[k]) for k in new.tolist()]])
            order = np.argsort(keys)
            return keys[order], all_[order]

        def scores(name, seq, keys, fitted, score):
            labels = np.select([score >= NOVEL, score >= FAMILIAR], ["novel", "familiar"], "redundant").astype(object)
            d = {"session": name, "kind": "score", "seq": seq + 1 + np.arange(len(keys)), "ep": keys, "fitted": fitted, "surprise": score, "label": labels}
            return pd.DataFrame({c: d.get(c) for c in names}, index=range(len(keys))).astype(types)

        known = self.totals.get() if self.totals.exists() else None
        n, n_pass, n_warn, n_fail, seq = known[:5] if known else (0, 0, 0, 0, 0)
        total = np.array(known[5], float) if known else None
        count = {"PASS": n_pass, "WARN": n_warn, "FAIL": n_fail}
        keys = all_ = None  # the episodes and their moments, read at the first refit and kept up from there
        for part in rows:
            log, done = [], []

            def entries():
                frame = pd.DataFrame(log, columns=names).astype(types)
                log.clear()
                return frame

            for r in part.sort_values("ep").itertuples():
                ep, own = int(r.ep), np.array(r.moments, float)
                total = np.zeros_like(own) if total is None else total
                again = self.episodes.containsKey((ep,))
                if again:
                    verdict, before = self.episodes.getValue((ep,))
                    count[verdict] -= 1
                    total = total - np.array(before, float)
                self.episodes.updateValue((ep,), (r.verdict, own.tolist()))
                done.append((ep, own))
                count[r.verdict] += 1
                total = total + own
                if again:
                    continue
                n, seq = n + 1, seq + 1
                log.append((key[0], "episode", seq, ep, r.verdict, r.metric, count["PASS"], count["WARN"], count["FAIL"], None, None, None))
                if n >= self.least and n % self.every == 0:
                    model = mo.Forecast(mo.matrix(total), self.n_states)
                    if keys is None:
                        known = sorted((k[0], v[1]) for k, v in self.episodes.iterator())
                        keys, all_ = np.array([k for k, _ in known]), np.array([mo.matrix(m) for _, m in known])
                    else:
                        keys, all_ = kept(keys, all_, done)
                    done.clear()
                    e = model.errors(all_)
                    low, high = e.min(), e.max()
                    score = (e - low) / (high - low) if high > low else e
                    yield entries()
                    yield scores(key[0], seq, keys, n, score)
                    seq += len(keys)
            if keys is not None:
                keys, all_ = kept(keys, all_, done)
            if log:
                yield entries()
        self.totals.update((n, count["PASS"], count["WARN"], count["FAIL"], seq, (total if total is not None else np.zeros(0)).tolist()))

    def close(self) -> None:
        pass


def summarise(spark: SparkSession, path: str, out: str, files: int = 1):
    """The first stream's writer: files of whole episodes (Parquet of STEPS) in ``path`` to ``out``/summaries.
    A batch that is tried again overwrites its own folder."""

    def process(batch: DataFrame, number: int) -> None:
        summaries(batch).write.mode("overwrite").parquet(f"{out}/summaries/batch={number}")

    return spark.readStream.schema(STEPS).option("maxFilesPerTrigger", files).parquet(path).writeStream.foreachBatch(process).option("checkpointLocation", f"{out}/checkpoint/summaries")


def sessions(spark: SparkSession, out: str, least: int = 5, every: int = 5):
    """The second stream's writer: ``out``/summaries to ``out``/log (LOG), with its state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.readStream.schema(SUMMARIES).option("recursiveFileLookup", "true").parquet(f"{out}/summaries")
    log = rows.groupBy("session").transformWithStateInPandas(Session(least, every), LOG, "Append", "None")
    return log.writeStream.format("parquet").outputMode("append").option("path", f"{out}/log").option("checkpointLocation", f"{out}/checkpoint/sessions")


def run_available(spark: SparkSession, path: str, out: str, least: int = 5, every: int = 5, timeout: int | None = None) -> DataFrame:
    """Both streams over what has arrived by now; returns the log.  With a ``timeout`` (seconds for
    each) a stream that isn't through by then is stopped and an error raised: half a log is never returned."""
    for writer in (lambda: summarise(spark, path, out), lambda: sessions(spark, out, least, every)):
        stream = writer().trigger(availableNow=True).start()
        if timeout is None:
            stream.awaitTermination()
        elif not stream.awaitTermination(timeout):
            stream.stop()
            raise TimeoutError(f"a stream over {path} wasn't through after {timeout} s")
    return spark.read.schema(LOG).parquet(f"{out}/log")


def counters(log: DataFrame) -> DataFrame:
    """(session, n_pass, n_warn, n_fail): where each session stands."""
    last = F.max_by(F.struct("n_pass", "n_warn", "n_fail"), "seq").alias("c")
    return log.where("kind = 'episode'").groupBy("session").agg(last).select("session", "c.*")
