"""Second moments of transitions, which are all that a linear model of the
dynamics needs: episodes' moments add up to a dataset's, a model is solved from
the sum, and its error on an episode, or on another dataset, follows from
theirs.  The steps are read once; what is kept is a small matrix a key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import in_order


def moments(steps: DataFrame, states: Sequence[str], actions: Sequence[str], by: Sequence[str] = ("ep",)) -> DataFrame:
    """(by, n, moments): the number of transitions and the sums of all products of
    u = (states, actions, 1, next states), the upper triangle row by row.
    Transitions with a null anywhere don't count; keys without any have n = 0."""
    u = [*[F.col(c) for c in states], *[F.col(c) for c in actions], F.lit(1.0), *[F.col(f"_n{i}") for i in range(len(states))]]
    d = steps.withColumns({f"_n{i}": F.lead(c).over(in_order()) for i, c in enumerate(states)})
    whole = F.lit(True)
    for c in u:
        whole = whole & c.isNotNull()
    d = d.withColumn("_whole", whole)
    products = [F.sum(F.when(F.col("_whole"), (a * b).cast("double")).otherwise(0.0)) for i, a in enumerate(u) for b in u[i:]]
    return d.groupBy(*by).agg(F.sum(F.col("_whole").cast("long")).alias("n"), F.array(*products).alias("moments"))


def total(parts: DataFrame) -> np.ndarray:
    """The sum of all moments, as a matrix; a row for each product is aggregated."""
    rows = parts.select(F.posexplode("moments").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(max((r.k for r in rows), default=-1) + 1)
    for r in rows:
        flat[r.k] = r.x
    return matrix(flat)


def matrix(flat: Sequence[float]) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    size = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = flat
    return out + np.triu(out, 1).T


class Forecast:
    """A ridge forecast of the next (latent) state from state, action and one, in
    deviations of the states and actions, solved from a sum of moments."""

    def __init__(self, m: np.ndarray, n_states: int, latent: int = 16, ridge: float = 1e-3):
        size = len(m)
        one = size - n_states - 1
        n = max(m[one, one], 1.0)
        mean = m[:one, one] / n
        dev = np.maximum(np.sqrt(np.maximum(np.diag(m)[:one] / n - mean**2, 0)), 1e-8)
        turn = np.zeros((size, size))  # u -> (z, actions, 1, next z)
        turn[np.arange(one), np.arange(one)], turn[np.arange(one), one] = 1 / dev, -mean / dev
        turn[one, one] = 1
        later = one + 1 + np.arange(n_states)
        turn[later, later], turn[later, one] = 1 / dev[:n_states], -mean[:n_states] / dev[:n_states]
        if latent < n_states:
            cov = (turn @ m @ turn.T)[:n_states, :n_states] / n
            values, vectors = np.linalg.eigh(cov)
            axes = vectors[:, np.argsort(-values, kind="stable")[:latent]].T
            axes *= np.sign(axes[np.arange(latent), np.abs(axes).argmax(1)])[:, None]
            turn = np.vstack([axes @ turn[:n_states], turn[n_states : one + 1], axes @ turn[later]])
        self.turn, self.n_x, self.n_y, self.one = turn, len(turn) - min(latent, n_states), min(latent, n_states), one
        g = turn @ m @ turn.T
        x, y = g[: self.n_x, : self.n_x], g[: self.n_x, self.n_x :]
        self.w = np.linalg.solve(x + ridge * np.eye(self.n_x), y)

    def error(self, m: np.ndarray) -> float:
        """Mean squared error over the transitions that have these moments; 0 without any."""
        n = m[self.one, self.one]
        if n <= 0:
            return 0.0
        g = self.turn @ m @ self.turn.T
        x, y, yy = g[: self.n_x, : self.n_x], g[: self.n_x, self.n_x :], g[self.n_x :, self.n_x :]
        return max(0.0, float(np.trace(yy) - 2 * np.sum(self.w * y) + np.sum(self.w * (x @ self.w)))) / (n * self.n_y)

    def errors(self, m: np.ndarray) -> np.ndarray:
        """``error`` of many matrices (a row each) at once."""
        n = m[:, self.one, self.one]
        g = self.turn @ m @ self.turn.T
        x, y, yy = g[:, : self.n_x, : self.n_x], g[:, : self.n_x, self.n_x :], g[:, self.n_x :, self.n_x :]
        e = np.trace(yy, axis1=1, axis2=2) - 2 * (self.w * y).sum((1, 2)) + (self.w * (x @ self.w)).sum((1, 2))
        return np.where(n > 0, np.maximum(e, 0.0) / (np.maximum(n, 1.0) * self.n_y), 0.0)


def scaled_errors(errors: dict) -> dict:
    """Errors by key scaled to 0..1 over all keys; as they are if all are equal."""
    low, high = min(errors.values(), default=0.0), max(errors.values(), default=0.0)
    return {k: (e - low) / (high - low) if high > low else e for k, e in errors.items()}


def change_weights(m: np.ndarray, n_states: int, ridge: float = 1e-4) -> np.ndarray:
    """Weights of state and action (no constant) for the state's change."""
    one = len(m) - n_states - 1
    f, change = m[:one, :one], m[:one, one + 1 :] - m[:one, :n_states]
    return np.linalg.solve(f + ridge * np.eye(one), change)


def change_rmse(m: np.ndarray, w: np.ndarray, n_states: int) -> float:
    """Root mean squared error, over transitions and dimensions, of such a forecast of the change."""
    one = len(m) - n_states - 1
    if m[one, one] <= 0:
        return 0.0
    f, change = m[:one, :one], m[:one, one + 1 :] - m[:one, :n_states]
    moved = m[one + 1 :, one + 1 :] - m[one + 1 :, :n_states] - m[:n_states, one + 1 :] + m[:n_states, :n_states]
    squares = np.trace(moved) - 2 * np.sum(w * change) + np.sum(w * (f @ w))
    return float(np.sqrt(max(0.0, squares) / (m[one, one] * n_states)))
