"""Column expressions that several operators use."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

EPISODE = "ep"


def in_order() -> WindowSpec:
    """An episode's steps in order."""
    return Window.partitionBy(EPISODE).orderBy("step")


def whole() -> WindowSpec:
    """All steps of an episode; shares the exchange of ``in_order``."""
    return Window.partitionBy(EPISODE)


def norm(cols: Iterable[Column | str]) -> Column:
    """The Euclidean norm over columns."""
    total = F.lit(0.0)
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        total = total + c * c
    return F.sqrt(total)


def median(c: Column | str) -> Column:
    """The exact, interpolated median."""
    return F.percentile(c, F.lit(0.5))


def share(condition: Column) -> Column:
    """The share of rows with a true condition; rows where it is null don't count."""
    return F.avg(F.when(condition.isNotNull(), condition.cast("double")))


def rounded(c: Column | str, digits: int) -> Column:
    """Rounded as SQL engines on doubles do it: the scaled value to the nearest whole number, halves away from zero.
    ``F.round`` goes by the shortest decimal in place of that, which differs where a half isn't exact (62.949999999999996, 0.0640625)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * float(10**digits)) / float(10**digits)


def out(c: Column, digits: int = 6) -> Column:
    """A figure as results show it: rounded, and never minus zero."""
    return rounded(c.cast("double"), digits) + F.lit(0.0)


def upper_level(value: Column, warning: float, critical: float) -> Column:
    """OK, WARNING or CRITICAL where large values are bad."""
    return F.when(value >= critical, "CRITICAL").when(value >= warning, "WARNING").otherwise("OK")


def lower_level(value: Column, warning: float, critical: float) -> Column:
    """OK, WARNING or CRITICAL where small values are bad."""
    return F.when(value <= critical, "CRITICAL").when(value <= warning, "WARNING").otherwise("OK")


def ramp(value: Column, start: float, end: float) -> Column:
    """0 at ``start`` and before, 1 at ``end`` and beyond, linear between; null stays 0."""
    x = (value - F.lit(start)) / F.lit(end - start)
    return F.coalesce(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def min_max(c: str, over: WindowSpec, constant: float = 0.0) -> Column:
    """Scaled to 0..1 over a window; a constant column gives ``constant``."""
    lo, hi = F.min(c).over(over), F.max(c).over(over)
    return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).when(F.col(c).isNotNull(), F.lit(constant))
