"""Series on a gap-free grid: lags, trailing windows with a least count, runs, ranks, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window


def series(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(agg, c: Column, w: WindowSpec, size: int, least: int, current: bool = False) -> Column:
    """``agg`` over the ``size`` rows before this one (to it, if ``current``); null under ``least`` values."""
    frame = w.rowsBetween(1 - size, 0) if current else w.rowsBetween(-size, -1)
    return F.when(F.count(c).over(frame) >= least, agg(c).over(frame))


def change_share(c: Column, w: WindowSpec, limit: float = 5.0) -> Column:
    x = F.try_divide(c.cast("double"), F.lag(c).over(w).cast("double")) - 1
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-limit)), F.lit(limit)))


def run_start(flag: Column, follows: Column, w: WindowSpec) -> Column:
    """1 where a run begins: the flag differs from the row before, or this row does not follow it."""
    return F.when(F.lag(flag).over(w).eqNullSafe(flag) & F.coalesce(follows, F.lit(False)), 0).otherwise(1)


def average_rank(order: Column, *keys: str) -> Column:
    """Rank from 1 with ties at their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, order)) - 1) / F.lit(2.0)


def interpolated(c: Column, w: WindowSpec, position: Column, limit: int = 3) -> Column:
    """Linear between the neighbours that are there, at most ``limit`` rows from one of them; ends are carried on."""
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    at = F.when(c.isNotNull(), position)
    x0, x1 = F.last(c, True).over(before), F.first(c, True).over(after)
    p0, p1 = F.last(at, True).over(before), F.first(at, True).over(after)
    near = F.least(position - p0, p1 - position) <= limit
    line = x0 + (x1 - x0) * (position - p0) / (p1 - p0)
    return F.coalesce(c, F.when(near & x0.isNotNull() & x1.isNotNull(), line), F.when((position - p0 <= limit) & x1.isNull(), x0), F.when((p1 - position <= limit) & x0.isNull(), x1))
