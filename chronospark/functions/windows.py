"""Aggregates over frames of rows, with pandas' meaning of each and one row enough for a value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _unbiased_skew(x: Column, w: WindowSpec) -> Column:
    n = F.count(x).over(w)
    return F.when((n >= 3) & (F.var_pop(x).over(w) > 0), F.skewness(x).over(w) * F.sqrt(n * (n - 1)) / (n - 2))


def _unbiased_kurtosis(x: Column, w: WindowSpec) -> Column:
    n = F.count(x).over(w)
    return F.when((n >= 4) & (F.var_pop(x).over(w) > 0), ((n + 1) * F.kurtosis(x).over(w) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def _sem(x: Column, w: WindowSpec) -> Column:
    n = F.count(x).over(w)
    return F.when(n > 1, F.stddev_samp(x).over(w) / F.sqrt(F.greatest(n - 1, F.lit(1))))


#: fn(column, window) by name.
AGGREGATES: dict[str, Callable[[Column, WindowSpec], Column]] = {
    "mean": lambda x, w: F.avg(x).over(w),
    "sum": lambda x, w: F.sum(x).over(w),
    "min": lambda x, w: F.min(x).over(w),
    "max": lambda x, w: F.max(x).over(w),
    "std": lambda x, w: F.stddev_samp(x).over(w),
    "var": lambda x, w: F.var_samp(x).over(w),
    "median": lambda x, w: F.percentile(x, 0.5).over(w),
    "skew": _unbiased_skew,
    "kurt": _unbiased_kurtosis,
    "sem": _sem,
}


def aggregate(fn, x: Column, w: WindowSpec) -> Column:
    """fn by name, or a callable of (column, window)."""
    return (AGGREGATES[fn] if isinstance(fn, str) else fn)(x, w)


def covariance(a: Column, b: Column, w: WindowSpec) -> Column:
    return F.covar_samp(a, b).over(w)


def correlation(a: Column, b: Column, w: WindowSpec) -> Column:
    """Pearson's, over rows where both are known; null where either doesn't vary."""
    known = a.isNotNull() & b.isNotNull()
    a, b = F.when(known, a), F.when(known, b)
    spread = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
    return F.covar_pop(a, b).over(w) / F.nullif(spread, F.lit(0.0))


def forward(fn, x: Column, w: WindowSpec, period: int, shift: int = 0) -> Column:
    """fn over the next period rows after shift more; null unless all of them exist."""
    frame = w.rowsBetween(1 + shift, period + shift)
    return F.when(F.count(F.lit(1)).over(frame) == period, aggregate(fn, x, frame))


def last_known(x: Column, w: WindowSpec) -> Column:
    """The last value that isn't null, up to this row."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(w_start(), 0))


def w_start() -> int:
    from pyspark.sql import Window

    return Window.unboundedPreceding


def absolute_max_weight(x: Column, w: WindowSpec, rows: int | None) -> Column:
    """|x| by the greatest |x| of the last rows, or of all so far."""
    frame = w.rowsBetween(w_start() if rows is None else 1 - rows, 0)
    return F.abs(x) / F.nullif(F.max(F.abs(x)).over(frame), F.lit(0.0))
