"""Arithmetic that keeps pandas' infinities and survives ANSI mode, and parts of dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def log(x: Column, base: str = "e") -> Column:
    """Logarithm by base "e", "10" or "2": -infinity at 0, null under it."""
    fn = {"e": F.log, "10": F.log10, "2": F.log2}[str(base)]
    return F.when(x > 0, fn(x)).when(x == 0, F.lit(-INFINITY))


def exponential(x: Column, base: str = "e") -> Column:
    return F.exp(x) if str(base) == "e" else F.pow(F.lit(float(base)), x)


def ratio(a: Column, b: Column, undefined: float | None = None) -> Column:
    """a / b with signed infinity where b is 0 and a isn't, and undefined where both are."""
    signed = F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when((b == 0) & (a > 0), F.lit(INFINITY)).when((b == 0) & (a < 0), F.lit(-INFINITY))
    return signed if undefined is None else signed.when((a == 0) & (b == 0), F.lit(undefined))


def rounded(x: Column, digits: int) -> Column:
    """Rounded as SQL engines in C do, by the power of ten times x: Spark's round takes x's shortest decimal form, and a quotient just under a tie may differ."""
    power = float(10**digits)
    return F.round(x * power) / power


def fill_na_inf(x: Column) -> Column:
    """0.0 for null, NaN and infinities."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == INFINITY), F.lit(0.0)).otherwise(x)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


#: Parts of a timestamp, Monday being day 0 and weeks ISO ones.
DATE_PARTS = {
    "second": F.second, "minute": F.minute, "hour": F.hour, "day_of_week": F.weekday, "day_of_month": F.dayofmonth, "day_of_year": F.dayofyear,
    "week": F.weekofyear, "week_of_year": F.weekofyear, "month": F.month, "quarter": F.quarter, "year": F.year,
}


def weekend(ts: Column) -> Column:
    return F.when(F.weekday(ts) > 4, 1).otherwise(0)
