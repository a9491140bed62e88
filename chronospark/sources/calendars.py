"""Public holidays and closed days of exchanges, by rule: (code, day, holiday), a few rows a year.

A table of one's own in this form serves for other countries and exchanges.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONDAY, WEDNESDAY, THURSDAY = 0, 2, 3
_DAY = datetime.timedelta(days=1)


def easter(year: int):
    """Easter Sunday of a Gregorian year, by the anonymous algorithm."""
    a, b, d = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (d // 4) - h - d % 4) % 7
    m = h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114
    return datetime.date(year, m // 31, m % 31 + 1)


def nth(year: int, month: int, weekday: int, n: int) -> datetime.date:
    """The n-th of a weekday in a month; the last for -1."""
    if n > 0:
        first = datetime.date(year, month, 1)
        return first + ((weekday - first.weekday()) % 7 + 7 * (n - 1)) * _DAY
    last = datetime.date(year + month // 12, month % 12 + 1, 1) - _DAY
    return last - (last.weekday() - weekday) % 7 * _DAY


def observed(days: list[tuple[datetime.date, str]], early: bool = True) -> list[tuple[datetime.date, str]]:
    """Also the Monday after a Sunday, and the Friday before a Saturday if early."""
    moved = [(d + _DAY, f"{name} (observed)") for d, name in days if d.weekday() == 6]
    return days + moved + [(d - _DAY, f"{name} (observed)") for d, name in days if early and d.weekday() == 5]


def us(y: int) -> list[tuple[datetime.date, str]]:
    fixed = [(datetime.date(y, 1, 1), "New Year's Day"), (datetime.date(y, 7, 4), "Independence Day"), (datetime.date(y, 11, 11), "Veterans Day"), (datetime.date(y, 12, 25), "Christmas Day")]
    fixed += [(datetime.date(y, 6, 19), "Juneteenth National Independence Day")] if y >= 2021 else []
    floating = [(2, MONDAY, 3, "Washington's Birthday"), (5, MONDAY, -1, "Memorial Day"), (9, MONDAY, 1, "Labor Day"), (10, MONDAY, 2, "Columbus Day"), (11, THURSDAY, 4, "Thanksgiving Day")]
    floating += [(1, MONDAY, 3, "Martin Luther King Jr. Day")] if y >= 1986 else []
    return observed(fixed) + [(nth(y, m, w, n), name) for m, w, n, name in floating]


def germany(y: int) -> list[tuple[datetime.date, str]]:
    e = easter(y)
    days = [(datetime.date(y, 1, 1), "New Year's Day"), (e - 2 * _DAY, "Good Friday"), (e + _DAY, "Easter Monday"), (datetime.date(y, 5, 1), "Labor Day"), (e + 39 * _DAY, "Ascension Day"), (e + 50 * _DAY, "Whit Monday"), (datetime.date(y, 12, 25), "Christmas Day"), (datetime.date(y, 12, 26), "Second Day of Christmas")]
    days += [(datetime.date(y, 10, 3), "German Unity Day")] if y >= 1990 else []
    days += [(nth(y, 11, WEDNESDAY, 3) if nth(y, 11, WEDNESDAY, 3).day >= 16 else nth(y, 11, WEDNESDAY, 4), "Repentance and Prayer Day")] if 1990 <= y <= 1994 else []
    return days + ([(datetime.date(y, 10, 31), "Reformation Day")] if y == 2017 else [])


#: Days that the United Kingdom had once or moved: {year: {name: (month, day)}}.
GB_MOVED = {1995: {"May Day": (5, 8)}, 2020: {"May Day": (5, 8)}, 2002: {"Spring Bank Holiday": (6, 4)}, 2012: {"Spring Bank Holiday": (6, 4)}, 2022: {"Spring Bank Holiday": (6, 2)}}
GB_ONCE = {1981: [(7, 29, "Royal Wedding")], 1999: [(12, 31, "Millennium")], 2002: [(6, 3, "Golden Jubilee")], 2011: [(4, 29, "Royal Wedding")], 2012: [(6, 5, "Diamond Jubilee")], 2022: [(6, 3, "Platinum Jubilee"), (9, 19, "State Funeral")], 2023: [(5, 8, "Coronation")]}


def united_kingdom(y: int) -> list[tuple[datetime.date, str]]:
    """Those of England; a fixed day on a weekend is made up for by the next free weekday."""
    e, moved = easter(y), GB_MOVED.get(y, {})
    days = [(e - 2 * _DAY, "Good Friday"), (e + _DAY, "Easter Monday")]
    for name, usual in (("May Day", nth(y, 5, MONDAY, 1)), ("Spring Bank Holiday", nth(y, 5, MONDAY, -1)), ("Late Summer Bank Holiday", nth(y, 8, MONDAY, -1))):
        if name != "May Day" or y >= 1978:
            days.append((datetime.date(y, *moved[name]) if name in moved else usual, name))
    fixed = [(datetime.date(y, 1, 1), "New Year's Day"), (datetime.date(y, 12, 25), "Christmas Day"), (datetime.date(y, 12, 26), "Boxing Day")]
    taken = {d for d, _ in fixed}
    for d, name in fixed:
        days.append((d, name))
        if d.weekday() > 4:
            while d.weekday() > 4 or d in taken:
                d += _DAY
            taken.add(d)
            days.append((d, f"{name} (observed)"))
    return days + [(datetime.date(y, m, d), name) for m, d, name in GB_ONCE.get(y, [])]


#: Days on which the New York Stock Exchange was closed out of turn.
NYSE_ONCE = ["1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09"]


def nyse(y: int) -> list[tuple[datetime.date, str]]:
    fixed = [(datetime.date(y, 7, 4), "Independence Day"), (datetime.date(y, 12, 25), "Christmas Day")]
    fixed += [(datetime.date(y, 6, 19), "Juneteenth National Independence Day")] if y >= 2022 else []
    floating = [(2, MONDAY, 3, "Washington's Birthday"), (5, MONDAY, -1, "Memorial Day"), (9, MONDAY, 1, "Labor Day"), (11, THURSDAY, 4, "Thanksgiving Day")]
    floating += [(1, MONDAY, 3, "Martin Luther King Jr. Day")] if y >= 1998 else []
    once = [(d, "closed") for d in map(datetime.date.fromisoformat, NYSE_ONCE) if d.year == y]
    # no Friday stands in for a New Year's Day on a Saturday
    return observed(fixed) + observed([(datetime.date(y, 1, 1), "New Year's Day")], early=False) + [(nth(y, m, w, n), name) for m, w, n, name in floating] + [(easter(y) - 2 * _DAY, "Good Friday")] + once


def frankfurt(y: int) -> list[tuple[datetime.date, str]]:
    e = easter(y)
    return [(datetime.date(y, 1, 1), "New Year's Day"), (e - 2 * _DAY, "Good Friday"), (e + _DAY, "Easter Monday"), (datetime.date(y, 5, 1), "Labor Day")] + [(datetime.date(y, 12, d), "Christmas" if d < 31 else "New Year's Eve") for d in (24, 25, 26, 31)]


COUNTRIES = {"US": us, "DE": germany, "GB": united_kingdom}
EXCHANGES = {"NYSE": nyse, "LSE": united_kingdom, "XETR": frankfurt}


def _table(spark: SparkSession, rules: dict, codes, years: range) -> DataFrame:
    unknown = set(codes) - set(rules)
    if unknown:
        raise ValueError(f"no rule for {sorted(unknown)}; give a table instead")
    # a day may fall into the year before its own
    rows = {(code, day): name for code in codes for y in range(years.start, years.stop + 1) for day, name in reversed(rules[code](y)) if day.year in years}
    return spark.createDataFrame([(code, day, name) for (code, day), name in sorted(rows.items())], "code string, day date, holiday string")


def holidays(spark: SparkSession, codes, years: range) -> DataFrame:
    """(code, day, holiday) of countries' public holidays."""
    return _table(spark, COUNTRIES, [x.upper() for x in ([codes] if isinstance(codes, str) else codes)], years)


def exchange_codes(codes) -> list[str]:
    """The codes, or those of all exchanges for "all"."""
    codes = [codes] if isinstance(codes, str) else list(codes)
    return list(EXCHANGES) if "all" in codes else codes


def closed_days(spark: SparkSession, codes, years: range) -> DataFrame:
    """(code, day, holiday) of all days without a session, weekends among them."""
    codes = exchange_codes(codes)
    days = spark.range(1).select(F.explode(F.sequence(F.lit(datetime.date(years.start, 1, 1)), F.lit(datetime.date(years.stop - 1, 12, 31)))).alias("day"))
    weekends = days.where(F.weekday("day") > 4).crossJoin(spark.createDataFrame([(x,) for x in codes], "code string")).select("code", "day", F.lit("weekend").alias("holiday"))
    return _table(spark, EXCHANGES, codes, years).where(F.weekday("day") < 5).union(weekends)


def without_session(sessions: DataFrame, code: str, first: str, last: str) -> DataFrame:
    """(code, day, holiday) of all days from first to last without a session (a column day)."""
    days = sessions.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.join(sessions.select("day").distinct(), "day", "left_anti").select(F.lit(code).alias("code"), "day", F.lit("closed").alias("holiday"))
