"""Date filters. Every one takes its reference day; nothing reads the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Named trailing periods in days, first day of "all", and the short range of a chat answer.
PERIOD_DAYS = {"Last_week": 7, "Last_15_days": 15, "Last_month": 30, "Last_6_months": 180, "Last_year": 365}
FIRST_DAY = dt.date(2000, 1, 1)
SHORT_RANGE_DAYS = 20


def period_bounds(period: str, as_of: dt.date) -> tuple[dt.date, dt.date]:
    if period in PERIOD_DAYS:
        return as_of - dt.timedelta(days=PERIOD_DAYS[period]), as_of
    return FIRST_DAY, as_of


def in_period(df: DataFrame, period: str, as_of: dt.date, col: str = "date") -> DataFrame:
    start, end = period_bounds(period, as_of)
    return df.where(F.col(col).between(F.lit(start), F.lit(end)))


def last_days_of_data(df: DataFrame, days: int = 7, col: str = "date") -> DataFrame:
    """The last days ending at each location's own newest date."""
    from brigade.operators.spread import attach

    newest = df.groupBy("location_id").agg(F.max(col).alias("_newest"), F.count(F.lit(1)).alias("_n"))
    near = attach(df, newest, ["location_id"], "inner", weight="_n")
    return near.where(F.col(col) > F.date_sub("_newest", days)).drop("_newest", "_n")


def from_cutoff_or_all(df: DataFrame, cutoff: dt.date, col: str = "date") -> DataFrame:
    """Each location's rows from the cut-off on, or all its rows when none is that new."""
    from brigade.operators.spread import attach

    newest = df.groupBy("location_id").agg(F.max(col).alias("_newest"), F.count(F.lit(1)).alias("_n"))
    near = attach(df, newest, ["location_id"], "left", weight="_n")
    old = F.coalesce(F.col("_newest") < F.lit(cutoff), F.lit(True))
    return near.where(old | (F.col(col) >= F.lit(cutoff))).drop("_newest", "_n")


def clamped_range(a: dt.date, b: dt.date, days: int | None = None) -> tuple[dt.date, dt.date]:
    """The range in order; cut to ``days`` only when asked to (SHORT_RANGE_DAYS for a chat answer)."""
    start, end = min(a, b), max(a, b)
    return start, end if days is None else min(end, start + dt.timedelta(days=days))


def checked_range(a: dt.date, b: dt.date, days: int | None = None) -> tuple[dt.date, dt.date]:
    """The range, refused when it runs backwards or, if asked, is longer than ``days``."""
    if b < a:
        raise ValueError("the range ends before it starts")
    if days is not None and (b - a).days > days:
        raise ValueError(f"the range exceeds {days} days")
    return a, b


def between(df: DataFrame, bounds: tuple[dt.date, dt.date], col: str = "date") -> DataFrame:
    return df.where(F.col(col).between(F.lit(bounds[0]), F.lit(bounds[1])))


def on_day(df: DataFrame, day: dt.date, col: str = "date") -> DataFrame:
    return df.where(F.col(col) == F.lit(day))


def weekend(col: str) -> Column:
    return F.dayofweek(col).isin(1, 7)
