"""Money, ratios and safe coercions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(18,2)"


def money(c: Column | str) -> Column:
    """Stored money."""
    return F.col(c).cast(MONEY) if isinstance(c, str) else c.cast(MONEY)


def dbl(c: Column | str) -> Column:
    return F.col(c).cast("double") if isinstance(c, str) else c.cast("double")


def ratio(n: Column | str, d: Column | str, default: float | None = None) -> Column:
    """Safe division as double; null or the default when the divisor is zero."""
    q = F.try_divide(dbl(n), dbl(d))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def to_cents(c: Column) -> Column:
    """Two places, half up on the decimal value: a double's last bits do not decide a tie."""
    return dbl(F.round(c.cast("decimal(28,6)"), 2))


def number_or_zero(c: Column | str, kind: str = MONEY) -> Column:
    """Text to number; what is no number counts as zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c).try_cast(kind), F.lit(0).cast(kind))


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def rounded(df: DataFrame, places: int = 2) -> DataFrame:
    """All fractional columns rounded."""
    keep = (T.DoubleType, T.FloatType, T.DecimalType)
    return df.select(
        *[
            F.round(f.name, places).alias(f.name) if isinstance(f.dataType, keep) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
