"""Sales anomalies: unusual amounts, hours, employees, payments and discounts.

Per-location figures are aggregated first and joined back, so a location with a third of all sales
is never one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.functions.numbers import dbl, ratio
from brigade.operators.spread import attach

KEY = ["location_id"]

# Hours that never count as business hours, payment methods always suspect.
NIGHT_HOURS = (0, 1, 2, 3, 4, 5, 23)
EMPLOYEE_KIND = "employee_pattern_anomalies"
REPEATED, OUTLIER = "repeated_identical_transactions", "unusual_transaction"
SUSPECT_METHODS = ("Bitcoin", "Cryptocurrency", "Gift Card", "Wire Transfer")


def amount_stats(sales: DataFrame, *by: str, more: Sequence[Column] = ()) -> DataFrame:
    """Mean and sample spread of the amounts; n counts rows, for fan-out of hot keys."""
    x = F.col("total_amount")
    return sales.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.sum(x.cast("decimal(18,2)")), F.count(x)).alias("mean_amount"),
        F.stddev_samp(dbl(x)).alias("std_amount"),
        *more,
    )


def with_z(sales: DataFrame, *by: str) -> DataFrame:
    """z-score of each amount against its group; null where the group has no spread."""
    return attach(sales, amount_stats(sales, *by), by, weight="n").withColumn("z_score", _z("mean_amount", "std_amount"))


def business_hours(sales: DataFrame, quantile: float = 0.25, drop_night: bool = True) -> DataFrame:
    """Hours per location whose sales count exceeds the quantile over its hours (at most 24 rows each)."""
    return busy_of(hour_counts(sales), quantile, drop_night)


def hour_counts(sales: DataFrame) -> DataFrame:
    return sales.where(F.col("hour").isNotNull()).groupBy(*KEY, "hour").agg(F.count(F.lit(1)).alias("cnt"))


def busy_of(counts: DataFrame, quantile: float = 0.25, drop_night: bool = True) -> DataFrame:
    """The business hours, from sales per location and hour."""
    cut = counts.groupBy(*KEY).agg(F.percentile("cnt", F.lit(quantile)).alias("cut"))
    busy = counts.join(cut, KEY).where(F.col("cnt") > F.col("cut"))
    if drop_night:
        busy = busy.where(~F.col("hour").isin(*NIGHT_HOURS))
    return busy.select(*KEY, "hour", "cnt")


def location_profile(sales: DataFrame, quantile: float = 0.25) -> DataFrame:
    """One row per location: amounts' mean and spread, and its busy hours (at most 24)."""
    stats = amount_stats(sales, *KEY, more=[F.count("hour").alias("timed")])
    return profile_of(stats, hour_counts(sales), quantile)


def profile_of(stats: DataFrame, hours: DataFrame, quantile: float = 0.25) -> DataFrame:
    """The profile from a location's amounts and its sales per hour."""
    busy = busy_of(hours, quantile, drop_night=False).groupBy(*KEY).agg(F.collect_set("hour").alias("busy_hours"))
    return stats.join(busy, KEY, "left")


def _off(drop_night: bool) -> Column:
    """Is the hour no business hour? A null hour is unusual; a location without any hour gives no flag."""
    inside = F.coalesce(F.array_contains("busy_hours", F.col("hour")), F.lit(False))
    if drop_night:
        inside = inside & ~F.col("hour").isin(*NIGHT_HOURS)
    return F.when(F.col("timed") > 0, ~inside).otherwise(F.lit(False))


def _z(mean: str, std: str) -> Column:
    return (dbl("total_amount") - F.col(mean)) / F.when(F.col(std) > 0, F.col(std))


PROFILE = ("n", "mean_amount", "std_amount", "timed", "busy_hours")


# Each with_* takes the rows to extend and, where those carry joins already, the plain sales to
# take the group figures from.


def with_profile(df: DataFrame, base: DataFrame | None = None, quantile: float = 0.25) -> DataFrame:
    """Location z-score and the two off-hours flags, from one attach."""
    return against_profile(df, location_profile(df if base is None else base, quantile))


def against_profile(df: DataFrame, profile: DataFrame) -> DataFrame:
    return (
        attach(df, profile, KEY, weight="n")
        .withColumn("z_score", _z("mean_amount", "std_amount"))
        .withColumn("off_hours", _off(True))
        .withColumn("off_hours_with_night", _off(False))
        .drop(*PROFILE)
    )


def method_shares(sales: DataFrame) -> DataFrame:
    """Share of each payment method in its location; sales without a method do not count."""
    return shares_of(method_counts(sales))


def method_counts(sales: DataFrame) -> DataFrame:
    return sales.where(F.col("payment_method").isNotNull()).groupBy(*KEY, "payment_method").agg(F.count(F.lit(1)).alias("n"))


def shares_of(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy(*KEY).agg(F.sum("n").alias("_total"))
    return counts.join(totals, KEY).select(
        *KEY, "payment_method", "n", ratio("n", "_total").alias("method_share")
    )


def with_method_share(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    shares = method_shares(df if base is None else base)
    return attach(df, shares, [*KEY, "payment_method"], weight="n").drop("n")


def with_employee_z(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Number of sales and z-score within the employee's own sales."""
    known = (df if base is None else base).where(F.col("employee_id").isNotNull())
    return against_employees(df, amount_stats(known, *KEY, "employee_id"))


def against_employees(df: DataFrame, stats: DataFrame) -> DataFrame:
    keys = [*KEY, "employee_id"]
    return (
        attach(df, stats, keys, weight="n")
        .withColumn("employee_z", _z("mean_amount", "std_amount"))
        .withColumnRenamed("n", "employee_sales")
        .drop("mean_amount", "std_amount")
    )


def with_repeats(df: DataFrame, base: DataFrame | None = None, at_least: int = 10) -> DataFrame:
    """How often the employee booked this very amount, where that is often; else null."""
    counts = repeat_counts(df if base is None else base)
    return attach(df, counts.where(F.col("repeats") >= at_least), [*KEY, "employee_id", "total_amount"], weight="repeats")


def repeat_counts(sales: DataFrame) -> DataFrame:
    known = sales.where(F.col("employee_id").isNotNull() & F.col("total_amount").isNotNull())
    return known.groupBy(*KEY, "employee_id", "total_amount").agg(F.count(F.lit(1)).alias("repeats"))


class Kind(NamedTuple):
    category: str
    pattern: str | None
    test: Column
    score: Column
    severity: Column


def _kind_high_value(threshold: float = 12.0, high_above: float = 5.0) -> Kind:
    z = F.col("z_score")
    return Kind("high_value_transactions", None, z > threshold, z, F.when(z > high_above, "high").otherwise("medium"))


def _kind_unusual_time() -> Kind:
    return Kind("unusual_time_transactions", None, F.col("off_hours"), F.lit(None), F.lit("medium"))


def _kind_repeated(high_at: int = 5) -> Kind:
    n = F.col("repeats")
    return Kind(EMPLOYEE_KIND, REPEATED, n.isNotNull(), n, F.when(n >= high_at, "high").otherwise("medium"))


def _kind_outlier(threshold: float = 2.0, min_sales: int = 8, high_above: float = 5.0) -> Kind:
    z = F.col("employee_z")
    test = (F.col("employee_sales") >= min_sales) & (F.abs(z) > threshold)
    return Kind(EMPLOYEE_KIND, OUTLIER, test, z, F.when(F.abs(z) > high_above, "high").otherwise("medium"))


def _kind_payment(below: float = 0.10) -> Kind:
    share = F.col("method_share")
    test = (share < below) | F.col("payment_method").isin(*SUSPECT_METHODS)
    return Kind("payment_method_anomalies", None, test, share, F.lit("low"))


def _kind_discount(above: float = 20.0, medium_above: float = 50.0) -> Kind:
    pct = F.col("discount_percent")
    return Kind("discount_anomalies", None, pct > above, pct, F.when(pct > medium_above, "medium").otherwise("low"))


def _rows(df: DataFrame, *kinds: Kind) -> DataFrame:
    """One row per sale and kind that applies, all kinds in one pass over the sales."""
    found = F.array(
        *[
            F.when(
                k.test,
                F.struct(
                    F.lit(k.category).alias("category"),
                    F.lit(k.pattern).cast("string").alias("pattern"),
                    k.score.cast("double").alias("score"),
                    k.severity.alias("severity"),
                ),
            )
            for k in kinds
        ]
    )
    hits = df.select(
        *KEY, "sale_id", "employee_id", F.col("total_amount").alias("amount"), "date", "hour",
        F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_k"),
    )
    return hits.select(
        *KEY, "_k.category", "_k.pattern", "sale_id", "employee_id", "amount", "date", "hour", "_k.score", "_k.severity"
    )


def high_value(sales: DataFrame, threshold: float = 12.0, high_above: float = 5.0) -> DataFrame:
    return _rows(with_profile(sales), _kind_high_value(threshold, high_above))


def unusual_time(sales: DataFrame, quantile: float = 0.25) -> DataFrame:
    return _rows(with_profile(sales, quantile=quantile), _kind_unusual_time())


def repeated_identical(sales: DataFrame, at_least: int = 10, high_at: int = 5) -> DataFrame:
    """Every sale of an (employee, amount) pair seen at least so often."""
    return _rows(with_repeats(sales, at_least=at_least), _kind_repeated(high_at))


def employee_outliers(
    sales: DataFrame, threshold: float = 2.0, min_sales: int = 8, high_above: float = 5.0
) -> DataFrame:
    """Amounts far from the employee's own mean, for employees with enough sales."""
    return _rows(with_employee_z(sales), _kind_outlier(threshold, min_sales, high_above))


def unusual_payment(sales: DataFrame, below: float = 0.10) -> DataFrame:
    return _rows(with_method_share(sales), _kind_payment(below))


def high_discount(sales: DataFrame, above: float = 20.0, medium_above: float = 50.0) -> DataFrame:
    return _rows(sales, _kind_discount(above, medium_above))


def all_anomalies(sales: DataFrame, high_value_threshold: float = 12.0, repeated_at_least: int = 10) -> DataFrame:
    """All kinds in one table, found in a single pass once the group figures are attached."""
    df = with_method_share(with_profile(sales), sales)
    return found_in(with_repeats(with_employee_z(df, sales), sales, repeated_at_least), high_value_threshold)


def found_in(df: DataFrame, high_value_threshold: float = 12.0) -> DataFrame:
    """All kinds among sales that carry their group figures."""
    return _rows(
        df,
        _kind_high_value(high_value_threshold), _kind_unusual_time(), _kind_repeated(),
        _kind_outlier(), _kind_payment(), _kind_discount(),
    )


def baseline(sales: DataFrame, as_of) -> DataFrame:
    """Mean and spread per location, to be appended to a history table."""
    return amount_stats(sales, *KEY).select(
        *KEY, "mean_amount", "std_amount", F.lit(as_of).cast("date").alias("as_of")
    )
