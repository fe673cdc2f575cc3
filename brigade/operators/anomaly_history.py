"""Group figures of sales that can be stored in parts and merged, and sales judged by them.

A part holds what one batch of sales adds: for each location and each employee the number of sales, the count and sum of their amounts
and the sum of squared distances from their mean, and the sales per hour, per payment method and per repeated amount. Merged,
the parts give the figures that all sales together have, so a day's upload is judged against the whole history without
reading it. Sums of amounts are decimals; distances are merged around the common mean, not as differences of large squares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.functions.numbers import dbl, ratio
from brigade.operators import anomaly
from brigade.operators.spread import attach

KEY = anomaly.KEY
# The keys of each kind of figures.
KINDS = {
    "location": KEY, "employee": [*KEY, "employee_id"], "hour": [*KEY, "hour"], "method": [*KEY, "payment_method"],
    "repeat": [*KEY, "employee_id", "total_amount"],
}
MOMENTS = ("location", "employee")
COUNTS = {"hour": "cnt", "method": "n", "repeat": "repeats"}


def moments(sales: DataFrame, keys: list[str]) -> DataFrame:
    x = F.col("total_amount")
    return sales.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count("hour").alias("timed"), F.count(x).alias("amounts"), F.sum(x.cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"),
        (F.var_pop(dbl(x)) * F.count(x)).alias("m2"))


def figures(sales: DataFrame) -> dict[str, DataFrame]:
    """One part: the figures of some sales, by kind."""
    return {
        "location": moments(sales, KINDS["location"]), "employee": moments(sales.where(F.col("employee_id").isNotNull()), KINDS["employee"]),
        "hour": anomaly.hour_counts(sales), "method": anomaly.method_counts(sales), "repeat": anomaly.repeat_counts(sales),
    }


def merge(kind: str, parts: DataFrame) -> DataFrame:
    """One row for each key, from the rows of any number of parts.

    A group holds as many rows as there are parts, so parts are merged and stored again from time to time.
    """
    keys = KINDS[kind]
    if kind in COUNTS:
        return parts.groupBy(*keys).agg(F.sum(COUNTS[kind]).alias(COUNTS[kind]))
    sums = parts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n", "timed", "amounts")], F.sum("total").cast("decimal(38,2)").alias("total"),
        F.collect_list(F.when(F.col("amounts") > 0, F.struct(dbl("amounts").alias("k"), ratio("total", "amounts").alias("mean"), "m2"))).alias("_parts"))
    mean = F.array(ratio("total", "amounts"))  # computed once for all parts
    spread = F.transform(mean, lambda m: F.aggregate(
        "_parts", F.lit(0.0), lambda a, p: a + p["m2"] + p["k"] * (p["mean"] - m) * (p["mean"] - m)))[0]
    return sums.withColumn("m2", F.when(F.col("amounts") > 0, spread)).drop("_parts")


def amount_stats(moments: DataFrame) -> DataFrame:
    """The columns of ``anomaly.amount_stats`` from merged moments."""
    std: Column = F.sqrt(F.col("m2") / (F.col("amounts") - 1))
    return moments.withColumn("mean_amount", ratio("total", "amounts")).withColumn(
        "std_amount", F.when(F.col("amounts") > 1, std)).drop("amounts", "total", "m2")


def baseline(moments: DataFrame, as_of) -> DataFrame:
    """``anomaly.baseline`` from the history of locations."""
    return amount_stats(moments).select(*KEY, "mean_amount", "std_amount", F.lit(as_of).cast("date").alias("as_of"))


def judged(
    sales: DataFrame, known: dict[str, DataFrame], high_value_threshold: float = 12.0, repeated_at_least: int = 10, quantile: float = 0.25,
) -> DataFrame:
    """The rows that ``anomaly.all_anomalies`` gives for these sales among all sales that the merged figures stand for."""
    profile = anomaly.profile_of(amount_stats(known["location"]), known["hour"], quantile)
    df = anomaly.against_profile(sales, profile)
    df = attach(df, anomaly.shares_of(known["method"]), [*KEY, "payment_method"], weight="n").drop("n")
    df = anomaly.against_employees(df, amount_stats(known["employee"]).drop("timed"))
    often = known["repeat"].where(F.col("repeats") >= repeated_at_least)
    return anomaly.found_in(attach(df, often, KINDS["repeat"], weight="repeats"), high_value_threshold)
