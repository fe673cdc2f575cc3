"""Exact medians per group by distributed selection: counts in value ranges, narrowed until the middle fits into a task.

A group of up to ``fit`` values is sorted as it is. A larger one is counted in RANGES equal ranges between its smallest and largest
value; only the range that holds the middle is looked at again, between the values that really occur in it. Nothing is
shuffled but counts, and in the end the few values of the last range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brigade.operators.spread import attach, settle

FIT = 100_000
RANGES = 1024


def medians(df: DataFrame, group: Sequence[str], values: Sequence[str], fit: int = FIT) -> DataFrame:
    """One row per group with ``median_<value>`` of each value, as double; nulls do not count.

    The groups' keys may be null. A group without any value has a null median.
    """
    out = None
    group = list(group)
    # as a struct a group equals itself even where a key is null
    keyed = df.select(F.struct(*group).alias("_g"), *[F.col(v).cast("double").alias(v) for v in values])
    for v in values:
        found = _median(keyed.select("_g", F.col(v).alias("_v")), fit).withColumnRenamed("_median", f"median_{v}")
        out = found if out is None else out.join(found, "_g")
    return out.select("_g.*", *[f"median_{v}" for v in values])


def _middle(n: Column) -> tuple[Column, Column]:
    """First and last rank of the middle of n values."""
    return F.floor((n + 1) / 2), F.ceil((n + 1) / 2)


def _median(rows: DataFrame, fit: int) -> DataFrame:
    v = F.col("_v")
    # the open groups: values, how many lie below the range and within it, and the range
    state = settle(rows.groupBy("_g").agg(
        F.count(v).alias("n"), F.lit(0).cast("long").alias("below"), F.count(v).alias("inside"), F.min(v).alias("low"), F.max(v).alias("high")), "ranges")
    done = state.where(F.col("low").eqNullSafe(F.col("high"))).select("_g", F.col("low").alias("_median"))
    state = state.where(F.col("low") < F.col("high"))
    while True:
        wide = state.where(F.col("inside") > fit)
        if wide.isEmpty():
            break
        narrow, told = _narrowed(rows, wide)
        done = done.unionByName(told)
        state = settle(state.where(F.col("inside") <= fit).unionByName(narrow), "ranges")
        done = done.unionByName(state.where(F.col("low") == F.col("high")).select("_g", F.col("low").alias("_median")))
        state = state.where(F.col("low") < F.col("high"))
    within = attach(rows, state, ["_g"], "inner", weight="inside").where(v.between(F.col("low"), F.col("high")))
    place = F.row_number().over(Window.partitionBy("_g").orderBy("_v")) + F.col("below")  # at most fit rows of a group
    first, last = _middle(F.col("n"))
    ranked = within.withColumn("_place", place).where(F.col("_place").between(first, last))
    return done.unionByName(ranked.groupBy("_g").agg(F.avg("_v").alias("_median")))


def _narrowed(rows: DataFrame, wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ranges that hold the middle, and the medians that lie between two ranges."""
    v = F.col("_v")
    inside = attach(rows, wide, ["_g"], "inner", weight="inside").where(v.between(F.col("low"), F.col("high")))
    place = F.least(F.lit(RANGES - 1), F.floor((v - F.col("low")) / (F.col("high") - F.col("low")) * RANGES)).cast("int")
    counts = inside.groupBy("_g", place.alias("_r")).agg(
        F.first("n").alias("n"), F.first("below").alias("below"), F.count(F.lit(1)).alias("inside"), F.min(v).alias("low"), F.max(v).alias("high"))
    # at most RANGES rows of a group
    order = Window.partitionBy("_g").orderBy("_r")
    upto = F.sum("inside").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.withColumn("below", F.col("below") + F.coalesce(upto, F.lit(0)))
    first, last = _middle(F.col("n"))
    end = F.col("below") + F.col("inside")
    held = settle(placed.where((end >= first) & (F.col("below") < last)).withColumn("_both", (F.col("below") < first) & (end >= last)), "held")
    # the middle pair parted by a border: the last value before it and the first behind it
    between = held.where("NOT _both").groupBy("_g").agg(((F.min("high") + F.max("low")) / 2).alias("_median"))
    return held.where("_both").select("_g", "n", "below", "inside", "low", "high"), between
