"""Likely causes behind anomalies."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.functions.numbers import dbl, ratio
from brigade.operators import substrings
from brigade.operators.anomaly import EMPLOYEE_KIND, KEY, with_employee_z, with_method_share, with_profile
from brigade.operators.efficiency import first_per_employee
from brigade.operators.risk import factor_list
from brigade.operators.spread import attach, settle

# Causes and their advice, and what is said when there is none.
ADVICE = {
    "large_number_of_items": "Review transaction for potential item miscounting or order splitting",
    "high_discount_percentage": "Verify discount authorization and policy compliance",
    "rare_payment_method": "Confirm payment method validity and authorization",
    "high_percentage_unusual_transactions": "Review employee transaction history and provide additional training",
    "unusual_working_hours": "Verify employee schedule and authorization for off-hours work",
    "new_employee": "Provide additional training and supervision for new employee",
    "low_inventory_level": "Restock inventory item and review ordering schedule",
    "high_usage_ingredient": "Increase par level for frequently used ingredient",
}
NO_ADVICE = "No specific recommendations available"
CLUSTER_ADVICE = "Investigate this time period for potential systematic issues"
TRANSACTION_KINDS = ("high_value_transactions", "payment_method_anomalies", "discount_anomalies")


def recommendation(causes: Column) -> Column:
    """Advice for the listed causes, joined with '; '."""
    lookup = F.create_map(*[F.lit(v) for pair in ADVICE.items() for v in pair])
    known = F.filter(F.transform(causes, lambda c: F.try_element_at(lookup, c)), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.array_join(known, "; ")).otherwise(F.lit(NO_ADVICE))


def _advised(df: DataFrame, causes: Column) -> DataFrame:
    return df.withColumn("causes", causes).withColumn("recommendation", recommendation(F.col("causes")))


def transaction_causes(
    anomalies: DataFrame, sales: DataFrame, items_above: int = 10,
    discount_above: float = 25.0, rare_below: float = 0.05,
) -> DataFrame:
    """Causes for each transaction anomaly, from its own sale; anomalies without a sale id have none.

    Where an id occurs twice its first sale counts.
    """
    named = F.col("sale_id").isNotNull() & (F.col("sale_id").cast("string") != "")
    chosen = anomalies.where(F.col("category").isin(*TRANSACTION_KINDS) & named).select(*KEY, "sale_id", "category")
    own = sales.join(chosen.select(*KEY, "sale_id").distinct(), [*KEY, "sale_id"], "left_semi")
    detail = with_method_share(own, sales).groupBy(*KEY, "sale_id").agg(
        F.min_by(
            F.struct(
                F.coalesce(F.size(F.split("items_sold", ";")), F.lit(0)).alias("_items"),
                "discount_percent", "method_share",
            ),
            F.struct("date", "hour", "total_amount"),
        ).alias("_s")
    )
    joined = chosen.join(detail.select(*KEY, "sale_id", "_s.*"), [*KEY, "sale_id"])
    return _advised(
        joined,
        factor_list(
            {
                "large_number_of_items": F.col("_items") > items_above,
                "high_discount_percentage": F.col("discount_percent") > discount_above,
                "rare_payment_method": F.col("method_share") < rare_below,
            }
        ),
    ).select(*KEY, "sale_id", F.col("category").alias("anomaly_type"), "causes", "recommendation")


def employee_profile(sales: DataFrame, z_above: float = 3.0) -> DataFrame:
    """Per employee: share of own sales far from the own mean and share outside business hours."""
    df = with_employee_z(with_profile(sales), sales).where(F.col("employee_id").isNotNull())
    return df.groupBy(*KEY, "employee_id").agg(
        F.count(F.lit(1)).alias("sales"),
        ratio(F.count_if(F.abs("employee_z") > z_above), F.count(F.lit(1))).alias("unusual_share"),
        ratio(F.count_if("off_hours"), F.count(F.lit(1))).alias("off_hours_share"),
    )


def employee_causes(
    anomalies: DataFrame, sales: DataFrame, labor: DataFrame, as_of: dt.date,
    share_above: float = 0.2, new_days: int = 30,
) -> DataFrame:
    """Causes per employee with pattern anomalies; one row per employee."""
    hit = anomalies.where(F.col("category") == EMPLOYEE_KIND).groupBy(*KEY, "employee_id").agg(
        F.count(F.lit(1)).alias("anomalies")
    )
    directory = first_per_employee(labor, "name", "role", "hire_date")
    joined = hit.join(employee_profile(sales), [*KEY, "employee_id"]).join(
        directory, [*KEY, "employee_id"], "left"
    )
    return _advised(
        joined,
        factor_list(
            {
                "high_percentage_unusual_transactions": F.col("unusual_share") > share_above,
                "unusual_working_hours": F.col("off_hours_share") > share_above,
                "new_employee": F.datediff(F.lit(as_of), F.col("hire_date")) < new_days,
            }
        ),
    ).select(*KEY, "employee_id", "name", "role", "anomalies", "causes", "recommendation")


def ingredient_sale_share(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Share of a location's sales whose item text names the ingredient.

    Item names are matched once as distinct texts; a sale counts once per ingredient.
    """
    pieces = sales.select(*KEY, "sale_id", F.explode(F.array_distinct(F.split("items_sold", ";"))).alias("item"))
    stocked = inventory.select(*KEY, "ingredient").distinct()
    names = settle(pieces.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "names")
    pairs = substrings.pairs(names, "item", stocked, "ingredient").join(names, "item")
    # one item may be in a third of all sales
    named = attach(pieces, pairs, ["item"], "inner", weight="n").select(*KEY, "ingredient", "sale_id")
    counts = named.groupBy(*KEY, "ingredient").agg(F.count_distinct("sale_id").alias("sales_with"))
    counts = counts.join(stocked, [*KEY, "ingredient"], "left_semi")
    totals = sales.groupBy(*KEY).agg(F.count(F.lit(1)).alias("sales"))
    return counts.join(totals, KEY).select(
        *KEY, "ingredient", "sales_with", ratio("sales_with", "sales").alias("sale_share")
    )


def inventory_causes(
    sales: DataFrame, inventory: DataFrame, ratio_below: float = 0.75, share_above: float = 0.1
) -> DataFrame:
    """Ingredients far under par, and whether many sales use them."""
    r = F.try_divide(dbl("quantity"), dbl("par_level"))
    low = inventory.withColumn("inventory_ratio", r).where(F.col("inventory_ratio") < ratio_below)
    shares = ingredient_sale_share(sales, low).select(*KEY, "ingredient", "sale_share")
    joined = low.join(shares, [*KEY, "ingredient"], "left")
    return _advised(
        joined,
        factor_list(
            {
                "low_inventory_level": F.lit(True),
                "high_usage_ingredient": F.col("sale_share") > share_above,
            }
        ),
    ).select(*KEY, "ingredient", "quantity", "par_level", "inventory_ratio", "causes", "recommendation")


def anomalous_sales(anomalies: DataFrame, sales: DataFrame) -> DataFrame:
    return sales.join(anomalies.select(*KEY, "sale_id").distinct(), [*KEY, "sale_id"], "left_semi")


def _mode(df: DataFrame, c: str, prefix: str) -> DataFrame:
    """Most frequent value per slot when it occurs more than once; ties go to the smallest value."""
    slot = [*KEY, "date", "hour"]
    counts = df.where(F.col(c).isNotNull()).groupBy(*slot, c).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*slot).agg(F.max("n").alias("n"), F.min_by(c, F.struct(-F.col("n"), c)).alias("_v"))
    return best.where(F.col("n") > 1).select(*slot, F.concat(F.lit(prefix), F.col("_v").cast("string")).alias(prefix))


def time_clusters(anomalies: DataFrame, sales: DataFrame, above: int = 2) -> DataFrame:
    """Hours of a day with several anomalous sales, and what those sales share."""
    slot = [*KEY, "date", "hour"]
    hit = anomalous_sales(anomalies, sales).dropna(subset=["date", "hour"])
    counts = hit.groupBy(*slot).agg(F.count(F.lit(1)).alias("anomaly_count")).where(F.col("anomaly_count") > above)
    both = counts.join(_mode(hit, "employee_id", "same_employee_"), slot, "left").join(
        _mode(hit, "payment_method", "same_payment_method_"), slot, "left"
    )
    factors = F.filter(F.array("same_employee_", "same_payment_method_"), lambda x: x.isNotNull())
    return both.select(
        *slot, "anomaly_count", factors.alias("common_factors"), F.lit(CLUSTER_ADVICE).alias("recommendation")
    )


def cluster_sales(anomalies: DataFrame, sales: DataFrame, above: int = 2) -> DataFrame:
    """The sales of each cluster, one row per sale."""
    slot = [*KEY, "date", "hour"]
    hit = anomalous_sales(anomalies, sales).dropna(subset=["date", "hour"])
    counts = hit.groupBy(*slot).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > above)
    return attach(hit, counts, slot, "inner", weight="n").select(*slot, "sale_id")


def cause_frequency(*causes: DataFrame) -> DataFrame:
    """How often each cause was found."""
    out = None
    for df in causes:
        part = df.select(*KEY, F.explode("causes").alias("cause"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*KEY, "cause").agg(F.count(F.lit(1)).alias("frequency"))
