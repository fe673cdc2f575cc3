"""Fraud risk: scored transactions, repeated amounts, employee risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.functions.numbers import ratio
from brigade.operators.anomaly import KEY, amount_stats, with_method_share, with_profile
from brigade.operators.efficiency import first_per_employee
from brigade.operators.spread import attach


def factor_list(flags: dict[str, Column]) -> Column:
    """Names of the flags that are true, in the given order."""
    return F.filter(
        F.array(*[F.when(test, F.lit(name)) for name, test in flags.items()]), lambda x: x.isNotNull()
    )


def risk_transactions(
    sales: DataFrame, z_above: float = 3.0, discount_above: float = 25.0,
    rare_below: float = 0.05, high_from: int = 3,
) -> DataFrame:
    """Sales with at least one risk factor."""
    df = with_method_share(with_profile(sales), sales)
    factors = factor_list(
        {
            "high_value": F.col("z_score") > z_above,
            "unusual_time": F.col("off_hours_with_night"),
            "high_discount": F.col("discount_percent") > discount_above,
            "rare_payment": F.col("method_share") < rare_below,
        }
    )
    scored = df.withColumn("risk_factors", factors).withColumn("risk_score", F.size("risk_factors"))
    return scored.where(F.col("risk_score") >= 1).select(
        *KEY, "sale_id", "employee_id", F.col("total_amount").alias("amount"), "date", "hour",
        "risk_score", "risk_factors",
        F.when(F.col("risk_score") >= high_from, "high").otherwise("medium").alias("severity"),
    )


def repeated_amounts(
    sales: DataFrame, amount_above: int = 3, employee_above: int = 2,
    min_sales: int = 10, medium_above: int = 5,
) -> DataFrame:
    """Amounts seen often in a location and more than twice by one employee: one row per pair."""
    pairs = sales.where(F.col("total_amount").isNotNull() & F.col("employee_id").isNotNull()).groupBy(
        *KEY, "total_amount", "employee_id").agg(F.count(F.lit(1)).alias("occurrence_count"))
    all_rows = sales.where(F.col("total_amount").isNotNull())
    amounts = all_rows.groupBy(*KEY, "total_amount").agg(F.count(F.lit(1)).alias("amount_count"))
    sizes = sales.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_sales")).where(F.col("_sales") > min_sales)
    often = amounts.where(F.col("amount_count") > amount_above).join(sizes, KEY)
    hit = pairs.where(F.col("occurrence_count") > employee_above).join(often, [*KEY, "total_amount"])
    return hit.select(
        *KEY, F.lit("repeated_amount").alias("pattern_type"), F.col("total_amount").alias("amount"),
        "employee_id", "occurrence_count",
        F.when(F.col("occurrence_count") > medium_above, "medium").otherwise("low").alias("severity"),
    )


def repeated_amount_sales(sales: DataFrame, **thresholds) -> DataFrame:
    """The sales behind each repeated amount, one row per sale: the list may be of any length."""
    hit = repeated_amounts(sales, **thresholds).select(
        *KEY, F.col("amount").alias("total_amount"), "employee_id", "occurrence_count"
    )
    keys = [*KEY, "total_amount", "employee_id"]
    return attach(sales, hit, keys, "inner", weight="occurrence_count").select(
        *KEY, "employee_id", F.col("total_amount").alias("amount"), "sale_id"
    )


def employee_risk(
    sales: DataFrame, labor: DataFrame | None = None, min_sales: int = 5,
    discounted_above: float = 50.0, off_hours_above: float = 20.0,
) -> DataFrame:
    """Employees with at least one risk factor, with the first matching directory row."""
    flagged = with_profile(sales).where(F.col("employee_id").isNotNull())
    amount = F.col("total_amount").cast("decimal(18,2)")
    per = flagged.groupBy(*KEY, "employee_id").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        ratio(F.sum(amount), F.count(amount)).alias("average_amount"),
        (ratio(F.count_if(F.col("discount_percent") > 0), F.count(F.lit(1))) * 100).alias("_discounted"),
        (ratio(F.count_if("off_hours_with_night"), F.count(F.lit(1))) * 100).alias("_off"),
    ).where(F.col("transaction_count") >= min_sales)
    stats = amount_stats(sales, *KEY).select(*KEY, "mean_amount", "std_amount")
    joined = per.join(stats, KEY)
    factors = factor_list(
        {
            "high_average_amount": F.col("average_amount") > F.col("mean_amount") + F.col("std_amount"),
            "high_discount_frequency": F.col("_discounted") > discounted_above,
            "unusual_hours": F.col("_off") > off_hours_above,
        }
    )
    scored = joined.withColumn("risk_factors", factors).withColumn("risk_score", F.size("risk_factors"))
    scored = scored.where(F.col("risk_score") > 0)
    if labor is not None:
        scored = scored.join(first_per_employee(labor, "name", "role"), [*KEY, "employee_id"], "left")
    else:
        scored = scored.withColumn("name", F.lit(None).cast("string")).withColumn(
            "role", F.lit(None).cast("string"))
    severity = F.when(F.col("risk_score") >= 3, "high").when(F.col("risk_score") == 2, "medium").otherwise("low")
    return scored.select(
        *KEY, "employee_id", "name", "role", "risk_score", "risk_factors", "transaction_count",
        "average_amount", severity.alias("severity"),
    )
