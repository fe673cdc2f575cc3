"""Operational efficiency: velocity, peak hours, staff, turnover and the overall score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.functions.numbers import MONEY, dbl, ratio
from brigade.operators import substrings
from brigade.operators.spread import attach, settle, top_within

KEY = ["location_id"]


def rates(sales: DataFrame, *by: str) -> DataFrame:
    """Transactions, revenue, items and both per transaction; rows without a key do not count."""
    known = sales.dropna(subset=list(by)) if by else sales
    n = F.count("sale_id")
    revenue = F.coalesce(F.sum(F.col("total_amount").cast(MONEY)), F.lit(0))
    items = F.coalesce(F.sum("number_of_items"), F.lit(0)).cast("long")
    return known.groupBy(*KEY, *by).agg(
        n.alias("transaction_count"),
        revenue.alias("revenue"),
        items.alias("items_sold"),
        ratio(items, n).alias("items_per_transaction"),
        ratio(revenue, n).alias("revenue_per_transaction"),
    )


def sales_velocity(sales: DataFrame) -> DataFrame:
    return rates(sales, "date", "hour")


def hour_summary(sales: DataFrame) -> DataFrame:
    return rates(sales, "hour")


def peak_hours(sales: DataFrame, quantile: float = 0.8) -> DataFrame:
    """Peak hours of each location and their share of revenue; at most 24 hours in the list."""
    hours = hour_summary(sales)
    cut = hours.groupBy(*KEY).agg(F.percentile("transaction_count", F.lit(quantile)).alias("cut"))
    peak = F.col("transaction_count") >= F.col("cut")
    return hours.join(cut, KEY).groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.when(peak, F.col("hour")))).alias("peak_hours"),
        (ratio(F.sum(F.when(peak, F.col("revenue"))), F.sum("revenue")) * 100).alias("peak_revenue_pct"),
    )


def first_per_employee(labor: DataFrame, *columns: str) -> DataFrame:
    """One directory row per employee: the first one ingested (or the smallest row)."""
    order = F.col("ingest_seq") if "ingest_seq" in labor.columns else F.struct("date", *columns)
    return labor.groupBy(*KEY, "employee_id").agg(F.min_by(F.struct(*columns), order).alias("_e")).select(
        *KEY, "employee_id", *[F.col(f"_e.{c}").alias(c) for c in columns]
    )


def employee_efficiency(sales: DataFrame, labor: DataFrame | None = None) -> DataFrame:
    per_employee = rates(sales, "employee_id")
    if labor is None:
        return per_employee
    return per_employee.join(first_per_employee(labor, "name", "role"), [*KEY, "employee_id"], "left")


def ingredient_mentions(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """How often an ingredient's name occurs in sold item names, per location.

    Distinct names are matched once; the item counts are joined afterwards.
    """
    piece = F.explode(F.split("items_sold", ";"))
    counts = sales.where(F.col("items_sold").isNotNull()).select(*KEY, piece.alias("item")).groupBy(
        *KEY, "item").agg(F.count(F.lit(1)).alias("n"))
    stocked = inventory.select(*KEY, "ingredient").distinct()
    counts = settle(counts, "item_counts")
    names = counts.groupBy("item").agg(F.count(F.lit(1)).alias("_locations"))
    pairs = substrings.pairs(counts, "item", stocked, "ingredient").join(names, "item")
    matched = attach(counts, pairs, ["item"], "inner", weight="_locations").join(
        stocked, [*KEY, "ingredient"], "left_semi"
    )
    return matched.groupBy(*KEY, "ingredient").agg(F.sum("n").alias("usage_count"))


def ingredient_turnover(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    stock = inventory.groupBy(*KEY, "ingredient").agg(
        ratio(F.sum(F.col("quantity").cast("decimal(14,3)")), F.count("quantity")).alias("average_quantity")
    )
    both = ingredient_mentions(sales, inventory).join(stock, [*KEY, "ingredient"])
    turn = F.when(F.col("average_quantity") > 0, ratio("usage_count", "average_quantity")).otherwise(F.lit(0.0))
    return both.select(*KEY, "ingredient", "average_quantity", "usage_count", turn.alias("turnover_ratio"))


def order_type_efficiency(sales: DataFrame) -> DataFrame:
    return rates(sales, "order_type")


def payment_efficiency(sales: DataFrame) -> DataFrame:
    return rates(sales, "payment_method")


def _mean(df: DataFrame, c: str, name: str) -> DataFrame:
    # exact mean: order of rows does not matter
    x = F.col(c).cast("decimal(28,10)")
    return df.groupBy(*KEY).agg((dbl(F.sum(x)) / F.count(x)).alias(name))


def efficiency_score(sales: DataFrame) -> DataFrame:
    """Mean of the parts that exist, each 0 to 25, times four."""
    parts = (
        _mean(sales_velocity(sales), "items_per_transaction", "_velocity")
        .join(peak_hours(sales).select(*KEY, "peak_revenue_pct"), KEY, "full")
        .join(_mean(employee_efficiency(sales), "revenue_per_transaction", "_staff"), KEY, "full")
        .join(_mean(order_type_efficiency(sales), "items_per_transaction", "_orders"), KEY, "full")
    )

    def capped(c: Column) -> Column:
        return F.when(c.isNotNull(), F.least(F.lit(25.0), c))

    scores = F.filter(
        F.array(
            capped(F.col("_velocity") * 5),
            F.col("peak_revenue_pct") * 0.25,
            capped(F.col("_staff") * 0.25),
            capped(F.col("_orders") * 5),
        ),
        lambda x: x.isNotNull(),
    )
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return parts.select(
        *KEY, F.coalesce(F.try_divide(total, F.size(scores)) * 4, F.lit(0.0)).alias("efficiency_score")
    )


def transactions_by_hour(sales: DataFrame) -> DataFrame:
    """Mean daily transactions for each hour."""
    v = sales_velocity(sales)
    return v.groupBy(*KEY, "hour").agg(
        ratio(F.sum("transaction_count"), F.count(F.lit(1))).alias("average_transactions")
    )


def top_employees(sales: DataFrame, limit: int = 5) -> DataFrame:
    per = employee_efficiency(sales).select(*KEY, "employee_id", "revenue", "transaction_count")
    return top_within(per, KEY, [F.col("revenue").desc(), F.col("employee_id")], limit)
