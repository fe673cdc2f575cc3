"""Point-of-sale order summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brigade.functions.numbers import MONEY, ratio
from brigade.operators.spread import top_within

KEY = ["location_id"]
DAY = ["location_id", "order_date"]


def order_items(orders: DataFrame) -> DataFrame:
    """One row per order item; a nameless item is Unknown."""
    return orders.select(*KEY, "order_id", "order_date", F.explode("items").alias("i")).select(
        *KEY, "order_id", "order_date",
        F.coalesce(F.col("i.menu_item_name"), F.lit("Unknown")).alias("menu_item"),
        F.col("i.quantity").cast("long").alias("quantity"),
        F.col("i.amount").cast(MONEY).alias("amount"),
        F.col("i.food_cost").cast(MONEY).alias("food_cost"),
    )


def day_totals(orders: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum(F.col("total").cast(MONEY)), F.lit(0))
    n = F.count(F.lit(1))
    return orders.groupBy(*DAY).agg(
        n.alias("total_orders"), total.alias("total_revenue"),
        ratio(total, n, 0.0).alias("average_order_value"),
    )


def day_top_items(orders: DataFrame, limit: int = 10) -> DataFrame:
    sums = order_items(orders).groupBy(*DAY, "menu_item").agg(F.sum("quantity").alias("quantity"))
    return top_within(sums, DAY, [F.col("quantity").desc(), F.col("menu_item")], limit)


def day_hours(orders: DataFrame) -> DataFrame:
    timed = orders.where(F.col("order_ts").isNotNull())
    return timed.groupBy(*DAY, F.hour("order_ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("total").cast(MONEY)).alias("revenue")
    )


def daily_summary(orders: DataFrame, limit: int = 10) -> DataFrame:
    """One row per store and day with two small maps: at most ``limit`` items and 24 hours."""
    items = day_top_items(orders, limit).groupBy(*DAY).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("menu_item", "quantity")))).alias("top_items")
    )
    hours = day_hours(orders).groupBy(*DAY).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("hour", "revenue")))).alias("hourly_revenue")
    )
    return day_totals(orders).join(items, DAY, "left").join(hours, DAY, "left")


def recent_days(summary: DataFrame, as_of: dt.date, days: int = 7, col: str = "order_date") -> DataFrame:
    return summary.where(F.col(col).between(F.lit(as_of - dt.timedelta(days=days - 1)), F.lit(as_of)))


def latest_orders(orders: DataFrame, limit: int = 100) -> DataFrame:
    return top_within(orders, KEY, [F.col("order_date").desc(), F.col("order_id").desc()], limit)


def history_totals(orders: DataFrame) -> DataFrame:
    total = F.sum(F.col("total").cast(MONEY))
    n = F.count(F.lit(1))
    return orders.groupBy(*KEY).agg(
        n.alias("orders"), total.alias("revenue"), ratio(total, n, 0.0).alias("average_order_value")
    )


def history_hours(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("order_ts").isNotNull()).groupBy(*KEY, F.hour("order_ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("orders")
    )


def history_items(orders: DataFrame) -> DataFrame:
    """Per item quantity, revenue, food cost, profit and margin; line amounts are totals already."""
    sums = order_items(orders).groupBy(*KEY, "menu_item").agg(
        F.sum("quantity").alias("quantity"), F.sum("amount").alias("revenue"), F.sum("food_cost").alias("food_cost")
    )
    profit = F.col("revenue") - F.col("food_cost")
    return sums.withColumn("profit", profit).withColumn(
        "margin_pct", ratio("profit", "revenue", 0.0) * 100
    )


def history_top_items(orders: DataFrame, limit: int = 10) -> DataFrame:
    return top_within(history_items(orders), KEY, [F.col("quantity").desc(), F.col("menu_item")], limit)


def menu_by_category(menu: DataFrame) -> DataFrame:
    """Items per category and their mean price; an item without a price counts in the divisor."""
    price = F.coalesce(F.col("item_price").cast(MONEY), F.lit(0).cast(MONEY))
    n = F.count(F.lit(1))
    return menu.groupBy(*KEY, "category").agg(n.alias("items"), ratio(F.sum(price), n).alias("average_price"))


def merged_top_items(summary: DataFrame, limit: int = 10) -> DataFrame:
    """Top items over several daily summaries, from their maps."""
    pairs = summary.select(*KEY, F.explode("top_items").alias("menu_item", "quantity"))
    sums = pairs.groupBy(*KEY, "menu_item").agg(F.sum("quantity").alias("quantity"))
    return top_within(sums, KEY, [F.col("quantity").desc(), F.col("menu_item")], limit)


def insights(summary: DataFrame) -> DataFrame:
    """Totals over the days, with the best and the worst day by revenue."""
    orders, revenue = F.sum("total_orders"), F.sum("total_revenue")
    return summary.groupBy(*KEY).agg(
        orders.alias("total_orders"), revenue.alias("total_revenue"),
        ratio(revenue, orders, 0.0).alias("average_order_value"),
        F.max_by("order_date", F.struct("total_revenue", F.date_diff(F.lit("9999-12-31").cast("date"), "order_date"))).alias("best_day"),
        F.min_by("order_date", F.struct("total_revenue", "order_date")).alias("worst_day"),
    )


def record_counts(**tables: DataFrame) -> DataFrame:
    """Rows per data type."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("data_type"), "records")
        out = part if out is None else out.unionByName(part)
    return out


def freshness(as_of, max_age_minutes: int = 30, **sources: DataFrame) -> DataFrame:
    """Newest ingest_ts per source and whether it is older than allowed."""
    out = None
    for name, df in sources.items():
        newest = df.agg(F.max("ingest_ts").alias("newest"))
        age = (F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp("newest")) / 60
        part = newest.select(
            F.lit(name).alias("source"), "newest",
            F.coalesce(age > max_age_minutes, F.lit(True)).alias("stale"),
        )
        out = part if out is None else out.unionByName(part)
    return out
