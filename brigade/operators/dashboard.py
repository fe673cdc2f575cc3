"""Dashboard figures over sales, menu, inventory and labor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.functions.items import AMOUNT, item_base, line_cost, sold_items, times
from brigade.functions.numbers import MONEY, dbl, ratio, to_cents
from brigade.functions.periods import last_days_of_data
from brigade.operators.kpi import AMOUNT_QTY, KEY, with_cost
from brigade.operators.spread import attach, top_within

ITEM = ["location_id", "menu_item"]


def revenue_and_order_value(sales: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum(F.col("total_amount").cast(MONEY)), F.lit(0))
    return sales.groupBy(*KEY).agg(
        total.alias("total_revenue"), ratio(total, F.count("total_amount")).alias("average_order_value")
    )


def average_check_by_sale(sales: DataFrame) -> DataFrame:
    """Mean over sales of the summed amount of each sale."""
    per_sale = sales.groupBy(*KEY, "sale_id").agg(F.sum(F.col("total_amount").cast(MONEY)).alias("amount"))
    return per_sale.groupBy(*KEY).agg(ratio(F.sum("amount"), F.count("amount")).alias("average_check"))


def upselling_rate(sales: DataFrame) -> DataFrame:
    n = F.count("number_of_items")
    return sales.groupBy(*KEY).agg(ratio(F.sum("number_of_items"), n).alias("upselling_rate"))


def is_special(word: str = "special") -> Column:
    return F.coalesce(F.lower("items_sold").contains(word.lower()), F.lit(False))


def daily_specials(sales: DataFrame, word: str = "special") -> DataFrame:
    chosen = sales.where(is_special(word) & F.col("date").isNotNull())
    return chosen.groupBy(*KEY, "date").agg(F.sum(F.col("total_amount").cast(MONEY)).alias("total_amount"))


def best_special_days(sales: DataFrame, word: str = "special", limit: int = 10) -> DataFrame:
    order = [F.col("total_amount").desc(), F.col("date")]
    return top_within(daily_specials(sales, word), KEY, order, limit)


def item_counts(sales: DataFrame, limit: int = 5) -> DataFrame:
    counts = sold_items(sales).groupBy(*ITEM).agg(F.count(F.lit(1)).alias("units"))
    return top_within(counts, KEY, [F.col("units").desc(), F.col("menu_item")], limit)


def stock_value(inventory: DataFrame) -> DataFrame:
    value = F.col("quantity").cast(AMOUNT_QTY) * F.col("unit_cost").cast(MONEY)
    return inventory.groupBy(*KEY).agg(F.coalesce(F.sum(value), F.lit(0)).alias("stock_value"))


def low_stock_alerts(inventory: DataFrame, limit: int = 10) -> DataFrame:
    low = inventory.where(F.col("quantity") <= F.col("par_level"))
    return top_within(low, KEY, [F.col("quantity"), F.col("ingredient"), F.col("date")], limit).select(
        *KEY, "rank", "ingredient", "quantity", "par_level"
    )


def available_quantity(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy(*KEY, "ingredient").agg(F.sum("quantity").alias("quantity"))


def menu_revisions(menu: DataFrame) -> DataFrame:
    """Recipe lines whose first and last entry dates differ."""
    span = menu.groupBy(*ITEM, "ingredient").agg(
        F.min("created_at").alias("first_entry"), F.max("created_at").alias("last_entry")
    )
    return span.where(F.col("first_entry") != F.col("last_entry"))


def mean_hourly_rate(labor: DataFrame) -> DataFrame:
    rate = F.col("hourly_rate").cast(MONEY)
    return labor.groupBy(*KEY).agg(ratio(F.sum(rate), F.count(rate)).alias("mean_hourly_rate"))


def labor_cost_pct(sales: DataFrame, labor: DataFrame, hours_per_order: float = 8.0) -> DataFrame:
    """Orders x hours x mean non-zero rate, as a share of revenue."""
    rate = F.when(F.col("hourly_rate") != 0, F.col("hourly_rate").cast(MONEY))
    rates = labor.groupBy(*KEY).agg(ratio(F.sum(rate), F.count(rate)).alias("rate"))
    orders = sales.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("total_amount").cast(MONEY)).alias("revenue")
    )
    cost = F.col("orders") * F.lit(hours_per_order) * F.coalesce("rate", F.lit(0.0))
    return orders.join(rates, KEY, "left").select(
        *KEY, "orders", "revenue", (F.try_divide(cost, dbl("revenue")) * 100).alias("labor_cost_pct")
    )


def item_stats(sales: DataFrame, menu: DataFrame) -> DataFrame:
    """Units, revenue from subtotals, cost and profit per item."""
    costed = with_cost(item_base(sales, revenue_basis="subtotal"), menu)
    return costed.withColumn("cost", times("units", "unit_cost")).withColumn(
        "profit", F.col("revenue") - F.col("cost")
    )


def ranked_items(stats: DataFrame, by: str, limit: int, ascending: bool = False) -> DataFrame:
    order = F.col(by).asc() if ascending else F.col(by).desc()
    return top_within(stats, KEY, [order, F.col("menu_item")], limit).select(
        *KEY, "rank", "menu_item", "units", F.round("revenue", 2).alias("revenue"),
        F.round("profit", 2).alias("profit"),
    )


def item_margins(stats: DataFrame) -> DataFrame:
    return stats.select(
        *ITEM,
        to_cents(ratio("profit", "revenue", 0.0)).alias("profit_margin"),
        F.round(F.col("revenue") - F.col("cost"), 2).alias("contribution_margin"),
        to_cents(ratio("cost", "revenue", 0.0) * 100).alias("food_cost_pct"),
        to_cents(ratio("revenue", "units", 0.0)).alias("average_price"),
    )


def item_hours(sales: DataFrame) -> DataFrame:
    """Revenue per item and hour."""
    base = item_base(sales.where(F.col("hour").isNotNull()), "hour", revenue_basis="subtotal")
    return base.select(*KEY, "menu_item", "hour", "revenue")


def item_hour_maps(sales: DataFrame) -> DataFrame:
    """Per item one map hour -> revenue; never more than 24 entries."""
    pair = F.struct("hour", F.round("revenue", 2).alias("revenue"))
    return item_hours(sales).groupBy(*ITEM).agg(
        F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("revenue_by_hour")
    )


def product_mix(sales: DataFrame) -> DataFrame:
    base = item_base(sales).select(*ITEM, "units")
    totals = base.groupBy(*KEY).agg(F.sum("units").alias("total_units"), F.count(F.lit(1)).alias("_n"))
    return attach(base, totals, KEY, "inner", weight="_n").select(
        *ITEM, "units", (ratio("units", "total_units") * 100).alias("mix_pct")
    )


def cost_of_sales(sales: DataFrame, menu: DataFrame) -> DataFrame:
    """Unit cost x units over all items against all revenue."""
    return cost_of_sales_of(item_stats(sales, menu))


def cost_of_sales_of(stats: DataFrame) -> DataFrame:
    sums = stats.groupBy(*KEY).agg(
        F.sum("revenue").alias("revenue"), F.sum("cost").alias("cogs")
    )
    return sums.select(
        *KEY, "revenue", "cogs", (F.col("revenue") - F.col("cogs")).alias("gross_profit"),
        (ratio("cogs", "revenue", 0.0) * 100).alias("food_cost_pct"),
    )


def stock_cost_by_ingredient(inventory: DataFrame) -> DataFrame:
    value = F.col("quantity").cast(AMOUNT_QTY) * F.col("unit_cost").cast(MONEY)
    return inventory.groupBy(*KEY, "ingredient").agg(
        F.sum(value).alias("stock_cost"), F.sum("quantity").alias("quantity")
    )


def item_units(sales: DataFrame) -> DataFrame:
    return sold_items(sales).groupBy(*ITEM).agg(F.count(F.lit(1)).alias("units"))


def _usage(sales: DataFrame, menu: DataFrame) -> DataFrame:
    lines = menu.groupBy(*ITEM, "ingredient").agg(F.sum(F.col("amount").cast(AMOUNT)).alias("amount"))
    used = F.col("amount").cast("decimal(20,3)") * F.col("units").cast("decimal(12,0)")
    joined = item_units(sales).join(lines, ITEM)
    return joined.groupBy(*KEY, "ingredient").agg(
        F.sum(used).cast("decimal(34,3)").alias("used"), F.count(F.lit(1)).alias("items")
    )


def ingredient_usage(sales: DataFrame, menu: DataFrame) -> DataFrame:
    """Recipe amounts over all sold items: units are counted first, then joined to the recipe."""
    return _usage(sales, menu).drop("items")


def inventory_waste(sales: DataFrame, menu: DataFrame, inventory: DataFrame) -> DataFrame:
    """Stock rows of which less was used than stocked."""
    joined = inventory.join(ingredient_usage(sales, menu), [*KEY, "ingredient"], "left")
    used = dbl(F.coalesce("used", F.lit(0)))
    return joined.where(used < dbl("quantity")).select(
        *KEY, "date", "ingredient", "quantity", used.alias("used"), (dbl("quantity") - used).alias("waste")
    )


def depletion_by_item(sales: DataFrame, menu: DataFrame) -> DataFrame:
    """For each sold item the total use of each of its ingredients, one row per pair."""
    pairs = item_units(sales).select(*ITEM).join(menu.select(*ITEM, "ingredient").distinct(), ITEM)
    # an ingredient may be part of very many items
    return attach(pairs, _usage(sales, menu), [*KEY, "ingredient"], "inner", weight="items").drop("items")


def recipe_cost_by_ingredient(menu: DataFrame) -> DataFrame:
    return menu.groupBy(*KEY, "ingredient").agg(F.sum(line_cost()).alias("recipe_cost"))


def week_summary(sales: DataFrame, expense_share: float = 0.6, days: int = 7) -> DataFrame:
    """Last days of data per location: income, assumed expense and profit."""
    week = last_days_of_data(sales, days)
    totals = week.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("total_amount").cast(MONEY)).alias("income")
    )
    expense = dbl("income") * F.lit(expense_share)
    return totals.select(
        *KEY, "orders", "income", expense.alias("expense"), (dbl("income") - expense).alias("profit")
    )


def week_top_items(
    sales: DataFrame, limit: int = 4, days: int = 7, margin: float | None = None
) -> DataFrame:
    """Best items of the last days; with ``margin`` also an assumed profit and cost."""
    base = item_base(last_days_of_data(sales, days), revenue_basis="subtotal")
    top = top_within(base, KEY, [F.col("revenue").desc(), F.col("menu_item")], limit)
    if margin is not None:
        top = top.withColumn("profit", dbl("revenue") * margin).withColumn(
            "cost", dbl("revenue") * (1 - margin)
        )
    return top


def latest_sales(sales: DataFrame, n: int = 100) -> DataFrame:
    return top_within(sales, KEY, [F.col("date").desc(), F.col("sale_id").desc()], n)


def location_overview(sales: DataFrame, anomalies: DataFrame, alerts: DataFrame, only_latest: int | None = None) -> DataFrame:
    """Every location: revenue, sales, newest date, anomalies and alerts; over all its sales, or only the latest ones."""
    recent = sales if only_latest is None else latest_sales(sales, only_latest)
    recent = recent.select(*KEY, "sale_id", "date", "total_amount")
    figures = recent.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum(F.col("total_amount").cast(MONEY)).alias("revenue"),
        F.max("date").alias("latest_date"),
    )
    ids = recent.select(*KEY, "sale_id")

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.join(ids, [*KEY, "sale_id"], "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias(name))

    return (
        figures.join(counted(anomalies, "anomalies"), KEY, "left")
        .join(counted(alerts, "alerts"), KEY, "left")
        .fillna(0, ["anomalies", "alerts"])
    )


def sales_summary(sales: DataFrame, menu: DataFrame, limit: int = 4) -> DataFrame:
    """Most profitable items with their share-based revenue and recipe cost."""
    return ranked_items(item_stats(sales, menu), "profit", limit)


def menu_upload_summary(menu: DataFrame) -> DataFrame:
    return menu.groupBy(*KEY).agg(
        F.count_distinct("menu_item").alias("items"), F.count_distinct("ingredient").alias("ingredients")
    )


def best_and_worst_items(sales: DataFrame, menu: DataFrame, limit: int = 3) -> DataFrame:
    stats = item_stats(sales, menu)
    best = ranked_items(stats, "profit", limit).withColumn("side", F.lit("best"))
    worst = ranked_items(stats, "profit", limit, ascending=True).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def inventory_upload_summary(banded: DataFrame) -> DataFrame:
    """Counts per alert band; wants the band column of silver.alert_band."""
    return banded.groupBy(*KEY).agg(
        F.count_if(F.col("band") == "LOW").alias("low"),
        F.count_if(F.col("band") == "CRITICAL LOW").alias("critical"),
        F.count_if(F.col("band") == "HIGH").alias("high"),
        F.count(F.lit(1)).alias("total"),
    )
