"""The restaurant KPI suite: one small DataFrame per KPI, one row per location or finer.

Amounts are summed as exact decimals, so results do not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.functions.items import (
    UNIT_COST,
    item_base,
    item_cost,
    line_cost,
    recipe_lines,
    times,
)
from brigade.functions.numbers import MONEY, dbl, ratio, to_cents, zero_if_null
from brigade.operators.medians import medians
from brigade.operators.spread import attach, running, settle, top_within

KEY = ["location_id"]
AMOUNT_QTY = "decimal(14,3)"

# Category words in order of precedence.
CATEGORY_WORDS = {
    "Alcohol": ("beer", "wine", "liquor", "whiskey", "vodka"),
    "Beverages": ("soda", "juice", "water", "coffee", "tea"),
}
OTHER_CATEGORY = "Food"

# Menu quadrants and their advice.
QUADRANT_ADVICE = {
    "STAR": "Keep & Promote - This is a winning item",
    "PLOW HORSE": "Increase price or reduce cost - Popular but not profitable",
    "PUZZLE": "Promote more - Hidden gem with great margins",
    "DOG": "Consider removing - Low sales and low profit",
}

# KPI names of the availability report, in report order.
KPI_NAMES = (
    "total_sales", "net_revenue", "splh", "guest_count", "avg_check", "top_items",
    "gross_profit_per_item", "food_cost_pct", "cogs_by_category", "inventory_turnover",
    "popularity_vs_profitability", "labor_hours_by_role", "overtime_pct", "low_inventory_warnings",
    "table_turn_time", "kds_ticket_time", "order_accuracy_rate", "seasonal_sales", "promo_roi",
    "dish_waste_pct", "total_cogs",
)


def gross_column(sales: DataFrame) -> str:
    return next(c for c in ("gross_sales", "subtotal", "total_amount") if c in sales.columns)


def _total(c: Column | str, kind: str = MONEY) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c.cast(kind)), F.lit(0))


def location_totals(sales: DataFrame, discount_source: str = "percent") -> DataFrame:
    """All sums over the sales of a location in one pass; Catalyst drops those nobody asks for.

    ``discount_source="percent"`` is for rows whose promos and discount_percent are separate things.
    ``"promos"`` is for rows of the POS adapter, which fills both from one discount: it is taken once.
    """
    gross, have = gross_column(sales), set(sales.columns)
    zero = F.lit(0).cast("decimal(28,6)")

    def part(name: str) -> Column:
        return _total(name).cast("decimal(28,6)") if name in have else F.first(zero)

    percent = F.first(zero)
    if "discount_percent" in have and discount_source != "promos":
        # percent times money: four decimals are exact
        off = F.col(gross).cast(MONEY) * F.col("discount_percent").cast("decimal(7,2)") * F.lit("0.01").cast("decimal(3,2)")
        percent = F.coalesce(F.sum(off), F.lit(0)).cast("decimal(28,6)")
    guests = F.coalesce(F.sum("covers"), F.lit(0)) if "covers" in have else F.count(F.lit(1))
    sums = sales.groupBy(*KEY).agg(
        part(gross).alias("gross_sales"), part("comps").alias("comps"), part("promos").alias("promos"),
        part("voids").alias("voids"), percent.alias("discounts"), guests.cast("long").alias("guest_count"),
        F.count(F.lit(1)).alias("sales"),
    )
    net = F.col("gross_sales") - F.col("comps") - F.col("promos") - F.col("voids") - F.col("discounts")
    return sums.withColumn("net_revenue", net).withColumn(
        "method", F.lit("covers" if "covers" in have else "transactions")
    )


def total_sales(sales: DataFrame) -> DataFrame:
    return total_sales_of(location_totals(sales))


def total_sales_of(totals: DataFrame) -> DataFrame:
    return totals.select(*KEY, F.col("gross_sales").alias("total_sales"), (F.col("gross_sales") < 0).alias("negative"))


def net_revenue(sales: DataFrame, discount_source: str = "percent") -> DataFrame:
    """Gross less comps, promos, voids and discounts, with the parts."""
    return location_totals(sales, discount_source).drop("guest_count", "sales", "method")


def sales_per_labor_hour(sales: DataFrame, labor: DataFrame) -> DataFrame:
    return labor_hour_value_of(location_totals(sales), labor)


def labor_hour_value_of(totals: DataFrame, labor: DataFrame) -> DataFrame:
    """Net revenue per hour of staff without a salary."""
    hourly = labor.where(~F.coalesce("is_salaried", F.lit(False))) if "is_salaried" in labor.columns else labor
    hours = hourly.groupBy(*KEY).agg(F.coalesce(F.sum("hours_worked"), F.lit(0.0)).alias("labor_hours"))
    net = totals.select(*KEY, F.round("net_revenue", 2).alias("net_revenue"))
    return net.join(hours, KEY, "left").select(
        *KEY, "net_revenue", "labor_hours", ratio("net_revenue", "labor_hours").alias("splh")
    )


def guest_count(sales: DataFrame) -> DataFrame:
    """Covers when the column is there, else the number of sales."""
    return location_totals(sales).select(*KEY, "guest_count", "method")


def average_check(sales: DataFrame) -> DataFrame:
    return average_check_of(location_totals(sales))


def average_check_of(totals: DataFrame) -> DataFrame:
    return totals.select(
        *KEY, "net_revenue", "guest_count", ratio("net_revenue", "guest_count").alias("average_check")
    )


def top_items(sales: DataFrame, limit: int = 10) -> DataFrame:
    return top_of(item_base(sales), limit)


def top_of(base: DataFrame, limit: int = 10) -> DataFrame:
    order = [F.col("units").desc(), F.col("menu_item")]
    return top_within(base, KEY, order, limit).select(
        *KEY, "rank", "menu_item", "units", F.round("revenue", 2).alias("revenue")
    )


def distinct_items(sales: DataFrame) -> DataFrame:
    return item_base(sales).groupBy(*KEY).agg(F.count(F.lit(1)).alias("distinct_items"))


def with_cost(base: DataFrame, menu: DataFrame) -> DataFrame:
    """Item base with its unit cost; an item without a recipe costs nothing."""
    return base.join(item_cost(menu), ["location_id", "menu_item"], "left").withColumn(
        "unit_cost", zero_if_null("unit_cost").cast(UNIT_COST)
    )


def gross_profit_per_item(sales: DataFrame, menu: DataFrame) -> DataFrame:
    return profit_of(item_base(sales), menu)


def profit_of(base: DataFrame, menu: DataFrame) -> DataFrame:
    costed = with_cost(base, menu).withColumn("cost", times("units", "unit_cost"))
    profit = F.col("revenue") - F.col("cost")
    return costed.select(
        *KEY,
        "menu_item",
        "units",
        F.round("revenue", 2).cast("decimal(28,2)").alias("revenue"),
        F.round("cost", 2).cast("decimal(28,2)").alias("cost"),
        F.round(profit, 2).cast("decimal(28,2)").alias("gross_profit"),
        F.when(F.col("revenue") > 0, to_cents(ratio(profit, "revenue") * 100))
        .otherwise(F.lit(0.0))
        .alias("margin_pct"),
    )


def food_cost_pct(sales: DataFrame, menu: DataFrame) -> DataFrame:
    return food_cost_of(gross_profit_per_item(sales, menu))


def food_cost_of(per_item: DataFrame) -> DataFrame:
    sums = per_item.groupBy(*KEY).agg(F.sum("cost").alias("cost"), F.sum("revenue").alias("revenue"))
    pct = ratio("cost", "revenue") * 100
    return sums.select(*KEY, "cost", "revenue", pct.alias("food_cost_pct")).withColumn(
        "valid", F.coalesce(F.col("food_cost_pct").between(0, 100), F.lit(False))
    )


def category_of(ingredient: Column | str, word_boundary: bool = False) -> Column:
    """Category by words found in the ingredient: as substrings, or as whole words on request."""
    low = F.lower(F.col(ingredient) if isinstance(ingredient, str) else ingredient)
    out = None
    for category, words in CATEGORY_WORDS.items():
        pattern = "|".join(words)
        test = low.rlike(rf"\b({pattern})\b" if word_boundary else pattern)
        out = F.when(test, category) if out is None else out.when(test, category)
    return out.otherwise(OTHER_CATEGORY)


def ingredient_cost(sales: DataFrame, menu: DataFrame) -> DataFrame:
    return ingredient_cost_of(item_base(sales), menu)


def ingredient_cost_of(base: DataFrame, menu: DataFrame) -> DataFrame:
    units = base.select(*KEY, "menu_item", "units")
    used = units.join(recipe_lines(menu), ["location_id", "menu_item"])
    cost = line_cost().cast(UNIT_COST) * F.col("units").cast("decimal(12,0)")
    return used.groupBy(*KEY, "ingredient").agg(F.round(F.sum(cost), 2).cast("decimal(28,2)").alias("cost"))


def cogs_by_category(sales: DataFrame, menu: DataFrame, word_boundary: bool = False) -> DataFrame:
    return cogs_of(ingredient_cost(sales, menu), word_boundary)


def cogs_of(costs: DataFrame, word_boundary: bool = False) -> DataFrame:
    costs = costs.withColumn("category", category_of("ingredient", word_boundary))
    return costs.groupBy(*KEY, "category").agg(
        F.sum("cost").alias("cogs"), F.count(F.lit(1)).alias("ingredients")
    )


def inventory_turnover(sales: DataFrame, menu: DataFrame, inventory: DataFrame) -> DataFrame:
    return turnover_of(ingredient_cost(sales, menu), inventory)


def turnover_of(costs: DataFrame, inventory: DataFrame) -> DataFrame:
    cogs = costs.groupBy(*KEY).agg(F.sum("cost").alias("cogs"))
    value = F.col("quantity").cast(AMOUNT_QTY) * F.col("unit_cost").cast(MONEY)
    stock = inventory.groupBy(*KEY).agg(
        F.sum(value).alias("stock_value"), F.count(value).alias("stock_rows")
    )
    both = stock.join(cogs, KEY, "left").withColumn("cogs", zero_if_null("cogs"))
    average = ratio("stock_value", "stock_rows")
    return both.select(
        *KEY, "cogs", average.alias("average_stock_value"), F.try_divide(dbl("cogs"), average).alias("turnover")
    ).withColumn("valid", F.coalesce(F.col("turnover").between(0, 100), F.lit(False)))


def low_inventory(inventory: DataFrame) -> DataFrame:
    short = F.col("par_level") - F.col("quantity")
    return inventory.where(F.col("quantity") <= F.col("par_level")).select(
        *KEY, "date", "ingredient", "quantity", "par_level", short.alias("shortage")
    )


def low_inventory_count(inventory: DataFrame) -> DataFrame:
    low = F.count_if(F.col("quantity") <= F.col("par_level"))
    return inventory.groupBy(*KEY).agg(low.alias("low_items"))


def labor_hours_by_role(labor: DataFrame) -> DataFrame:
    """Hours per position; the row without a position is the grand total."""
    known = labor.where(F.col("position").isNotNull())
    per_role = known.groupBy(*KEY, "position").agg(F.sum("hours_worked").alias("hours"))
    return per_role.rollup(*KEY, "position").agg(F.sum("hours").alias("hours")).where(
        F.col("location_id").isNotNull()
    )


def overtime_pct(labor: DataFrame, warn_above: float = 50.0) -> DataFrame:
    """Overtime share of non-salaried hours per position and overall."""
    hourly = labor.where(~F.coalesce("is_salaried", F.lit(False)) & F.col("position").isNotNull())
    per_role = hourly.groupBy(*KEY, "position").agg(
        F.sum("overtime_hours").alias("overtime_hours"), F.sum("hours_worked").alias("hours")
    )
    both = per_role.rollup(*KEY, "position").agg(
        F.sum("overtime_hours").alias("overtime_hours"), F.sum("hours").alias("hours")
    )
    pct = ratio("overtime_hours", "hours") * 100
    return (
        both.where(F.col("location_id").isNotNull())
        .withColumn("overtime_pct", pct)
        .withColumn(
            "warning",
            F.when(F.col("overtime_hours") > F.col("hours"), "overtime exceeds hours").when(
                F.col("overtime_pct") > warn_above, "overtime share is high"
            ),
        )
    )


def menu_quadrants(sales: DataFrame, menu: DataFrame) -> DataFrame:
    """Popularity against profitability with exact medians and full ranks."""
    # ranking samples its input before it shuffles it: settled, the sales are scanned once
    return quadrants_of(settle(gross_profit_per_item(sales, menu), "profit"))


def quadrants_of(items: DataFrame) -> DataFrame:
    """Medians are read off the ranks, so no task holds all items of a location."""
    by_profit = [F.col("gross_profit").desc(), F.col("units").desc(), F.col("menu_item")]
    by_units = [F.col("units").desc(), F.col("gross_profit").desc(), F.col("menu_item")]
    ranked = running(items, KEY, by_profit, rank="profitability_rank")
    ranked = running(ranked, KEY, by_units, rank="popularity_rank", size="items")

    def middle(rank: str) -> Column:
        return F.col(rank).between(F.floor((F.col("items") + 1) / 2), F.ceil((F.col("items") + 1) / 2))

    # only the one or two middle rows of each location carry a value
    middles = ranked.groupBy(*KEY).agg(
        F.avg(F.when(middle("popularity_rank"), dbl("units"))).alias("median_units"),
        F.avg(F.when(middle("profitability_rank"), dbl("gross_profit"))).alias("median_profit"),
        F.count(F.lit(1)).alias("_n"),
    )
    return _with_quadrant(attach(ranked.drop("items"), middles, KEY, "inner", weight="_n").drop("_n"))


def quadrant_sizes(items: DataFrame) -> DataFrame:
    """Items per location and quadrant: the medians alone, without any rank."""
    middle = medians(items, KEY, ["units", "gross_profit"]).withColumnRenamed("median_gross_profit", "median_profit")
    sizes = items.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    placed = _with_quadrant(attach(items, middle.join(sizes, KEY), KEY, "inner", weight="_n"))
    return placed.groupBy(*KEY, "quadrant").agg(F.count(F.lit(1)).alias("n"))


def _with_quadrant(placed: DataFrame) -> DataFrame:
    popular = F.col("units") >= F.col("median_units")
    profitable = dbl("gross_profit") >= F.col("median_profit")
    quadrant = (
        F.when(popular & profitable, "STAR")
        .when(popular, "PLOW HORSE")
        .when(profitable, "PUZZLE")
        .otherwise("DOG")
    )
    advice = F.create_map(*[F.lit(v) for pair in QUADRANT_ADVICE.items() for v in pair])
    return placed.withColumn("quadrant", quadrant).withColumn("recommendation", advice[F.col("quadrant")])


def quadrant_counts(quadrants: DataFrame) -> DataFrame:
    return quadrants.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("total_items"),
        *[F.count_if(F.col("quadrant") == q).alias(q.lower().replace(" ", "_")) for q in QUADRANT_ADVICE],
        F.round(F.max("median_units"), 2).alias("median_units"),
        F.round(F.max("median_profit"), 2).alias("median_profit"),
    )
