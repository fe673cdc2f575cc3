"""Runs that build many figures at once, as one long table or as named lazy frames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.functions.items import item_base
from brigade.functions.numbers import dbl
from brigade.functions.periods import between, in_period
from brigade.operators import dashboard, kpi
from brigade.operators.kpi import KEY, KPI_NAMES
from brigade.operators.spread import settle

# Columns each KPI cannot do without, per table.
NEEDS = {
    "total_sales": {"sales": ["location_id"]},
    "net_revenue": {"sales": ["location_id"]},
    "splh": {"sales": ["location_id"], "labor": ["hours_worked"]},
    "guest_count": {"sales": ["location_id"]},
    "avg_check": {"sales": ["location_id"]},
    "top_items": {"sales": ["items", "total_amount"]},
    "gross_profit_per_item": {"sales": ["items", "total_amount"], "menu": ["menu_item", "amount", "unit_cost"]},
    "food_cost_pct": {"sales": ["items", "total_amount"], "menu": ["menu_item", "amount", "unit_cost"]},
    "cogs_by_category": {"sales": ["items"], "menu": ["menu_item", "ingredient", "amount", "unit_cost"]},
    "inventory_turnover": {
        "sales": ["items"], "menu": ["menu_item", "ingredient", "amount", "unit_cost"],
        "inventory": ["quantity", "unit_cost"],
    },
    "low_inventory_warnings": {"inventory": ["quantity", "par_level"]},
    "labor_hours_by_role": {"labor": ["position", "hours_worked"]},
    "overtime_pct": {"labor": ["position", "hours_worked", "overtime_hours"]},
    "popularity_vs_profitability": {"sales": ["items", "total_amount"], "menu": ["menu_item", "amount", "unit_cost"]},
}


def missing_columns(tables: dict[str, DataFrame | None]) -> dict[str, list[str]]:
    """What each KPI lacks, seen from the schemas alone."""
    lacks: dict[str, list[str]] = {}
    for name, needs in NEEDS.items():
        for table, columns in needs.items():
            df = tables.get(table)
            have = set() if df is None else set(df.columns)
            lacks.setdefault(name, []).extend(f"{table}.{c}" for c in columns if c not in have)
    return {k: v for k, v in lacks.items() if v}


def _long(df: DataFrame, name: str, metric: Column, value: Column, valid: Column | None = None,
          warning: Column | None = None) -> DataFrame:
    return df.select(
        *KEY, F.lit(name).alias("kpi"), metric.cast("string").alias("metric"), dbl(value).alias("value"),
        (F.lit(True) if valid is None else valid).alias("valid"),
        (F.lit(None) if warning is None else warning).cast("string").alias("warning"),
    )


def all_kpis(
    sales: DataFrame | None, inventory: DataFrame | None, menu: DataFrame | None, labor: DataFrame | None,
    period: str = "All", as_of: dt.date | None = None, top: int = 10,
    bounds: tuple[dt.date, dt.date] | None = None,
) -> DataFrame:
    """Every KPI the given tables allow, long: (location_id, kpi, metric, value, valid, warning).

    Sales and labor are taken from a named period before ``as_of``, or from the days in ``bounds``. A KPI whose columns are missing gives one invalid row without a location, naming what it lacks.
    """
    if bounds is not None:
        sales = None if sales is None else between(sales, bounds)
        labor = None if labor is None else between(labor, bounds)
    elif as_of is not None:
        sales = None if sales is None else in_period(sales, period, as_of)
        labor = None if labor is None else in_period(labor, period, as_of)
    lacks = missing_columns({"sales": sales, "inventory": inventory, "menu": menu, "labor": labor})
    lit = F.lit
    # figures that share a scan share one settled base
    if sales is not None:
        totals = settle(kpi.location_totals(sales), "totals")
    if "cogs_by_category" not in lacks:
        base = settle(item_base(sales), "item_base")
        costs = settle(kpi.ingredient_cost_of(base, menu), "ingredient_cost")
    elif "top_items" not in lacks:
        base = settle(item_base(sales), "item_base")
    if "gross_profit_per_item" not in lacks:
        profit = settle(kpi.profit_of(base, menu), "profit")
    makers = {
        "total_sales": lambda: _long(
            kpi.total_sales_of(totals), "total_sales", lit("total"), F.col("total_sales"), None,
            F.when(F.col("negative"), "total is negative")),
        "net_revenue": lambda: _long(totals, "net_revenue", lit("total"), F.col("net_revenue")),
        "splh": lambda: _long(
            kpi.labor_hour_value_of(totals, labor), "splh", lit("value"), F.col("splh"), F.col("splh").isNotNull()),
        "guest_count": lambda: _long(totals, "guest_count", F.col("method"), F.col("guest_count")),
        "avg_check": lambda: _long(kpi.average_check_of(totals), "avg_check", lit("value"), F.col("average_check")),
        "top_items": lambda: _long(kpi.top_of(base, top), "top_items", F.col("menu_item"), F.col("units")),
        "gross_profit_per_item": lambda: _long(
            profit, "gross_profit_per_item", F.col("menu_item"), F.col("gross_profit")),
        "food_cost_pct": lambda: _long(
            kpi.food_cost_of(profit), "food_cost_pct", lit("value"), F.col("food_cost_pct"), F.col("valid")),
        "cogs_by_category": lambda: _long(
            kpi.cogs_of(costs), "cogs_by_category", F.col("category"), F.col("cogs")),
        "inventory_turnover": lambda: _long(
            kpi.turnover_of(costs, inventory), "inventory_turnover", lit("value"), F.col("turnover"),
            F.col("valid")),
        "low_inventory_warnings": lambda: _long(
            kpi.low_inventory_count(inventory), "low_inventory_warnings", lit("low_items"), F.col("low_items")),
        "labor_hours_by_role": lambda: _long(
            kpi.labor_hours_by_role(labor), "labor_hours_by_role", F.coalesce("position", lit("total")), F.col("hours")),
        "overtime_pct": lambda: _long(
            kpi.overtime_pct(labor), "overtime_pct", F.coalesce("position", lit("total")), F.col("overtime_pct"), None,
            F.col("warning")),
        "popularity_vs_profitability": lambda: _long(
            kpi.quadrant_sizes(profit),
            "popularity_vs_profitability", F.col("quadrant"), F.col("n")),
    }
    some = next(df for df in (sales, inventory, menu, labor) if df is not None)
    parts = [make() for name, make in makers.items() if name not in lacks]
    if "cogs_by_category" not in lacks:
        total_cogs = kpi.cogs_of(costs).groupBy(*KEY).agg(F.sum("cogs").alias("cogs"))
        parts.append(_long(total_cogs, "total_cogs", lit("total"), F.col("cogs")))
    for table, df in (("sales", sales), ("inventory", inventory), ("menu", menu), ("labor", labor)):
        if df is not None:
            rows = df.groupBy(*KEY).agg(F.count(lit(1)).alias("n"))
            parts.append(_long(rows, "rows", lit(table), F.col("n")))
    if lacks:
        notes = some.sparkSession.createDataFrame(
            [(k, "missing: " + ", ".join(v)) for k, v in lacks.items()], "kpi string, warning string"
        )
        key_type = some.schema["location_id"].dataType
        parts.append(notes.select(
            lit(None).cast(key_type).alias("location_id"), "kpi", lit("error").alias("metric"),
            lit(None).cast("double").alias("value"), lit(False).alias("valid"), "warning"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def kpi_availability(results: DataFrame) -> DataFrame:
    """For each location and each KPI of the report: is it there, is it valid, does it hold data."""
    known = results.where(F.col("location_id").isNotNull())
    found = known.groupBy(*KEY, "kpi").agg(
        F.bool_and("valid").alias("validation_passed"), F.bool_or(F.col("value").isNotNull()).alias("has_data")
    )
    # one small map per location, as long as the list of KPI names
    per_location = found.groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("kpi", F.struct("validation_passed", "has_data")))).alias("_found")
    )
    names = F.array(*[F.struct(F.lit(i + 1).alias("kpi_number"), F.lit(n).alias("kpi")) for i, n in enumerate(KPI_NAMES)])
    wanted = per_location.select(*KEY, "_found", F.explode(names).alias("_k"))
    hit = F.try_element_at("_found", F.col("_k.kpi"))
    return wanted.select(
        *KEY, "_k.kpi_number", "_k.kpi", hit.isNotNull().alias("is_available"),
        F.coalesce(hit["validation_passed"], F.lit(False)).alias("validation_passed"),
        F.coalesce(hit["has_data"], F.lit(False)).alias("has_data"),
    )


def dashboard_bundle(
    sales: DataFrame, menu: DataFrame, inventory: DataFrame, labor: DataFrame, special: str = "special"
) -> dict[str, DataFrame]:
    """All dashboard figures by name, each a lazy frame; the item figures share one settled base."""
    stats = settle(dashboard.item_stats(sales, menu), "item_stats")
    return {
        "revenue_and_order_value": dashboard.revenue_and_order_value(sales),
        "average_check": dashboard.average_check_by_sale(sales),
        "upselling_rate": dashboard.upselling_rate(sales),
        "daily_specials": dashboard.daily_specials(sales, special),
        "item_counts": dashboard.item_counts(sales),
        "stock_value": dashboard.stock_value(inventory),
        "low_stock_alerts": dashboard.low_stock_alerts(inventory),
        "available_quantity": dashboard.available_quantity(inventory),
        "menu_revisions": dashboard.menu_revisions(menu),
        "mean_hourly_rate": dashboard.mean_hourly_rate(labor),
        "labor_cost_pct": dashboard.labor_cost_pct(sales, labor),
        "top_sellers": dashboard.ranked_items(stats, "units", 5),
        "top_menu_items": dashboard.ranked_items(stats, "revenue", 15),
        "underperformers": dashboard.ranked_items(stats, "units", 15, ascending=True),
        "most_profitable": dashboard.ranked_items(stats, "profit", 5),
        "item_margins": dashboard.item_margins(stats),
        "item_hours": dashboard.item_hours(sales),
        "product_mix": dashboard.product_mix(sales),
        "cost_of_sales": dashboard.cost_of_sales_of(stats),
        "stock_cost": dashboard.stock_cost_by_ingredient(inventory),
        "ingredient_usage": dashboard.ingredient_usage(sales, menu),
        "waste": dashboard.inventory_waste(sales, menu, inventory),
        "depletion_by_item": dashboard.depletion_by_item(sales, menu),
        "recipe_cost": dashboard.recipe_cost_by_ingredient(menu),
    }


# What names a row of each frame, besides its location; all other columns are figures.
FRAME_KEYS = {
    "daily_specials": ["date"], "item_counts": ["menu_item", "rank"], "low_stock_alerts": ["ingredient", "rank"], "available_quantity": ["ingredient"],
    "menu_revisions": ["first_entry", "ingredient", "last_entry", "menu_item"], "top_sellers": ["menu_item", "rank"], "top_menu_items": ["menu_item", "rank"],
    "underperformers": ["menu_item", "rank"], "most_profitable": ["menu_item", "rank"], "item_margins": ["menu_item"], "item_hours": ["hour", "menu_item"],
    "product_mix": ["menu_item"], "stock_cost": ["ingredient"], "ingredient_usage": ["ingredient"], "waste": ["date", "ingredient"],
    "depletion_by_item": ["ingredient", "menu_item"], "recipe_cost": ["ingredient"],
}


def long_frame(df: DataFrame, frame: str) -> DataFrame:
    """A frame as rows of (location, frame, name, metric, value); one without figures gives its rows the figure 1."""
    keys = FRAME_KEYS.get(frame, [])
    figures = [c for c in df.columns if c not in (*KEY, *keys)]
    name = F.concat_ws(" | ", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    pairs = [F.struct(F.lit(c).alias("metric"), dbl(c).alias("value")) for c in figures] or [F.struct(F.lit("rows").alias("metric"), F.lit(1.0).alias("value"))]
    rows = df.select(*KEY, F.lit(frame).alias("frame"), name.alias("name"), F.explode(F.array(*pairs)).alias("f"))
    return rows.select(*KEY, "frame", "name", "f.*")


def whole_bundle(bundle: dict[str, DataFrame]) -> DataFrame:
    """All frames of a bundle in one long table."""
    out = None
    for frame, df in bundle.items():
        part = long_frame(df, frame)
        out = part if out is None else out.unionByName(part)
    return out


def bundle_headlines(bundle: dict[str, DataFrame]) -> DataFrame:
    """The one-row-per-location figures of a bundle, side by side."""
    names = ("revenue_and_order_value", "average_check", "upselling_rate", "stock_value", "mean_hourly_rate", "cost_of_sales")
    out = bundle[names[0]]
    for name in names[1:]:
        out = out.join(bundle[name], KEY, "left")
    return out
