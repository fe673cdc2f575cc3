"""Whole bundles, and sources, filters and sinks that no other query reaches, over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brigade.functions import periods
from brigade.operators import catalog, dashboard, kpi
from brigade.plans import bundles
from brigade.plans.anomaly_queries import VIEWS
from brigade.plans.catalog_queries import WARNED, WHOLE, _all
from brigade.plans.io_queries import _path, _uploads
from brigade.plans.kpi_queries import INGREDIENT_COST
from brigade.plans.registry import SQL, query
from brigade.plans.views import AS_OF
from brigade.sources import csv_files, pos_json, sinks

LOC = "location_id::BIGINT AS location_id"

# -- dashboards ----------------------------------------------------------------------------------

# The query that has each frame's SQL, and its figures.
FRAMES = {
    "revenue_and_order_value": ("dash_revenue_and_order_value", "total_revenue average_order_value"),
    "average_check": ("dash_average_check_by_sale", "average_check"), "upselling_rate": ("dash_upselling_rate", "upselling_rate"),
    "daily_specials": ("dash_daily_specials", "total_amount"), "item_counts": ("dash_item_counts", "units"),
    "stock_value": ("dash_stock_value", "stock_value"), "low_stock_alerts": ("dash_low_stock_alerts", "quantity par_level"),
    "available_quantity": ("dash_available_quantity", "quantity"), "menu_revisions": ("dash_menu_revisions", ""),
    "mean_hourly_rate": ("dash_mean_hourly_rate", "mean_hourly_rate"), "labor_cost_pct": ("dash_labor_cost_pct", "orders revenue labor_cost_pct"),
    "top_sellers": ("dash_top_sellers", "units revenue profit"), "top_menu_items": ("dash_top_menu_items", "units revenue profit"),
    "underperformers": ("dash_underperformers", "units revenue profit"), "most_profitable": ("dash_most_profitable", "units revenue profit"),
    "item_margins": ("dash_item_margins", "profit_margin contribution_margin food_cost_pct average_price"), "item_hours": ("dash_item_hours", "revenue"),
    "product_mix": ("dash_product_mix", "units mix_pct"), "cost_of_sales": ("dash_cost_of_sales", "revenue cogs gross_profit food_cost_pct"),
    "stock_cost": ("dash_stock_cost_by_ingredient", "stock_cost quantity"), "ingredient_usage": ("dash_ingredient_usage", "used"),
    "waste": ("dash_inventory_waste", "quantity used waste"), "depletion_by_item": ("dash_depletion_by_item", "used"),
    "recipe_cost": ("dash_recipe_cost_by_ingredient", "recipe_cost"),
}


def _long_sql(frame: str) -> str:
    name, figures = FRAMES[frame]
    sql = SQL[name].replace("quantity * 100", "quantity") if frame == "waste" else SQL[name]
    keys = bundles.FRAME_KEYS.get(frame, [])
    text = " || ' | ' || ".join(f"coalesce({k}::VARCHAR, '')" for k in keys) or "''"
    parts = [f"SELECT location_id, '{frame}' AS frame, {text} AS name, '{c}' AS metric, {c}::DOUBLE AS value FROM f" for c in figures.split()]
    parts = parts or [f"SELECT location_id, '{frame}' AS frame, {text} AS name, 'rows' AS metric, 1.0::DOUBLE AS value FROM f"]
    return f"SELECT * FROM (WITH f AS ({sql}) " + " UNION ALL ".join(parts) + ")"


@query("dash_bundle_whole")
def _(t):
    return bundles.whole_bundle(bundles.dashboard_bundle(t.sales, t.menu, t.inventory, t.labor, "widget"))


SQL["dash_bundle_whole"] = " UNION ALL ".join(_long_sql(f) for f in FRAMES)

OVERVIEW = VIEWS + """, v_recent AS (
  SELECT * FROM v_sales QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY date DESC, sale_id DESC) <= {n}),
v_counted AS (
  SELECT location_id, COUNT(*) AS anomalies, COUNT(*) FILTER (severity = 'high') AS alerts
  FROM v_anomaly SEMI JOIN v_recent USING (location_id, sale_id) GROUP BY 1)
SELECT r.location_id::BIGINT AS location_id, COUNT(*) AS transactions, SUM(total_amount)::DOUBLE AS revenue, CAST(MAX(date) AS VARCHAR) AS latest_date,
       COALESCE(MAX(anomalies), 0) AS anomalies, COALESCE(MAX(alerts), 0) AS alerts
FROM v_recent r LEFT JOIN v_counted c ON r.location_id = c.location_id GROUP BY r.location_id"""


@query("dash_location_overview_of_anomalies", OVERVIEW.format(n=10**15))
def _(t):
    return dashboard.location_overview(t.sales, t.anomalies, t.anomalies.where("severity = 'high'"))


@query("dash_location_overview_of_latest_sales", OVERVIEW.format(n=100))
def _(t):
    return dashboard.location_overview(t.sales, t.anomalies, t.anomalies.where("severity = 'high'"), only_latest=100)


@query("catalog_low_stock_in_order", f"""
SELECT {LOC}, ingredient, quantity, par_level, par_level - quantity AS shortage, quantity / NULLIF(par_level, 0) AS ratio,
       row_number() OVER (PARTITION BY location_id ORDER BY quantity / NULLIF(par_level, 0) NULLS LAST, ingredient, quantity, par_level) AS position
FROM v_inventory WHERE quantity < par_level""")
def _(t):
    return catalog.under_par_in_order(t.inventory)


# -- KPIs ----------------------------------------------------------------------------------------

CATEGORIES = """CASE length(ingredient) % 5 WHEN 0 THEN ' steak' WHEN 1 THEN ' dark Beer' WHEN 2 THEN ' iced TEA' WHEN 3 THEN ' Watermelon wine' ELSE ' flour' END"""


@query("kpi_cogs_by_every_category", INGREDIENT_COST + f"""
SELECT {LOC}, CASE WHEN regexp_matches(x, 'beer|wine|liquor|whiskey|vodka') THEN 'Alcohol'
       WHEN regexp_matches(x, 'soda|juice|water|coffee|tea') THEN 'Beverages' ELSE 'Food' END AS category,
       SUM(cost)::DOUBLE AS cogs, COUNT(*) AS ingredients
FROM (SELECT *, lower(ingredient || {CATEGORIES}) AS x FROM v_ingredient_cost) GROUP BY ALL""")
def _(t):
    # the sample's ingredients are all food: a word added to each makes every category occur
    return kpi.cogs_by_category(t.sales, t.menu.withColumn("ingredient", F.concat("ingredient", F.expr(CATEGORIES))))


LACKING = {
    "top_items": "sales.items", "gross_profit_per_item": "sales.items, menu.menu_item, menu.amount, menu.unit_cost",
    "food_cost_pct": "sales.items, menu.menu_item, menu.amount, menu.unit_cost",
    "cogs_by_category": "sales.items, menu.menu_item, menu.ingredient, menu.amount, menu.unit_cost",
    "inventory_turnover": "sales.items, menu.menu_item, menu.ingredient, menu.amount, menu.unit_cost",
    "overtime_pct": "labor.overtime_hours", "popularity_vs_profitability": "sales.items, menu.menu_item, menu.amount, menu.unit_cost",
}


@query("kpi_all_with_missing_columns", WHOLE + f"""
SELECT * FROM ({WARNED}) WHERE kpi NOT IN ({", ".join(f"'{k}'" for k in LACKING)}, 'total_cogs') AND (kpi, metric) != ('rows', 'menu')
UNION ALL SELECT NULL, unnest({list(LACKING)!r}), 'error', NULL, false, 'missing: ' || unnest({list(LACKING.values())!r})""")
def _(t):
    return bundles.all_kpis(t.sales.drop("items"), t.inventory, None, t.labor.drop("overtime_hours"))


@query("filter_whole_period", f"""
SELECT {LOC}, COUNT(*) AS sales, CAST(MIN(date) AS VARCHAR) AS first, CAST(MAX(date) AS VARCHAR) AS last FROM v_sales
WHERE date BETWEEN DATE '2000-01-01' AND DATE '2001-08-01' GROUP BY location_id""")
def _(t):
    return periods.in_period(t.sales, "All", AS_OF).groupBy("location_id").agg(
        F.count(F.lit(1)).alias("sales"), F.min("date").alias("first"), F.max("date").alias("last"))


# -- sources and sinks ---------------------------------------------------------------------------

@query("sink_documents_written", WHOLE + WARNED)
def _(t):
    path = _path(t, "documents")
    sinks.write_documents(_all(t), path)
    return t.spark.read.schema("location_id bigint, kpi string, metric string, value double, valid boolean, warning string").json(path)


@query("source_json_orders_by_file_date", f"""
SELECT {LOC}, order_id::VARCHAR AS order_id, CAST(CAST(date_trunc('quarter', order_date) AS DATE) AS VARCHAR) AS order_date, total::DOUBLE AS total FROM v_pos""")
def _(t):
    path = _path(t, "by-date")
    record = F.to_json(F.struct(F.col("order_id").cast("string").alias("id"), F.col("total").cast("double").alias("total"), F.col("location_id").cast("string").alias("status")))
    # a file of one answer for each day (here a quarter); the orders themselves name no date
    day = F.to_date(F.date_trunc("quarter", "order_date"))
    t.pos_orders.select(day.alias("day"), record.alias("r")).groupBy("day").agg(
        F.concat(F.lit('{"result": ['), F.array_join(F.collect_list("r"), ","), F.lit("]}")).alias("value")).write.partitionBy("day").text(path)
    rows = pos_json.orders(pos_json.read_payloads(t.spark, path), F.lit(None), F.lit("2024-01-01").cast("timestamp"))
    return rows.select(F.col("status").cast("long").alias("location_id"), "order_id", "order_date", "total")


@query("source_all_categories", """
SELECT 'Sales' AS category, COUNT(*) AS rows, COUNT(DISTINCT sale_id) AS keys FROM v_sales
UNION ALL SELECT 'Inventory', COUNT(*), COUNT(DISTINCT ingredient) FROM v_inventory
UNION ALL SELECT 'Menu', COUNT(*), COUNT(DISTINCT menu_item) FROM v_menu""")
def _(t):
    folders = {"Sales": _uploads(t)}
    for name, df in (("Inventory", t.inventory.select("date", "ingredient", "quantity")), ("Menu", t.menu.select("menu_item", "ingredient", "item_price"))):
        folders[name] = [_path(t, "upload")]
        df.write.option("header", True).csv(folders[name][0])
    key = {"Sales": "sale_id", "Inventory": "ingredient", "Menu": "menu_item"}
    out = None
    for category, df in csv_files.read_all(t.spark, folders).items():
        part = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key[category]).alias("keys")).select(F.lit(category).alias("category"), "rows", "keys")
        out = part if out is None else out.unionByName(part)
    return out
