"""Catalog questions, filters, cleaning and bundles over the sample tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from brigade import schemas
from brigade.functions import clean, items, numbers, periods
from brigade.operators import catalog, efficiency, kpi, question_index, silver
from brigade.plans import bundles
from brigade.plans.kpi_queries import INGREDIENT_COST, NET
from brigade.plans.registry import QUERIES, SQL, query
from brigade.plans.views import AS_OF
from brigade.sources import csv_files, pos_json, sinks, tables

LOC = "location_id::BIGINT AS location_id"
NAMED = "JOIN v_restaurant r ON r.id = f.location_id"
DAY = dt.date(2000, 3, 15)


# -- by store ------------------------------------------------------------------------------------

@query("store_count_inventory", f"SELECT {LOC}, COUNT(*) AS total FROM v_inventory GROUP BY location_id")
def _(t):
    return catalog.inventory_rows(t.inventory)


@query("store_list_ingredients", f"SELECT DISTINCT {LOC}, ingredient FROM v_inventory")
def _(t):
    return catalog.ingredients(t.inventory)


@query("store_average_tip", f"""
SELECT {LOC}, ROUND(AVG(tip::DOUBLE / total_amount::DOUBLE * 100), 8) AS avg_tip_percentage, COUNT(*) AS total_orders,
       SUM(tip)::DOUBLE AS total_tips FROM v_sales WHERE tip IS NOT NULL AND total_amount > 0 GROUP BY location_id""")
def _(t):
    return catalog.tip_percentage(t.sales).withColumn("avg_tip_percentage", F.round("avg_tip_percentage", 8))


@query("store_menu_by_category", f"""
SELECT {LOC}, category, COUNT(DISTINCT menu_item) AS item_count, 0::BIGINT AS page,
       string_agg(DISTINCT menu_item, ', ' ORDER BY menu_item) AS items FROM v_menu GROUP BY location_id, category""")
def _(t):
    return catalog.menu_by_category(t.menu)


@query("store_low_stock", f"""
SELECT {LOC}, ingredient, quantity, par_level, par_level - quantity AS shortage, quantity / par_level AS ratio
FROM v_inventory WHERE quantity < par_level""")
def _(t):
    return catalog.under_par(t.inventory)


@query("store_search_ingredient", f"""
SELECT {LOC}, ingredient, quantity FROM v_inventory WHERE ingredient ILIKE '%promo%'""")
def _(t):
    return catalog.search(t.inventory, "ingredient", "Promo", "ingredient", "quantity")


@query("store_total_inventory_value", f"""
SELECT {LOC}, SUM(CAST(quantity AS DECIMAL(14,3)) * unit_cost)::DOUBLE AS total_value FROM v_inventory
WHERE unit_cost IS NOT NULL GROUP BY location_id""")
def _(t):
    return catalog.inventory_value(t.inventory)


@query("store_waste_items", f"SELECT {LOC}, ingredient, quantity, waste FROM v_inventory WHERE waste > 0")
def _(t):
    return catalog.wasted(t.inventory)


MENU_ROW = f"{LOC}, menu_item, ingredient, amount::DOUBLE AS amount, unit_cost::DOUBLE AS unit_cost"


@query("store_menu_items", f"SELECT {MENU_ROW} FROM v_menu")
def _(t):
    return catalog.menu_listing(t.menu)


@query("store_search_menu_item", f"SELECT {MENU_ROW} FROM v_menu WHERE menu_item ILIKE '%ring%'")
def _(t):
    return catalog.search(t.menu, "menu_item", "RING", "menu_item", "ingredient", "amount", "unit_cost")


@query("store_menu_by_ingredient", f"""
SELECT {LOC}, menu_item, ingredient, amount::DOUBLE AS amount FROM v_menu WHERE ingredient ILIKE '%economy%'""")
def _(t):
    return catalog.search(t.menu, "ingredient", "economy", "menu_item", "ingredient", "amount")


@query("store_expensive_menu_items", f"""
SELECT {LOC}, menu_item, unit_cost::DOUBLE AS unit_cost FROM v_menu WHERE unit_cost IS NOT NULL""")
def _(t):
    return catalog.menu_costs(t.menu)


TOTALS = f"{LOC}, COUNT(*) AS total_sales, SUM(total_amount)::DOUBLE AS total_revenue"
AVERAGE = "SUM(total_amount)::DOUBLE / COUNT(*) AS avg_order"


@query("store_sales_today", f"SELECT {TOTALS} FROM v_sales WHERE date = DATE '2001-07-31' GROUP BY location_id")
def _(t):
    return catalog.sales_today(t.sales, dt.date(2001, 7, 31))


@query("store_sales_by_date", f"SELECT {TOTALS} FROM v_sales WHERE date = DATE '2000-03-15' GROUP BY location_id")
def _(t):
    return catalog.sales_totals(periods.on_day(t.sales, DAY))


@query("store_sales_yesterday", f"SELECT {TOTALS} FROM v_sales WHERE date = DATE '2001-07-31' GROUP BY location_id")
def _(t):
    return catalog.sales_yesterday(t.sales, AS_OF)


@query("store_sales_this_week", f"SELECT {TOTALS}, {AVERAGE} FROM v_sales WHERE date >= DATE '2001-07-25' GROUP BY location_id")
def _(t):
    return catalog.sales_this_week(t.sales, AS_OF)


@query("store_top_selling_items", f"""
SELECT {LOC}, items_sold, SUM(number_of_items)::BIGINT AS total_sold, COUNT(*) AS order_count FROM v_sales
WHERE items_sold IS NOT NULL GROUP BY location_id, items_sold""")
def _(t):
    return catalog.item_texts_sold(t.sales)


@query("store_sales_by_payment", f"""
SELECT {LOC}, payment_method, COUNT(*) AS transaction_count, SUM(total_amount)::DOUBLE AS total_revenue FROM v_sales
GROUP BY location_id, payment_method""")
def _(t):
    return catalog.sales_by(t.sales, "payment_method", "transaction_count")


@query("store_sales_by_order_type", f"""
SELECT {LOC}, order_type, COUNT(*) AS order_count, SUM(total_amount)::DOUBLE AS total_revenue FROM v_sales
GROUP BY location_id, order_type""")
def _(t):
    return catalog.sales_by(t.sales, "order_type", "order_count")


@query("store_average_order_value", f"""
SELECT {LOC}, SUM(total_amount)::DOUBLE / COUNT(*) AS avg_order_value, COUNT(*) AS total_orders FROM v_sales GROUP BY location_id""")
def _(t):
    return catalog.order_value(t.sales)


@query("store_list_employees", f"SELECT {LOC}, name, role, CAST(hire_date AS VARCHAR) AS hire_date FROM v_labor")
def _(t):
    return catalog.employees(t.labor)


@query("store_count_employees", f"SELECT {LOC}, COUNT(*) AS total_employees FROM v_labor GROUP BY location_id")
def _(t):
    return catalog.employee_count(t.labor)


@query("store_employees_by_role", f"""
SELECT {LOC}, role, COUNT(*) AS employees, 0::BIGINT AS page, string_agg(name, ', ' ORDER BY name) AS employee_names
FROM v_labor GROUP BY location_id, role""")
def _(t):
    return catalog.employees_by_role(t.labor)


@query("store_search_employee", f"""
SELECT {LOC}, employee_id, name, role, CAST(hire_date AS VARCHAR) AS hire_date, hourly_rate::DOUBLE AS hourly_rate
FROM v_labor WHERE name ILIKE '%1%'""")
def _(t):
    return catalog.search(t.labor, "name", "1", "employee_id", "name", "role", "hire_date", "hourly_rate")


@query("store_new_hires", f"""
SELECT {LOC}, name, role, CAST(hire_date AS VARCHAR) AS hire_date FROM v_labor WHERE hire_date IS NOT NULL""")
def _(t):
    return catalog.new_hires(t.labor)


@query("store_sales_date_range", f"""
SELECT {TOTALS}, {AVERAGE} FROM v_sales WHERE date BETWEEN DATE '2000-03-15' AND DATE '2000-04-01' GROUP BY location_id""")
def _(t):
    return catalog.sales_in_range(t.sales, dt.date(2000, 4, 1), DAY)


@query("store_inventory_date_range", f"""
SELECT {LOC}, CAST(date AS VARCHAR) AS date, ingredient, quantity, par_level, is_low FROM v_inventory
WHERE date BETWEEN DATE '2024-02-01' AND DATE '2024-02-15'""")
def _(t):
    return catalog.rows_in_range(t.inventory, dt.date(2024, 2, 1), dt.date(2024, 2, 15), "date",
                                 "date", "ingredient", "quantity", "par_level", "is_low")


@query("store_menu_updated_date_range", f"""
SELECT {LOC}, menu_item, ingredient, amount::DOUBLE AS amount, unit_cost::DOUBLE AS unit_cost, CAST(updated_at AS VARCHAR) AS updated_at
FROM v_menu WHERE updated_at BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")
def _(t):
    return catalog.rows_in_range(t.menu, dt.date(2024, 1, 10), dt.date(2024, 1, 20), "updated_at",
                                 "menu_item", "ingredient", "amount", "unit_cost", "updated_at")


@query("store_employees_hired_date_range", f"""
SELECT {LOC}, employee_id, name, role, CAST(hire_date AS VARCHAR) AS hire_date FROM v_labor
WHERE hire_date BETWEEN DATE '2001-07-01' AND DATE '2001-12-31'""")
def _(t):
    return catalog.rows_in_range(t.labor, dt.date(2001, 7, 1), dt.date(2001, 12, 31), "hire_date",
                                 "employee_id", "name", "role", "hire_date")


@query("store_locations_of_one_region", f"""
SELECT {TOTALS} FROM v_sales WHERE location_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY location_id""")
def _(t):
    some = t.raw("nation").where(F.col("n_regionkey") == 2).select(F.col("n_nationkey").alias("location_id"))
    return catalog.sales_totals(catalog.of_locations(t.sales, some))


# -- by restaurant -------------------------------------------------------------------------------

@query("restaurant_count_inventory", """
SELECT r.name AS restaurant_name, COUNT(f.location_id) AS total_rows FROM v_restaurant r
LEFT JOIN v_inventory f ON r.id = f.location_id GROUP BY r.name""")
def _(t):
    return catalog.restaurant_inventory_rows(t.restaurants, t.inventory)


@query("restaurant_list_unique_ingredients", f"SELECT DISTINCT r.name AS restaurant_name, ingredient FROM v_inventory f {NAMED}")
def _(t):
    return catalog.restaurant_rows(t.restaurants, t.inventory, "ingredient").distinct()


@query("restaurant_list_all_ingredients", f"""
SELECT r.name AS restaurant_name, ingredient, quantity, unit_cost::DOUBLE AS unit_cost FROM v_inventory f {NAMED}
QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY ingredient, quantity, f.unit_cost) <= 100""")
def _(t):
    rows = t.inventory.select("location_id", "ingredient", "quantity", "unit_cost")
    first = catalog.first_rows(rows, 100, "ingredient", "quantity", "unit_cost")
    return catalog.restaurant_rows(t.restaurants, first, "ingredient", "quantity", "unit_cost")


@query("restaurant_ingredient_quantity_total", f"""
SELECT r.name AS restaurant_name, ingredient, SUM(quantity) AS total_quantity, COUNT(*) AS entry_count
FROM v_inventory f {NAMED} WHERE ingredient ILIKE '%brand#2%' GROUP BY 1, 2""")
def _(t):
    return catalog.ingredient_totals(t.restaurants, t.inventory, "Brand#2")


@query("restaurant_top_menu_items_by_sales", f"""
SELECT r.name AS restaurant_name, items_sold, COUNT(DISTINCT sale_id) AS times_ordered, SUM(number_of_items)::BIGINT AS total_quantity,
       SUM(subtotal)::DOUBLE AS total_revenue, SUM(subtotal)::DOUBLE / COUNT(*) AS avg_order_value
FROM v_sales f {NAMED} WHERE items_sold IS NOT NULL AND date >= DATE '2001-07-25' GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY r.name ORDER BY SUM(subtotal) DESC, items_sold) <= 3""")
def _(t):
    return catalog.best_item_texts(t.restaurants, t.sales, AS_OF)


@query("restaurant_low_stock", f"""
SELECT r.name AS restaurant_name, ingredient, quantity FROM v_inventory f {NAMED} WHERE alert = 'low'
QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY quantity, ingredient) <= 20""")
def _(t):
    return catalog.low_alerts(t.restaurants, t.inventory)


@query("restaurant_search_ingredient", f"""
SELECT r.name AS restaurant_name, ingredient, quantity, unit_cost::DOUBLE AS unit_cost FROM v_inventory f {NAMED}
WHERE ingredient ILIKE '%small%'
QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY ingredient, quantity, f.unit_cost) <= 10""")
def _(t):
    rows = t.inventory.where(catalog.like("ingredient", "small")).select("location_id", "ingredient", "quantity", "unit_cost")
    first = catalog.first_rows(rows, 10, "ingredient", "quantity", "unit_cost")
    return catalog.restaurant_rows(t.restaurants, first, "ingredient", "quantity", "unit_cost")


SUMS = """COUNT(sale_id) AS transaction_count, COALESCE(SUM(subtotal), 0)::DOUBLE AS total_subtotal,
  COALESCE(SUM(total_amount), 0)::DOUBLE AS total_amount, COALESCE(SUM(subtotal)::DOUBLE / COUNT(subtotal), 0) AS avg_subtotal"""


@query("restaurant_sales_on_date", f"""
SELECT r.name AS restaurant_name, {SUMS}, COALESCE(SUM(tip), 0)::DOUBLE AS total_tips FROM v_sales f {NAMED}
WHERE date = DATE '2000-03-15' GROUP BY 1""")
def _(t):
    return catalog.restaurant_sales(t.restaurants, periods.on_day(t.sales, DAY), keep_empty=False)


@query("restaurant_list_employee_names", f"""
SELECT r.name AS restaurant_name, f.name, position, role
FROM (SELECT DISTINCT location_id, name, position, role FROM v_labor) f {NAMED} WHERE f.name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY f.name, position NULLS FIRST, role NULLS FIRST) <= 100""")
def _(t):
    rows = t.labor.where(F.col("name").isNotNull()).select("location_id", "name", "position", "role").distinct()
    return catalog.restaurant_rows(t.restaurants, catalog.first_rows(rows, 100, "name", "position", "role"), "name", "position", "role")


@query("restaurant_employee_positions", f"""
SELECT r.name AS restaurant_name, f.name, COALESCE(position, role, 'No Position') AS position_role FROM v_labor f {NAMED}
QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY f.name NULLS FIRST, COALESCE(position, role, 'No Position')) <= 100""")
def _(t):
    rows = catalog.position_role(t.labor).select("location_id", "name", "position_role")
    return catalog.restaurant_rows(t.restaurants, catalog.first_rows(rows, 100, "name", "position_role"), "name", "position_role")


@query("restaurant_employee_hourly_rate", f"""
SELECT DISTINCT r.name AS restaurant_name, f.name, COALESCE(position, role) AS position, hourly_rate::DOUBLE AS hourly_rate
FROM v_labor f {NAMED} WHERE f.name ILIKE '%2%'""")
def _(t):
    return catalog.employee_rates(t.restaurants, t.labor, "2")


@query("restaurant_count_employees", """
SELECT r.name AS restaurant_name, COUNT(DISTINCT f.name) AS total_employees FROM v_restaurant r
LEFT JOIN v_labor f ON r.id = f.location_id GROUP BY 1""")
def _(t):
    return catalog.distinct_count(t.restaurants, t.labor, "name", "total_employees")


@query("restaurant_employees_by_position", """
SELECT r.name AS restaurant_name, COALESCE(position, role, 'No Position') AS position_role, COUNT(DISTINCT f.name) AS employee_count
FROM v_restaurant r LEFT JOIN v_labor f ON r.id = f.location_id GROUP BY 1, 2""")
def _(t):
    return catalog.distinct_count_by(
        t.restaurants, catalog.position_role(t.labor), "position_role", "name", "employee_count", "No Position")


@query("restaurant_list_menu_items", f"""
SELECT r.name AS restaurant_name, menu_item FROM (SELECT DISTINCT location_id, menu_item FROM v_menu) f {NAMED}
QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY menu_item) <= 100""")
def _(t):
    rows = t.menu.select("location_id", "menu_item").distinct()
    return catalog.restaurant_rows(t.restaurants, catalog.first_rows(rows, 100, "menu_item"), "menu_item")


@query("restaurant_menu_item_cost", f"""
SELECT DISTINCT r.name AS restaurant_name, menu_item, unit_cost::DOUBLE AS unit_cost, item_price::DOUBLE AS item_price,
       ROUND((item_price::DOUBLE - (amount * unit_cost)::DOUBLE) / item_price::DOUBLE * 100, 6) AS profit_margin
FROM v_menu f {NAMED} WHERE menu_item ILIKE '%hot%'""")
def _(t):
    rows = t.menu.where(catalog.like("menu_item", "hot")).withColumn("profit_margin", F.round("profit_margin", 6))
    return catalog.restaurant_rows(t.restaurants, rows, "menu_item", "unit_cost", "item_price", "profit_margin").distinct()


@query("restaurant_menu_item_ingredients", f"""
SELECT DISTINCT r.name AS restaurant_name, menu_item, ingredient FROM v_menu f {NAMED} WHERE menu_item ILIKE '%cold%'""")
def _(t):
    rows = t.menu.where(catalog.like("menu_item", "cold"))
    return catalog.restaurant_rows(t.restaurants, rows, "menu_item", "ingredient").distinct()


@query("restaurant_count_menu_items", """
SELECT r.name AS restaurant_name, COUNT(DISTINCT menu_item) AS total_items FROM v_restaurant r
LEFT JOIN v_menu f ON r.id = f.location_id GROUP BY 1""")
def _(t):
    return catalog.distinct_count(t.restaurants, t.menu, "menu_item", "total_items")


@query("restaurant_menu_by_category", """
SELECT r.name AS restaurant_name, COALESCE(category, 'No Category') AS category, COUNT(DISTINCT menu_item) AS item_count
FROM v_restaurant r LEFT JOIN v_menu f ON r.id = f.location_id GROUP BY 1, 2""")
def _(t):
    return catalog.distinct_count_by(t.restaurants, t.menu, "category", "menu_item", "item_count", "No Category")


@query("restaurant_total_sales", f"""
SELECT r.name AS restaurant_name, {SUMS} FROM v_restaurant r LEFT JOIN v_sales f ON r.id = f.location_id GROUP BY 1""")
def _(t):
    return catalog.restaurant_sales(t.restaurants, t.sales).drop("total_tips")


@query("restaurant_sales_by_payment", """
SELECT r.name AS restaurant_name, COALESCE(payment_method, 'No Data') AS payment_method, COUNT(sale_id) AS transaction_count,
       COALESCE(SUM(subtotal), 0)::DOUBLE AS total_subtotal FROM v_restaurant r LEFT JOIN v_sales f ON r.id = f.location_id GROUP BY 1, 2""")
def _(t):
    return catalog.restaurant_sales_by(t.restaurants, t.sales, "payment_method", "transaction_count")


@query("restaurant_sales_by_order_type", """
SELECT r.name AS restaurant_name, COALESCE(order_type, 'No Data') AS order_type, COUNT(sale_id) AS order_count,
       COALESCE(SUM(subtotal), 0)::DOUBLE AS total_subtotal FROM v_restaurant r LEFT JOIN v_sales f ON r.id = f.location_id GROUP BY 1, 2""")
def _(t):
    return catalog.restaurant_sales_by(t.restaurants, t.sales, "order_type", "order_count")


@query("restaurant_top_selling_items", f"""
SELECT r.name AS restaurant_name, items_sold, COUNT(*) AS times_ordered, SUM(number_of_items)::BIGINT AS total_quantity
FROM v_sales f {NAMED} WHERE items_sold IS NOT NULL GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY r.name ORDER BY COUNT(*) DESC, items_sold) <= 20""")
def _(t):
    return catalog.frequent_item_texts(t.restaurants, t.sales)


@query("restaurant_average_tip", f"""
SELECT r.name AS restaurant_name, SUM(tip)::DOUBLE / COUNT(*) AS avg_tip, SUM(tip)::DOUBLE AS total_tips
FROM v_sales f {NAMED} WHERE tip > 0 GROUP BY 1""")
def _(t):
    return catalog.average_tip(t.restaurants, t.sales)


def _column(name, question, table, view, value, bounds):
    a, b = bounds

    @query(name, f"""
SELECT {LOC}, CAST(date AS VARCHAR) AS date, {value}::DOUBLE AS value FROM {view}
WHERE date BETWEEN DATE '{a}' AND DATE '{b}'""")
    def _(t):
        df = getattr(t, table)
        return catalog.column_by_date(df, catalog.column_for(question, table), bounds)


_column("column_sales_date_range", "show tips for these days", "sales", "v_sales", "tip", (DAY, dt.date(2000, 4, 1)))
_column("column_sales_single_date", "what was the revenue that day", "sales", "v_sales", "total_amount", (DAY, DAY))
_column("column_inventory_date_range", "par level over time", "inventory", "v_inventory", "par_level",
        (dt.date(2024, 2, 5), dt.date(2024, 2, 20)))
_column("column_inventory_single_date", "how much was there", "inventory", "v_inventory", "quantity",
        (dt.date(2024, 2, 19), dt.date(2024, 2, 19)))
_column("column_menu_date_range", "selling price", "menu", "v_menu", "item_price", (dt.date(2024, 1, 5), dt.date(2024, 1, 12)))
_column("column_menu_single_date", "unit cost", "menu", "v_menu", "unit_cost", (dt.date(2024, 1, 9), dt.date(2024, 1, 9)))
_column("column_labor_date_range", "hourly rate", "labor", "v_labor", "hourly_rate", (dt.date(2001, 7, 20), AS_OF))
_column("column_labor_single_date", "who worked", "labor", "v_labor", "hours_worked", (AS_OF, AS_OF))


PATTERNS = [
    ("kpi_reader", ["reader", "ent"], True),
    ("greeting", ["the", "and "], False),
    ("thanks", ["ou", "on"], False),
]


@query("join_question_to_catalog", """
SELECT conv_id, turn, CASE WHEN contains(x, 'the') OR contains(x, 'and ') THEN 'greeting'
       WHEN contains(x, 'reader') OR contains(x, 'ent') THEN 'kpi_reader'
       WHEN contains(x, 'ou') OR contains(x, 'on') THEN 'thanks' END AS prompt_id
FROM (SELECT *, lower(trim(text)) AS x FROM conversations)""")
def _(t):
    order = [PATTERNS[1], PATTERNS[0], PATTERNS[2]]
    return catalog.match_questions(t.raw("conversations"), "text", order).select("conv_id", "turn", "prompt_id")


@query("join_question_to_kpi_first", """
SELECT doc_id, CASE WHEN contains(x, 'last week') OR contains(x, 'last month') OR contains(x, 'overall') OR contains(x, 'this year')
         OR contains(x, 'past week') OR contains(x, 'this week') OR contains(x, 'last 15 days') OR contains(x, 'past 15 days')
         OR contains(x, 'last fifteen days') OR contains(x, 'past month') OR contains(x, 'this month')
         OR contains(x, 'last 6 months') OR contains(x, 'past 6 months') OR contains(x, 'last six months')
         OR contains(x, 'last year') OR contains(x, 'past year') OR contains(x, 'all time') THEN
           CASE WHEN contains(x, 'ent') THEN 'kpi_reader' WHEN contains(x, 'the') THEN 'greeting' END
       WHEN contains(x, 'the') THEN 'greeting' WHEN contains(x, 'ent') THEN 'kpi_reader' END AS prompt_id
FROM (SELECT *, lower(trim(text)) AS x FROM documents)""")
def _(t):
    known = [("greeting", ["the"], False), ("kpi_reader", ["ent"], True)]
    return catalog.match_questions(t.raw("documents"), "text", known).select("doc_id", "prompt_id")


PERIODS = " OR ".join(f"contains(x, '{w}')" for w in catalog.PERIOD_WORDS)


@query("question_catalog_automaton", f"""
, v_word AS (
  SELECT word, row_number() OVER (ORDER BY word) AS position
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS word FROM benchmark)),
v_question AS (
  SELECT *, ({PERIODS}) AS timed FROM (
    SELECT row_number() OVER () AS row, conv_id, turn, lower(trim(text || CASE WHEN turn % 3 = 1 THEN ' this week' ELSE '' END)) AS x FROM conversations)),
v_hit AS (
  SELECT row, min(position) AS first, min(position) FILTER (position % 5 = 0) AS kpi, min(position) FILTER (position % 7 != 0) AS stays
  FROM v_question JOIN v_word ON contains(x, word) GROUP BY row)
SELECT conv_id, turn, word AS prompt_id FROM v_question LEFT JOIN v_hit USING (row)
LEFT JOIN v_word ON position = CASE WHEN timed THEN coalesce(kpi, stays) ELSE first END""")
def _(t):
    words = t.raw("benchmark").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})")))).alias("pattern")).distinct()
    place = F.row_number().over(Window.orderBy("pattern"))  # the words of the benchmark, a parameter list
    patterns = words.select("pattern", F.col("pattern").alias("prompt_id"), place.alias("position")).select(
        "*", (F.col("position") % 5 == 0).alias("is_kpi"), (F.col("position") % 7 == 0).alias("skip_with_period"))
    asked = t.raw("conversations").withColumn("text", F.concat("text", F.when(F.col("turn") % 3 == 1, " this week").otherwise("")))
    return question_index.match(asked, "text", patterns).select("conv_id", "turn", "prompt_id")


# -- cleaning ------------------------------------------------------------------------------------

@query("clean_dates", """
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN d
         WHEN day(d) <= 12 AND o_orderkey % 3 = 2 THEN make_date(year(d), day(d), month(d)) ELSE d END AS VARCHAR) AS day
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(t):
    # three spellings of the same days; month-first text reads day-first where both fit
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    raw = F.when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(d, "dd/MM/yyyy")).otherwise(
        F.date_format(d, "MM/dd/yyyy"))
    return t.raw("orders").select(k, clean.parse_date(raw).alias("day"))


@query("clean_short_dates", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""")
def _(t):
    return t.raw("orders").select("o_orderkey", clean.parse_date(F.date_format("o_orderdate", "MM/dd/yy"), clean.SHORT_DATE_FORMS).alias("day"))


@query("clean_hours", "SELECT event_id, hour(ts)::BIGINT AS hour FROM events")
def _(t):
    return t.raw("events").select("event_id", clean.parse_hour(F.date_format("ts", "HH:mm:ss")).alias("hour"))


@query("clean_numbers", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(value AS DECIMAL(18,2)) END::DOUBLE AS amount FROM events""")
def _(t):
    raw = F.when(F.col("event_type") == "error", "abc").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return t.raw("events").select("event_id", numbers.number_or_zero(raw).alias("amount"))


@query("clean_booleans", """
SELECT event_id, event_type IN ('view', 'click', 'error') AS flag FROM events""")
def _(t):
    word = (F.when(F.col("event_type") == "view", " yes").when(F.col("event_type") == "click", "1")
            .when(F.col("event_type") == "error", "True").when(F.col("event_type") == "signup", "x"))
    return t.raw("events").select("event_id", clean.parse_bool(word).alias("flag"))


@query("clean_defaults", """
SELECT doc_id, CASE WHEN lang = 'en' THEN 'Unknown' ELSE lang END AS lang FROM documents""")
def _(t):
    padded = F.when(F.col("lang") != "en", F.concat(F.lit("  "), F.col("lang"), F.lit(" ")))
    return t.raw("documents").select("doc_id", clean.text_or(padded, "Unknown").alias("lang"))


@query("clean_item_lists", """
SELECT sale_id, number_of_items::BIGINT AS items, items_sold AS joined FROM v_sales WHERE items_sold IS NOT NULL""")
def _(t):
    # half of the lists as JSON text, half with semicolons and stray blanks
    text = F.when(F.col("sale_id") % 2 == 0, F.to_json("items")).otherwise(F.regexp_replace("items_sold", ";", " ; ; "))
    parsed = t.sales.where(F.col("items_sold").isNotNull()).select("sale_id", items.parse_items(text).alias("p"))
    return parsed.select("sale_id", F.size("p").alias("items"), F.array_join("p", ";").alias("joined"))


@query("clean_position_or_role", f"""
SELECT {LOC}, employee_id, CASE WHEN position = 'Cook' THEN role ELSE position END AS position FROM v_labor""")
def _(t):
    position = F.when(F.col("position") != "Cook", F.col("position"))
    return t.labor.select("location_id", "employee_id", clean.position_or_role(position, F.col("role")).alias("position"))


@query("derive_inventory_value", f"""
SELECT {LOC}, ingredient, total_value::DOUBLE AS total_value, quantity / par_level AS inventory_ratio, alert FROM v_inventory""")
def _(t):
    return t.inventory.select("location_id", "ingredient", "total_value", "inventory_ratio", "alert")


@query("derive_menu_margin", f"""
SELECT {LOC}, ingest_seq, (amount * unit_cost)::DOUBLE AS total_cost,
       ROUND((item_price::DOUBLE - (amount * unit_cost)::DOUBLE) / item_price::DOUBLE * 100, 6) AS profit_margin FROM v_menu""")
def _(t):
    return t.menu.select("location_id", "ingest_seq", "total_cost", F.round("profit_margin", 6).alias("profit_margin"))


@query("derive_labor_wages", f"""
SELECT {LOC}, employee_id, (hourly_rate * CAST(hours_worked AS DECIMAL(10,2)))::DOUBLE AS total_wages,
       hours_worked > 8 AS is_overtime, GREATEST(0, hours_worked - 8) AS overtime_hours FROM v_labor""")
def _(t):
    raw = t.labor.drop("overtime_hours").withColumn("overtime_hours", F.lit(None).cast("double")).withColumn(
        "is_overtime", F.lit(None).cast("boolean"))
    return silver.derive_labor(raw).select("location_id", "employee_id", "total_wages", "is_overtime", "overtime_hours")


@query("derive_discount_applied", """
SELECT sale_id, CASE WHEN discount_percent > 0
         THEN CAST(subtotal * CAST(discount_percent AS DECIMAL(7,2)) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(18,2)) ELSE 0 END::DOUBLE AS discount_applied
FROM v_sales""")
def _(t):
    pct = F.coalesce("discount_percent", F.lit(0))
    return t.sales.select("sale_id", silver.discount_applied(F.col("subtotal"), pct).alias("discount_applied"))


@query("derive_pos_sales", """
SELECT sale_id, CASE WHEN subtotal > 0 THEN ROUND(promos::DOUBLE / subtotal::DOUBLE * 100, 2) ELSE 0.0 END::DOUBLE AS discount_percent,
       CASE WHEN is_void THEN total_amount ELSE 0 END::DOUBLE AS voids,
       CASE WHEN NOT is_void AND total = 0 AND subtotal > 0 THEN subtotal ELSE 0 END::DOUBLE AS comps,
       promos::DOUBLE AS promos, CASE WHEN covers = 4 THEN 1 ELSE covers END::BIGINT AS covers, subtotal::DOUBLE AS gross_sales
FROM (SELECT *, voids > 0 AS is_void, CASE WHEN comps = 2 THEN 0 ELSE total_amount END AS total FROM v_sales)""")
def _(t):
    zero = F.lit(0).cast("decimal(18,2)")
    total = F.when((F.col("comps") == 2) & (F.col("voids") == 0), zero).otherwise(F.col("total_amount"))
    rows = t.sales.select(
        "sale_id", "subtotal", F.col("promos").alias("discount"), (F.col("voids") > 0).alias("is_void"),
        total.alias("total_amount"), F.when(F.col("covers") != 4, F.col("covers")).otherwise(0).alias("covers"))
    return silver.adapt_pos_sales(rows).drop("subtotal", "total_amount")


@query("derive_pos_labor", f"""
SELECT {LOC}, employee_id, role = 'manager' AS is_salaried, CASE WHEN role = 'manager' THEN 160.0 ELSE 120.0 END::DOUBLE AS hours_worked
FROM v_labor WHERE termination_date IS NULL""")
def _(t):
    rows = t.labor.drop("is_salaried", "hours_worked")
    return silver.adapt_pos_labor(rows, AS_OF).select("location_id", "employee_id", "is_salaried", "hours_worked")


@query("derive_salaried_by_position", f"""
SELECT {LOC}, employee_id, position ILIKE '%manager%' OR position ILIKE '%chef%' AS is_salaried FROM v_labor""")
def _(t):
    return silver.salaried_by_position(t.labor).select("location_id", "employee_id", "is_salaried")


@query("derive_rounded_numbers", """
SELECT event_id, ROUND(value / 3, 2) AS third, event_type FROM events""")
def _(t):
    return numbers.rounded(t.raw("events").select("event_id", (F.col("value") / 3).alias("third"), "event_type"))


@query("source_item_shares", """
SELECT sale_id, SUM(revenue)::DOUBLE AS revenue, COUNT(*) AS items FROM v_items GROUP BY sale_id""")
def _(t):
    return items.sold_items(t.sales, "sale_id").groupBy("sale_id").agg(
        F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("items"))


@query("join_first_directory_row", f"""
SELECT location_id::BIGINT AS location_id, employee_id, name FROM v_labor""")
def _(t):
    twice = t.labor.unionByName(t.labor.withColumn("name", F.concat("name", F.lit("~"))))
    return efficiency.first_per_employee(twice, "name").select("location_id", "employee_id", "name")


# -- sources and sinks ----------------------------------------------------------------------------

@query("source_scan_of_days", f"""
SELECT {LOC}, sale_id, total_amount::DOUBLE AS total_amount FROM v_sales WHERE location_id IN (3, 7)
  AND date BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'""")
def _(t):
    path = t.sales.inputFiles()[0].rsplit("/", 1)[0]
    return tables.scan(t.spark, path, ["location_id", "sale_id", "total_amount"], [3, 7], dt.date(2000, 1, 1), dt.date(2000, 6, 30))


@query("source_union_by_name", """
SELECT c_name AS name, 'customer' AS kind, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_name, 'supplier', NULL FROM supplier""")
def _(t):
    a = t.raw("customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"))
    b = t.raw("supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@query("source_json_orders", f"""
SELECT p.{LOC}, p.order_id::VARCHAR AS order_id, CAST(p.order_date AS VARCHAR) AS order_date, p.total::DOUBLE AS total,
       COALESCE(i.n, 0) AS items, COALESCE(i.q, 0)::BIGINT AS quantity
FROM v_pos p LEFT JOIN (SELECT order_id, COUNT(*) AS n, SUM(quantity) AS q FROM v_pos_items GROUP BY 1) i ON p.order_id = i.order_id""")
def _(t):
    # the three payload shapes, written from the stored orders
    one = F.to_json(F.struct(
        F.col("order_id").cast("string").alias("id"), F.col("order_date").cast("string").alias("order_date"),
        F.col("order_ts").cast("string").alias("order_ts"), F.col("total").cast("double").alias("total"), "items"))
    k = F.col("order_id") % 3
    payload = F.when(k == 0, F.concat(F.lit('{"result": ['), one, F.lit("]}"))).when(
        k == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one)
    landed = t.pos_orders.select("location_id", payload.alias("payload"), F.lit("").alias("path"))
    orders = pos_json.orders(landed, F.col("location_id"), F.lit("2024-01-01").cast("timestamp"))
    units = F.aggregate(F.transform("items", lambda i: i["quantity"].cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return orders.select(
        "location_id", "order_id", "order_date", "total", F.coalesce(F.size("items"), F.lit(0)).alias("items"),
        F.coalesce(units, F.lit(0)).alias("quantity"))


@query("source_file_profile", """
SELECT source AS filename, COUNT(*) AS rows, 3::BIGINT AS columns FROM documents GROUP BY source""")
def _(t):
    return csv_files.file_profile(t.raw("documents").select("doc_id", "text", "lang", F.col("source").alias("filename")))


@query("source_file_preview", """
SELECT source AS filename, doc_id, rank FROM (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 5""")
def _(t):
    return csv_files.preview(t.raw("documents").select("doc_id", F.col("source").alias("filename")), "doc_id")


@query("sink_keep_latest", """
SELECT user_id, type, id, is_read, CAST(created_at AS VARCHAR) AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, type ORDER BY created_at DESC, id DESC) AS r FROM v_notification) WHERE r = 1""")
def _(t):
    return sinks.latest(t.notifications.select("user_id", "type", "id", "is_read", "created_at"), ["user_id", "type"], ["created_at", "id"])


@query("sink_insert_new_keys", """
SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_orderkey = l.l_orderkey AND r.l_linenumber = l.l_linenumber)""")
def _(t):
    keys = ["l_orderkey", "l_linenumber"]
    lines = t.raw("lineitem").select(*keys, "l_returnflag")
    return sinks.new_rows(lines.select(*keys), lines.where(F.col("l_returnflag") == "R").select(*keys), keys)


@query("sink_retention", f"""
SELECT {LOC}, sale_id, CAST(date AS VARCHAR) AS date FROM v_sales WHERE date >= DATE '2001-08-01' - 30""")
def _(t):
    return tables.kept(t.sales, AS_OF).select("location_id", "sale_id", "date")


@query("sink_delete_by_key", """
SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (
  SELECT 1 FROM documents g WHERE g.n_chars > 5000 AND g.lang = d.lang AND g.source = d.source)""")
def _(t):
    docs = t.raw("documents").select("doc_id", "lang", "source", "n_chars")
    return tables.without_keys(docs.drop("n_chars"), docs.where(F.col("n_chars") > 5000), ["lang", "source"])


@query("clean_header_aliases", """
SELECT o_orderkey::VARCHAR AS sale_id, o_orderpriority AS payment_method, CAST(NULL AS VARCHAR) AS covers FROM orders""")
def _(t):
    raw = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("Sale ID"), F.col("o_orderpriority").alias("Payment Method"))
    return clean.aliased(raw, schemas.SALES_HEADERS).select("sale_id", "payment_method", "covers")


@query("clean_first_present_column", """
SELECT c_custkey AS customer_id, c_name AS name FROM customer""")
def _(t):
    raw = t.raw("customer").select("c_custkey", F.col("c_name").alias("CustomerName"), F.lit("-").alias("other"))
    named = clean.first_present(raw, {"name": ["Name", "name", "CustomerName"], "customer_id": ["Customer ID", "c_custkey"]})
    return named.select("customer_id", "name")


# -- bundles -------------------------------------------------------------------------------------

ALL = NET + INGREDIENT_COST + """, v_cogs AS (SELECT location_id, 'Food' AS category, SUM(cost) AS cogs FROM v_ingredient_cost GROUP BY 1),
v_all AS (
  SELECT location_id, 'total_sales' AS kpi, 'total' AS metric, SUM(subtotal)::DOUBLE AS value, true AS valid FROM v_sales GROUP BY 1
  UNION ALL SELECT location_id, 'net_revenue', 'total', net_revenue::DOUBLE, true FROM v_net2
  UNION ALL SELECT n.location_id, 'splh', 'value', ROUND(net_revenue, 2)::DOUBLE / NULLIF(h, 0),
                   ROUND(net_revenue, 2)::DOUBLE / NULLIF(h, 0) IS NOT NULL
            FROM v_net2 n LEFT JOIN (SELECT location_id, SUM(hours_worked) AS h FROM v_labor WHERE NOT is_salaried GROUP BY 1) l
              ON n.location_id = l.location_id
  UNION ALL SELECT location_id, 'guest_count', 'covers', SUM(covers)::DOUBLE, true FROM v_sales GROUP BY 1
  UNION ALL SELECT n.location_id, 'avg_check', 'value', net_revenue::DOUBLE / g, true
            FROM v_net2 n JOIN (SELECT location_id, SUM(covers) AS g FROM v_sales GROUP BY 1) q ON n.location_id = q.location_id
  UNION ALL SELECT location_id, 'top_items', menu_item, units::DOUBLE, true
            FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY units DESC, menu_item) AS r FROM v_base) WHERE r <= 10
  UNION ALL SELECT location_id, 'gross_profit_per_item', menu_item, gross_profit::DOUBLE, true FROM v_profit
  UNION ALL SELECT location_id, 'food_cost_pct', 'value', SUM(cost)::DOUBLE / SUM(revenue)::DOUBLE * 100,
                   SUM(cost)::DOUBLE / SUM(revenue)::DOUBLE * 100 BETWEEN 0 AND 100 FROM v_profit GROUP BY 1
  UNION ALL SELECT location_id, 'cogs_by_category', category, cogs::DOUBLE, true FROM v_cogs
  UNION ALL SELECT location_id, 'total_cogs', 'total', cogs::DOUBLE, true FROM v_cogs
  UNION ALL SELECT s.location_id, 'inventory_turnover', 'value', cogs::DOUBLE / (v::DOUBLE / n), cogs::DOUBLE / (v::DOUBLE / n) BETWEEN 0 AND 100
            FROM (SELECT location_id, SUM(CAST(quantity AS DECIMAL(14,3)) * unit_cost) AS v, COUNT(*) AS n FROM v_inventory GROUP BY 1) s
            JOIN v_cogs c ON s.location_id = c.location_id
  UNION ALL SELECT location_id, 'low_inventory_warnings', 'low_items', (COUNT(*) FILTER (quantity <= par_level))::DOUBLE, true FROM v_inventory GROUP BY 1
  UNION ALL SELECT location_id, 'labor_hours_by_role', COALESCE(position, 'total'), SUM(hours_worked), true FROM v_labor
            GROUP BY GROUPING SETS ((location_id, position), (location_id))
  UNION ALL SELECT location_id, 'overtime_pct', COALESCE(position, 'total'), SUM(overtime_hours) / SUM(hours_worked) * 100, true
            FROM v_labor WHERE NOT is_salaried GROUP BY GROUPING SETS ((location_id, position), (location_id))
  UNION ALL SELECT location_id, 'popularity_vs_profitability', quadrant, COUNT(*)::DOUBLE, true
            FROM (SELECT p.location_id, CASE WHEN units >= mu AND gross_profit::DOUBLE >= mp THEN 'STAR' WHEN units >= mu THEN 'PLOW HORSE'
                         WHEN gross_profit::DOUBLE >= mp THEN 'PUZZLE' ELSE 'DOG' END AS quadrant
                  FROM v_profit p JOIN (SELECT location_id, median(units::DOUBLE) AS mu, median(gross_profit::DOUBLE) AS mp FROM v_profit GROUP BY 1) m
                    ON p.location_id = m.location_id) GROUP BY 1, 3
  UNION ALL SELECT location_id, 'rows', 'sales', COUNT(*)::DOUBLE, true FROM v_sales GROUP BY 1
  UNION ALL SELECT location_id, 'rows', 'inventory', COUNT(*)::DOUBLE, true FROM v_inventory GROUP BY 1
  UNION ALL SELECT location_id, 'rows', 'menu', COUNT(*)::DOUBLE, true FROM v_menu GROUP BY 1
  UNION ALL SELECT location_id, 'rows', 'labor', COUNT(*)::DOUBLE, true FROM v_labor GROUP BY 1)
"""


def _all(t):
    return bundles.all_kpis(t.sales, t.inventory, t.menu, t.labor)


NAMES = ("total_sales net_revenue splh guest_count avg_check top_items gross_profit_per_item food_cost_pct cogs_by_category "
         "inventory_turnover popularity_vs_profitability labor_hours_by_role overtime_pct low_inventory_warnings table_turn_time "
         "kds_ticket_time order_accuracy_rate seasonal_sales promo_roi dish_waste_pct total_cogs").split()


@query("kpi_availability", ALL + f"""
SELECT l.location_id::BIGINT AS location_id, n.kpi_number::BIGINT AS kpi_number, n.kpi, COALESCE(a.is_available, false) AS is_available,
       COALESCE(a.validation_passed, false) AS validation_passed, COALESCE(a.has_data, false) AS has_data
FROM (SELECT DISTINCT location_id FROM v_all) l
CROSS JOIN (SELECT unnest({NAMES!r}) AS kpi, generate_subscripts({NAMES!r}, 1) AS kpi_number) n
LEFT JOIN (SELECT location_id, kpi, true AS is_available, bool_and(valid) AS validation_passed, bool_or(value IS NOT NULL) AS has_data
           FROM v_all GROUP BY 1, 2) a ON a.location_id = l.location_id AND a.kpi = n.kpi""")
def _(t):
    return bundles.kpi_availability(_all(t))


@query("dash_bundle_headlines", f"""
SELECT s.*, l.mean_hourly_rate, v.stock_value, c.revenue, c.cogs, c.gross_profit, c.food_cost_pct FROM (
  SELECT {LOC}, SUM(total_amount)::DOUBLE AS total_revenue, SUM(total_amount)::DOUBLE / COUNT(*) AS average_order_value,
         SUM(total_amount)::DOUBLE / COUNT(DISTINCT sale_id) AS average_check,
         SUM(number_of_items)::DOUBLE / COUNT(*) AS upselling_rate FROM v_sales GROUP BY location_id) s
LEFT JOIN (SELECT location_id, SUM(hourly_rate)::DOUBLE / COUNT(*) AS mean_hourly_rate FROM v_labor GROUP BY 1) l ON s.location_id = l.location_id
LEFT JOIN (SELECT location_id, SUM(CAST(quantity AS DECIMAL(14,3)) * unit_cost)::DOUBLE AS stock_value FROM v_inventory GROUP BY 1) v ON s.location_id = v.location_id
LEFT JOIN (SELECT location_id, SUM(sub_revenue)::DOUBLE AS revenue, SUM(cost)::DOUBLE AS cogs, (SUM(sub_revenue) - SUM(cost))::DOUBLE AS gross_profit,
                  SUM(cost)::DOUBLE / SUM(sub_revenue)::DOUBLE * 100 AS food_cost_pct FROM v_stats GROUP BY 1) c ON s.location_id = c.location_id""")
def _(t):
    return bundles.bundle_headlines(bundles.dashboard_bundle(t.sales, t.menu, t.inventory, t.labor, "widget"))


# -- whole results -------------------------------------------------------------------------------

# stock without sales turns over 0 times, as kpi_inventory_turnover has it
WHOLE = ALL.replace("cogs::DOUBLE / (v::DOUBLE / n)", "COALESCE(cogs, 0)::DOUBLE / (v::DOUBLE / n)").replace(
    "JOIN v_cogs c ON s.location_id", "LEFT JOIN v_cogs c ON s.location_id")
WARNED = f"""SELECT {LOC}, kpi, metric, value, valid,
       CASE WHEN kpi = 'total_sales' AND value < 0 THEN 'total is negative' WHEN kpi = 'overtime_pct' AND value > 100 THEN 'overtime exceeds hours'
            WHEN kpi = 'overtime_pct' AND value > 50 THEN 'overtime share is high' END AS warning FROM v_all"""


def _of_days(name: str, first: str, last: str) -> None:
    """The query's sales and labor are those of the days."""
    for view in ("v_sales", "v_labor"):
        head, tail = SQL[name].split(f"\n{view} AS (", 1)
        body, rest = tail.split("),\nv_", 1)
        SQL[name] = (f"{head}\n{view}_any AS ({body}),\n{view} AS (SELECT * FROM {view}_any "
                     f"WHERE date BETWEEN DATE '{first}' AND DATE '{last}'),\nv_{rest}")


@query("kpi_all_whole", WHOLE + WARNED)
def _(t):
    return _all(t)


@query("kpi_all_last_year_whole", WHOLE + WARNED)
def _(t):
    return bundles.all_kpis(t.sales, t.inventory, t.menu, t.labor, "Last_year", AS_OF)


@query("kpi_all_of_a_date_range_whole", WHOLE + WARNED)
def _(t):
    return bundles.all_kpis(t.sales, t.inventory, t.menu, t.labor, bounds=(dt.date(2000, 3, 1), dt.date(2000, 3, 20)))


_of_days("kpi_all_last_year_whole", "2000-08-01", "2001-08-01")
_of_days("kpi_all_of_a_date_range_whole", "2000-03-01", "2000-03-20")


@query("question_answers_whole", WHOLE + f"""
SELECT n_nationkey::BIGINT AS location_id, 'Show the ' || replace(a.kpi, '_', ' ') AS question, a.kpi AS prompt_id, a.metric, a.value, a.valid, a.warning
FROM nation JOIN ({WARNED}) a ON a.location_id = n_nationkey WHERE a.kpi IN {kpi.KPI_NAMES!r}""")
def _(t):
    asks = F.explode(F.array(*[F.lit("Show the " + n.replace("_", " ")) for n in kpi.KPI_NAMES]))
    asked = t.raw("nation").select(F.col("n_nationkey").alias("location_id"), asks.alias("question"))
    return catalog.answers(asked, "question", _all(t), catalog.kpi_catalog(kpi.KPI_NAMES))


for _name in ("kpi_all", "kpi_all_last_year", "kpi_all_of_a_date_range", "question_answers"):  # both names give the whole result
    QUERIES[_name], SQL[_name] = QUERIES[f"{_name}_whole"], SQL[f"{_name}_whole"]
