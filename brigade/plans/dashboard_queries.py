"""Dashboard figures over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brigade.functions import periods
from brigade.operators import anomaly, dashboard, silver
from brigade.plans.registry import query
from brigade.plans.views import AS_OF

LOC = "location_id::BIGINT AS location_id"


@query("dash_revenue_and_order_value", f"""
SELECT {LOC}, SUM(total_amount)::DOUBLE AS total_revenue,
       SUM(total_amount)::DOUBLE / COUNT(total_amount) AS average_order_value FROM v_sales GROUP BY location_id""")
def _(t):
    return dashboard.revenue_and_order_value(t.sales)


@query("dash_average_check_by_sale", f"""
SELECT {LOC}, SUM(a)::DOUBLE / COUNT(*) AS average_check
FROM (SELECT location_id, sale_id, SUM(total_amount) AS a FROM v_sales GROUP BY 1, 2) GROUP BY location_id""")
def _(t):
    return dashboard.average_check_by_sale(t.sales)


@query("dash_upselling_rate", f"""
SELECT {LOC}, SUM(number_of_items)::DOUBLE / COUNT(*) AS upselling_rate FROM v_sales GROUP BY location_id""")
def _(t):
    return dashboard.upselling_rate(t.sales)


@query("dash_daily_specials", f"""
SELECT {LOC}, CAST(date AS VARCHAR) AS date, SUM(total_amount)::DOUBLE AS total_amount FROM v_sales
WHERE lower(items_sold) LIKE '%widget%' GROUP BY location_id, date""")
def _(t):
    return dashboard.daily_specials(t.sales, "Widget")


@query("dash_best_special_days", f"""
SELECT {LOC}, CAST(date AS VARCHAR) AS date, total_amount::DOUBLE AS total_amount, rank
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY total_amount DESC, date) AS rank
      FROM (SELECT location_id, date, SUM(total_amount) AS total_amount FROM v_sales
            WHERE lower(items_sold) LIKE '%widget%' GROUP BY 1, 2)) WHERE rank <= 10""")
def _(t):
    return dashboard.best_special_days(t.sales, "widget")


@query("dash_item_counts", f"""
SELECT {LOC}, menu_item, units, rank
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY units DESC, menu_item) AS rank FROM v_base)
WHERE rank <= 5""")
def _(t):
    return dashboard.item_counts(t.sales)


@query("dash_stock_value", f"""
SELECT {LOC}, SUM(CAST(quantity AS DECIMAL(14,3)) * unit_cost)::DOUBLE AS stock_value FROM v_inventory GROUP BY location_id""")
def _(t):
    return dashboard.stock_value(t.inventory)


@query("dash_low_stock_alerts", f"""
SELECT {LOC}, rank, ingredient, quantity, par_level
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY quantity, ingredient, date) AS rank
      FROM v_inventory WHERE quantity <= par_level) WHERE rank <= 10""")
def _(t):
    return dashboard.low_stock_alerts(t.inventory)


@query("dash_available_quantity", f"""
SELECT {LOC}, ingredient, SUM(quantity) AS quantity FROM v_inventory GROUP BY location_id, ingredient""")
def _(t):
    return dashboard.available_quantity(t.inventory)


@query("dash_menu_revisions", f"""
SELECT {LOC}, menu_item, ingredient, CAST(MIN(created_at) AS VARCHAR) AS first_entry,
       CAST(MAX(created_at) AS VARCHAR) AS last_entry
FROM v_menu GROUP BY location_id, menu_item, ingredient HAVING MIN(created_at) <> MAX(created_at)""")
def _(t):
    return dashboard.menu_revisions(t.menu)


@query("dash_mean_hourly_rate", f"""
SELECT {LOC}, SUM(hourly_rate)::DOUBLE / COUNT(*) AS mean_hourly_rate FROM v_labor GROUP BY location_id""")
def _(t):
    return dashboard.mean_hourly_rate(t.labor)


@query("dash_labor_cost_pct", """
SELECT s.location_id::BIGINT AS location_id, orders, revenue::DOUBLE AS revenue,
       orders * 8.0::DOUBLE * COALESCE(rate, 0) / revenue::DOUBLE * 100 AS labor_cost_pct
FROM (SELECT location_id, COUNT(*) AS orders, SUM(total_amount) AS revenue FROM v_sales GROUP BY location_id) s
LEFT JOIN (SELECT location_id, SUM(hourly_rate)::DOUBLE / COUNT(*) AS rate FROM v_labor WHERE hourly_rate <> 0
           GROUP BY location_id) l ON s.location_id = l.location_id""")
def _(t):
    return dashboard.labor_cost_pct(t.sales, t.labor)


RANKED = """SELECT location_id::BIGINT AS location_id, rank, menu_item, units, ROUND(revenue, 2)::DOUBLE AS revenue,
       ROUND(profit, 2)::DOUBLE AS profit
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY {by} {way}, menu_item) AS rank
      FROM (SELECT location_id, menu_item, units, sub_revenue AS revenue, sub_revenue - cost AS profit FROM v_stats))
WHERE rank <= {n}"""


@query("dash_top_sellers", RANKED.format(by="units", way="DESC", n=5))
def _(t):
    return dashboard.ranked_items(dashboard.item_stats(t.sales, t.menu), "units", 5)


@query("dash_top_menu_items", RANKED.format(by="revenue", way="DESC", n=15))
def _(t):
    return dashboard.ranked_items(dashboard.item_stats(t.sales, t.menu), "revenue", 15)


@query("dash_underperformers", RANKED.format(by="units", way="ASC", n=15))
def _(t):
    return dashboard.ranked_items(dashboard.item_stats(t.sales, t.menu), "units", 15, ascending=True)


@query("dash_most_profitable", RANKED.format(by="profit", way="DESC", n=5))
def _(t):
    return dashboard.ranked_items(dashboard.item_stats(t.sales, t.menu), "profit", 5)


@query("dash_sales_summary_items", RANKED.format(by="profit", way="DESC", n=4))
def _(t):
    return dashboard.sales_summary(t.sales, t.menu)


@query("dash_best_and_worst_items", RANKED.format(by="profit", way="DESC", n=3).replace("SELECT ", "SELECT 'best' AS side, ", 1)
       + " UNION ALL " + RANKED.format(by="profit", way="ASC", n=3).replace("SELECT ", "SELECT 'worst' AS side, ", 1))
def _(t):
    return dashboard.best_and_worst_items(t.sales, t.menu)


@query("dash_item_margins", f"""
SELECT {LOC}, menu_item,
       ROUND(CAST((sub_revenue - cost)::DOUBLE / sub_revenue::DOUBLE AS DECIMAL(28,6)), 2)::DOUBLE AS profit_margin,
       ROUND(sub_revenue - cost, 2)::DOUBLE AS contribution_margin,
       ROUND(CAST(cost::DOUBLE / sub_revenue::DOUBLE * 100 AS DECIMAL(28,6)), 2)::DOUBLE AS food_cost_pct,
       ROUND(CAST(sub_revenue::DOUBLE / units AS DECIMAL(28,6)), 2)::DOUBLE AS average_price FROM v_stats""")
def _(t):
    return dashboard.item_margins(dashboard.item_stats(t.sales, t.menu))


@query("dash_item_hours", f"""
SELECT {LOC}, menu_item, hour::BIGINT AS hour, SUM(sub_revenue)::DOUBLE AS revenue FROM v_items
GROUP BY location_id, menu_item, hour""")
def _(t):
    return dashboard.item_hours(t.sales)


@query("dash_item_hour_maps", f"""
SELECT {LOC}, menu_item, hour::BIGINT AS hour, ROUND(SUM(sub_revenue), 2)::DOUBLE AS revenue FROM v_items
GROUP BY location_id, menu_item, hour""")
def _(t):
    return dashboard.item_hour_maps(t.sales).select("location_id", "menu_item", F.explode("revenue_by_hour").alias("hour", "revenue"))


@query("dash_product_mix", f"""
SELECT {LOC}, menu_item, units,
       units::DOUBLE / (SUM(units) OVER (PARTITION BY location_id))::DOUBLE * 100 AS mix_pct FROM v_base""")
def _(t):
    return dashboard.product_mix(t.sales)


@query("dash_cost_of_sales", f"""
SELECT {LOC}, SUM(sub_revenue)::DOUBLE AS revenue, SUM(cost)::DOUBLE AS cogs,
       (SUM(sub_revenue) - SUM(cost))::DOUBLE AS gross_profit,
       SUM(cost)::DOUBLE / SUM(sub_revenue)::DOUBLE * 100 AS food_cost_pct FROM v_stats GROUP BY location_id""")
def _(t):
    return dashboard.cost_of_sales(t.sales, t.menu)


@query("dash_stock_cost_by_ingredient", f"""
SELECT {LOC}, ingredient, SUM(CAST(quantity AS DECIMAL(14,3)) * unit_cost)::DOUBLE AS stock_cost,
       SUM(quantity) AS quantity FROM v_inventory GROUP BY location_id, ingredient""")
def _(t):
    return dashboard.stock_cost_by_ingredient(t.inventory)


USED = """, v_used AS (
  SELECT b.location_id, ingredient, SUM(CAST(amount AS DECIMAL(20,3)) * CAST(units AS DECIMAL(12,0))) AS used
  FROM v_base b JOIN v_menu m ON b.location_id = m.location_id AND b.menu_item = m.menu_item GROUP BY 1, 2)
"""


@query("dash_ingredient_usage", USED + f"SELECT {LOC}, ingredient, used::DOUBLE AS used FROM v_used")
def _(t):
    return dashboard.ingredient_usage(t.sales, t.menu)


@query("dash_inventory_waste", USED + """
SELECT i.location_id::BIGINT AS location_id, CAST(date AS VARCHAR) AS date, i.ingredient, quantity * 100 AS quantity,
       COALESCE(used, 0)::DOUBLE AS used, quantity * 100 - COALESCE(used, 0)::DOUBLE AS waste
FROM v_inventory i LEFT JOIN v_used u ON i.location_id = u.location_id AND i.ingredient = u.ingredient
WHERE COALESCE(used, 0)::DOUBLE < quantity * 100""")
def _(t):
    # the sample sells far more than it stocks: a hundredfold stock leaves some rows with waste
    return dashboard.inventory_waste(t.sales, t.menu, t.inventory.withColumn("quantity", F.col("quantity") * 100))


@query("dash_depletion_by_item", USED + """
SELECT p.location_id::BIGINT AS location_id, p.menu_item, p.ingredient, used::DOUBLE AS used
FROM (SELECT DISTINCT m.location_id, m.menu_item, m.ingredient FROM v_menu m
      JOIN v_base b ON b.location_id = m.location_id AND b.menu_item = m.menu_item) p
JOIN v_used u ON p.location_id = u.location_id AND p.ingredient = u.ingredient""")
def _(t):
    return dashboard.depletion_by_item(t.sales, t.menu)


@query("dash_recipe_cost_by_ingredient", f"""
SELECT {LOC}, ingredient, SUM(amount * unit_cost)::DOUBLE AS recipe_cost FROM v_menu GROUP BY location_id, ingredient""")
def _(t):
    return dashboard.recipe_cost_by_ingredient(t.menu)


WEEK = """, v_week AS (
  SELECT s.* FROM v_sales s JOIN (SELECT location_id, MAX(date) AS newest FROM v_sales GROUP BY location_id) m
    ON s.location_id = m.location_id WHERE s.date > newest - 7),
v_week_items AS (
  SELECT i.location_id, i.menu_item, COUNT(*) AS units, SUM(i.sub_revenue) AS revenue
  FROM v_items i JOIN v_week w ON w.sale_id = i.sale_id GROUP BY 1, 2)
"""


@query("dash_week_summary", WEEK + f"""
SELECT {LOC}, COUNT(*) AS orders, SUM(total_amount)::DOUBLE AS income, SUM(total_amount)::DOUBLE * 0.6 AS expense,
       SUM(total_amount)::DOUBLE - SUM(total_amount)::DOUBLE * 0.6 AS profit FROM v_week GROUP BY location_id""")
def _(t):
    return dashboard.week_summary(t.sales)


@query("dash_week_top_items", WEEK + f"""
SELECT {LOC}, menu_item, units, revenue::DOUBLE AS revenue, rank
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY revenue DESC, menu_item) AS rank FROM v_week_items)
WHERE rank <= 4""")
def _(t):
    return dashboard.week_top_items(t.sales)


@query("dash_week_items_with_assumed_margin", WEEK + f"""
SELECT {LOC}, menu_item, units, revenue::DOUBLE AS revenue, rank, revenue::DOUBLE * 0.3 AS profit,
       revenue::DOUBLE * (1 - 0.3::DOUBLE) AS cost
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY revenue DESC, menu_item) AS rank FROM v_week_items)
WHERE rank <= 5""")
def _(t):
    return dashboard.week_top_items(t.sales, limit=5, margin=0.3)


@query("dash_latest_sales", f"""
SELECT {LOC}, sale_id, CAST(date AS VARCHAR) AS date, total_amount::DOUBLE AS total_amount, rank
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY date DESC, sale_id DESC) AS rank FROM v_sales)
WHERE rank <= 100""")
def _(t):
    return dashboard.latest_sales(t.sales).select("location_id", "sale_id", "date", "total_amount", "rank")


@query("dash_location_overview", """
SELECT r.location_id::BIGINT AS location_id, COUNT(*) AS transactions, SUM(total_amount)::DOUBLE AS revenue,
       CAST(MAX(date) AS VARCHAR) AS latest_date,
       COUNT(*) FILTER (discount_percent > 20) AS anomalies,
       COUNT(*) FILTER (discount_percent > 25) AS alerts
FROM v_sales r GROUP BY location_id""")
def _(t):
    discounts = anomaly.high_discount(t.sales)
    steep = anomaly.high_discount(t.sales, above=25.0)
    return dashboard.location_overview(t.sales, discounts, steep)


@query("dash_menu_upload_summary", f"""
SELECT {LOC}, COUNT(DISTINCT menu_item) AS items, COUNT(DISTINCT ingredient) AS ingredients FROM v_menu GROUP BY location_id""")
def _(t):
    return dashboard.menu_upload_summary(t.menu)


BAND = """CASE WHEN quantity / par_level < 0.4 THEN 'CRITICAL LOW' WHEN quantity / par_level < 0.6 THEN 'LOW'
     WHEN quantity / par_level > 1.3 THEN 'HIGH' ELSE 'NORMAL' END"""


@query("inventory_alert_bands", f"""
SELECT {LOC}, ingredient, quantity / par_level AS ratio, {BAND} AS band, {BAND} IN ('LOW', 'CRITICAL LOW') AS is_low
FROM v_inventory""")
def _(t):
    return silver.alert_band(t.inventory).select("location_id", "ingredient", "ratio", "band", "is_low")


@query("dash_inventory_upload_summary", f"""
SELECT {LOC}, COUNT(*) FILTER (band = 'LOW') AS low, COUNT(*) FILTER (band = 'CRITICAL LOW') AS critical,
       COUNT(*) FILTER (band = 'HIGH') AS high, COUNT(*) AS total
FROM (SELECT *, {BAND} AS band FROM v_inventory) GROUP BY location_id""")
def _(t):
    return dashboard.inventory_upload_summary(silver.alert_band(t.inventory))


@query("filter_last_days_of_data", WEEK + f"""
SELECT {LOC}, CAST(date AS VARCHAR) AS date, COUNT(*) AS sales FROM v_week GROUP BY location_id, date""")
def _(t):
    return periods.last_days_of_data(t.sales).groupBy("location_id", "date").agg(F.count(F.lit(1)).alias("sales"))


@query("filter_cutoff_or_all", f"""
SELECT {LOC}, COUNT(*) AS sales FROM v_sales GROUP BY location_id""")
def _(t):
    import datetime as dt
    return periods.from_cutoff_or_all(t.sales, AS_OF + dt.timedelta(days=9000)).groupBy("location_id").agg(
        F.count(F.lit(1)).alias("sales"))


@query("filter_cutoff_reached", f"""
SELECT {LOC}, COUNT(*) AS sales FROM (SELECT *, max(date) OVER (PARTITION BY location_id) AS newest FROM v_sales)
WHERE date >= DATE '2001-07-02' OR newest < DATE '2001-07-02' GROUP BY location_id""")
def _(t):
    import datetime as dt
    return periods.from_cutoff_or_all(t.sales, AS_OF - dt.timedelta(days=30)).groupBy("location_id").agg(
        F.count(F.lit(1)).alias("sales"))


@query("filter_clamped_range", f"""
SELECT {LOC}, COUNT(*) AS sales FROM v_sales WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-06-01' GROUP BY location_id""")
def _(t):
    import datetime as dt
    bounds = periods.clamped_range(dt.date(2000, 6, 1), dt.date(2000, 1, 1))
    return periods.between(t.sales, bounds).groupBy("location_id").agg(F.count(F.lit(1)).alias("sales"))


@query("filter_weekend", f"""
SELECT {LOC}, COUNT(*) AS sales FROM v_sales WHERE EXTRACT(DOW FROM date) IN (0, 6) GROUP BY location_id""")
def _(t):
    return t.sales.where(periods.weekend("date")).groupBy("location_id").agg(F.count(F.lit(1)).alias("sales"))
