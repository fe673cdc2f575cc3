"""KPI suite over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brigade.operators import kpi
from brigade.plans.registry import query
from brigade.plans.views import AS_OF
from brigade.functions import periods


@query("kpi_total_sales", """
SELECT location_id::BIGINT AS location_id, SUM(subtotal)::DOUBLE AS total_sales, SUM(subtotal) < 0 AS negative
FROM v_sales GROUP BY location_id""")
def _(t):
    return kpi.total_sales(t.sales)


NET = """, v_net AS (
  SELECT location_id, SUM(subtotal) AS gross_sales, SUM(comps) AS comps, SUM(promos) AS promos, SUM(voids) AS voids,
         COALESCE(SUM(subtotal * CAST(discount_percent AS DECIMAL(7,2)) * CAST(0.01 AS DECIMAL(3,2))), 0) AS discounts
  FROM v_sales GROUP BY location_id),
v_net2 AS (SELECT *, gross_sales - comps - promos - voids - CAST(discounts AS DECIMAL(28,6)) AS net_revenue FROM v_net)
"""


@query("kpi_net_revenue", NET + """
SELECT location_id::BIGINT AS location_id, gross_sales::DOUBLE AS gross_sales, comps::DOUBLE AS comps,
       promos::DOUBLE AS promos, voids::DOUBLE AS voids, discounts::DOUBLE AS discounts,
       net_revenue::DOUBLE AS net_revenue FROM v_net2""")
def _(t):
    return kpi.net_revenue(t.sales)


@query("kpi_net_revenue_adapter_rows", NET + """
SELECT location_id::BIGINT AS location_id, (gross_sales - comps - promos - voids)::DOUBLE AS net_revenue FROM v_net2""")
def _(t):
    return kpi.net_revenue(t.sales, discount_source="promos").select("location_id", "net_revenue")


@query("kpi_sales_per_labor_hour", NET + """
SELECT n.location_id::BIGINT AS location_id, ROUND(net_revenue, 2)::DOUBLE AS net_revenue, labor_hours,
       CASE WHEN labor_hours <> 0 THEN ROUND(net_revenue, 2)::DOUBLE / labor_hours END AS splh
FROM v_net2 n LEFT JOIN (SELECT location_id, SUM(hours_worked) AS labor_hours FROM v_labor WHERE NOT is_salaried
                         GROUP BY location_id) l ON n.location_id = l.location_id""")
def _(t):
    return kpi.sales_per_labor_hour(t.sales, t.labor)


@query("kpi_guest_count", """
SELECT location_id::BIGINT AS location_id, SUM(covers)::BIGINT AS guest_count, 'covers' AS method
FROM v_sales GROUP BY location_id""")
def _(t):
    return kpi.guest_count(t.sales)


@query("kpi_guest_count_without_covers", """
SELECT location_id::BIGINT AS location_id, COUNT(*) AS guest_count, 'transactions' AS method
FROM v_sales GROUP BY location_id""")
def _(t):
    return kpi.guest_count(t.sales.drop("covers"))


@query("kpi_average_check", NET + """
SELECT n.location_id::BIGINT AS location_id, net_revenue::DOUBLE AS net_revenue, g.guests::BIGINT AS guest_count,
       net_revenue::DOUBLE / g.guests AS average_check
FROM v_net2 n JOIN (SELECT location_id, SUM(covers) AS guests FROM v_sales GROUP BY location_id) g
  ON n.location_id = g.location_id""")
def _(t):
    return kpi.average_check(t.sales)


@query("kpi_top_items", """
SELECT location_id::BIGINT AS location_id, rank, menu_item, units, ROUND(revenue, 2)::DOUBLE AS revenue
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY units DESC, menu_item) AS rank FROM v_base)
WHERE rank <= 10""")
def _(t):
    return kpi.top_items(t.sales)


@query("kpi_distinct_items", """
SELECT location_id::BIGINT AS location_id, COUNT(DISTINCT menu_item) AS distinct_items FROM v_items GROUP BY location_id""")
def _(t):
    return kpi.distinct_items(t.sales)


@query("kpi_gross_profit_per_item", """
SELECT location_id::BIGINT AS location_id, menu_item, units, revenue::DOUBLE AS revenue, cost::DOUBLE AS cost,
       gross_profit::DOUBLE AS gross_profit, margin_pct::DOUBLE AS margin_pct FROM v_profit""")
def _(t):
    return kpi.gross_profit_per_item(t.sales, t.menu)


@query("kpi_food_cost_pct", """
SELECT location_id::BIGINT AS location_id, SUM(cost)::DOUBLE AS cost, SUM(revenue)::DOUBLE AS revenue,
       SUM(cost)::DOUBLE / SUM(revenue)::DOUBLE * 100 AS food_cost_pct,
       SUM(cost)::DOUBLE / SUM(revenue)::DOUBLE * 100 BETWEEN 0 AND 100 AS valid
FROM v_profit GROUP BY location_id""")
def _(t):
    return kpi.food_cost_pct(t.sales, t.menu)


INGREDIENT_COST = """, v_last AS (
  SELECT location_id, menu_item, ingredient, arg_max(amount, ingest_seq) AS amount, arg_max(unit_cost, ingest_seq) AS unit_cost
  FROM v_menu GROUP BY 1, 2, 3),
v_ingredient_cost AS (
  SELECT b.location_id, ingredient,
         ROUND(SUM(CAST(amount * unit_cost AS DECIMAL(24,5)) * CAST(units AS DECIMAL(12,0))), 2) AS cost
  FROM v_base b JOIN v_last m ON b.location_id = m.location_id AND b.menu_item = m.menu_item GROUP BY 1, 2)
"""


@query("kpi_cogs_by_category", INGREDIENT_COST + """
SELECT location_id::BIGINT AS location_id,
       CASE WHEN regexp_matches(lower(ingredient), 'beer|wine|liquor|whiskey|vodka') THEN 'Alcohol'
            WHEN regexp_matches(lower(ingredient), 'soda|juice|water|coffee|tea') THEN 'Beverages' ELSE 'Food' END AS category,
       SUM(cost)::DOUBLE AS cogs, COUNT(*) AS ingredients
FROM v_ingredient_cost GROUP BY 1, 2""")
def _(t):
    return kpi.cogs_by_category(t.sales, t.menu)


@query("kpi_inventory_turnover", INGREDIENT_COST + """
SELECT s.location_id::BIGINT AS location_id, COALESCE(cogs, 0)::DOUBLE AS cogs, value::DOUBLE / n AS average_stock_value,
       COALESCE(cogs, 0)::DOUBLE / (value::DOUBLE / n) AS turnover,
       COALESCE(cogs, 0)::DOUBLE / (value::DOUBLE / n) BETWEEN 0 AND 100 AS valid
FROM (SELECT location_id, SUM(CAST(quantity AS DECIMAL(14,3)) * unit_cost) AS value, COUNT(*) AS n
      FROM v_inventory GROUP BY location_id) s
LEFT JOIN (SELECT location_id, SUM(cost) AS cogs FROM v_ingredient_cost GROUP BY location_id) c
  ON s.location_id = c.location_id""")
def _(t):
    return kpi.inventory_turnover(t.sales, t.menu, t.inventory)


@query("kpi_low_inventory", """
SELECT location_id::BIGINT AS location_id, CAST(date AS VARCHAR) AS date, ingredient, quantity, par_level,
       par_level - quantity AS shortage FROM v_inventory WHERE quantity <= par_level""")
def _(t):
    return kpi.low_inventory(t.inventory)


@query("kpi_low_inventory_count", """
SELECT location_id::BIGINT AS location_id, COUNT(*) FILTER (quantity <= par_level) AS low_items
FROM v_inventory GROUP BY location_id""")
def _(t):
    return kpi.low_inventory_count(t.inventory)


@query("kpi_labor_hours_by_role", """
SELECT location_id::BIGINT AS location_id, position, SUM(hours_worked) AS hours
FROM v_labor GROUP BY GROUPING SETS ((location_id, position), (location_id))""")
def _(t):
    return kpi.labor_hours_by_role(t.labor)


@query("kpi_overtime_pct", """
SELECT *, CASE WHEN overtime_hours > hours THEN 'overtime exceeds hours'
               WHEN overtime_pct > 50 THEN 'overtime share is high' END AS warning
FROM (SELECT location_id::BIGINT AS location_id, position, SUM(overtime_hours) AS overtime_hours, SUM(hours_worked) AS hours,
             CASE WHEN SUM(hours_worked) <> 0 THEN SUM(overtime_hours) / SUM(hours_worked) * 100 END AS overtime_pct
      FROM v_labor WHERE NOT is_salaried GROUP BY GROUPING SETS ((location_id, position), (location_id)))""")
def _(t):
    return kpi.overtime_pct(t.labor)


QUADRANT = """, v_median AS (
  SELECT location_id, median(units::DOUBLE) AS median_units, median(gross_profit::DOUBLE) AS median_profit
  FROM v_profit GROUP BY location_id),
v_quadrant AS (
  SELECT p.*, median_units, median_profit,
         row_number() OVER (PARTITION BY p.location_id ORDER BY gross_profit DESC, units DESC, menu_item) AS profitability_rank,
         row_number() OVER (PARTITION BY p.location_id ORDER BY units DESC, gross_profit DESC, menu_item) AS popularity_rank,
         CASE WHEN units >= median_units AND gross_profit::DOUBLE >= median_profit THEN 'STAR'
              WHEN units >= median_units THEN 'PLOW HORSE'
              WHEN gross_profit::DOUBLE >= median_profit THEN 'PUZZLE' ELSE 'DOG' END AS quadrant
  FROM v_profit p JOIN v_median m ON p.location_id = m.location_id)
"""


@query("kpi_menu_quadrants", QUADRANT + """
SELECT location_id::BIGINT AS location_id, menu_item, units, gross_profit::DOUBLE AS gross_profit, median_units,
       median_profit, profitability_rank, popularity_rank, quadrant,
       CASE quadrant WHEN 'STAR' THEN 'Keep & Promote - This is a winning item'
            WHEN 'PLOW HORSE' THEN 'Increase price or reduce cost - Popular but not profitable'
            WHEN 'PUZZLE' THEN 'Promote more - Hidden gem with great margins'
            ELSE 'Consider removing - Low sales and low profit' END AS recommendation
FROM v_quadrant""")
def _(t):
    return kpi.menu_quadrants(t.sales, t.menu).select(
        "location_id", "menu_item", "units", "gross_profit", "median_units", "median_profit",
        "profitability_rank", "popularity_rank", "quadrant", "recommendation")


@query("kpi_quadrant_counts", QUADRANT + """
SELECT location_id::BIGINT AS location_id, COUNT(*) AS total_items, COUNT(*) FILTER (quadrant = 'STAR') AS star,
       COUNT(*) FILTER (quadrant = 'PLOW HORSE') AS plow_horse, COUNT(*) FILTER (quadrant = 'PUZZLE') AS puzzle,
       COUNT(*) FILTER (quadrant = 'DOG') AS dog, ROUND(MAX(median_units), 2) AS median_units,
       ROUND(MAX(median_profit), 2) AS median_profit FROM v_quadrant GROUP BY location_id""")
def _(t):
    return kpi.quadrant_counts(kpi.menu_quadrants(t.sales, t.menu))


def _period(name, days):
    @query(f"filter_period_{name.lower()}", f"""
SELECT location_id::BIGINT AS location_id, COUNT(*) AS sales, SUM(total_amount)::DOUBLE AS revenue FROM v_sales
WHERE date BETWEEN DATE '2001-08-01' - {days} AND DATE '2001-08-01' GROUP BY location_id""")
    def _(t):
        return periods.in_period(t.sales, name, AS_OF).groupBy("location_id").agg(
            F.count(F.lit(1)).alias("sales"), F.sum("total_amount").alias("revenue"))


for _name, _days in periods.PERIOD_DAYS.items():
    _period(_name, _days)
