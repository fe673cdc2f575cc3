"""Orders, customers, promotions, usage, access and vectors over the sample tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from brigade.operators import access, customers, dashboard, pages, pos, promotions, usage, vector_index, vectors
from brigade.operators.catalog import search_menu_text
from brigade.plans.registry import query
from brigade.plans.views import AS_OF
from brigade.session import shared_path

LOC = "location_id::BIGINT AS location_id"

# -- point of sale -------------------------------------------------------------------------------

DAYS = """, v_day AS (
  SELECT location_id, order_date, COUNT(*) AS total_orders, SUM(total) AS total_revenue FROM v_pos GROUP BY 1, 2),
v_day_items AS (
  SELECT *, row_number() OVER (PARTITION BY location_id, order_date ORDER BY quantity DESC, menu_item) AS rank
  FROM (SELECT location_id, order_date, menu_item, SUM(quantity)::BIGINT AS quantity FROM v_pos_items GROUP BY 1, 2, 3))
"""


@query("pos_day_totals", DAYS + f"""
SELECT {LOC}, CAST(order_date AS VARCHAR) AS order_date, total_orders, total_revenue::DOUBLE AS total_revenue,
       total_revenue::DOUBLE / total_orders AS average_order_value FROM v_day""")
def _(t):
    return pos.day_totals(t.pos_orders)


@query("pos_daily_summary_items", DAYS + f"""
SELECT {LOC}, CAST(order_date AS VARCHAR) AS order_date, menu_item, quantity FROM v_day_items WHERE rank <= 10""")
def _(t):
    s = pos.daily_summary(t.pos_orders)
    return s.select("location_id", "order_date", F.explode("top_items").alias("menu_item", "quantity"))


@query("pos_daily_summary_hours", f"""
SELECT {LOC}, CAST(order_date AS VARCHAR) AS order_date, hour::BIGINT AS hour, SUM(total)::DOUBLE AS revenue
FROM v_pos GROUP BY location_id, order_date, hour""")
def _(t):
    s = pos.daily_summary(t.pos_orders)
    return s.select("location_id", "order_date", F.explode("hourly_revenue").alias("hour", "revenue"))


@query("pos_recent_days", DAYS + f"""
SELECT {LOC}, CAST(order_date AS VARCHAR) AS order_date, total_orders FROM v_day
WHERE order_date BETWEEN DATE '2001-07-26' AND DATE '2001-08-01'""")
def _(t):
    return pos.recent_days(pos.day_totals(t.pos_orders), AS_OF).select("location_id", "order_date", "total_orders")


@query("pos_latest_orders", f"""
SELECT {LOC}, order_id, CAST(order_date AS VARCHAR) AS order_date, rank
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY order_date DESC, order_id DESC) AS rank FROM v_pos)
WHERE rank <= 100""")
def _(t):
    return pos.latest_orders(t.pos_orders).select("location_id", "order_id", "order_date", "rank")


@query("pos_history_totals", f"""
SELECT {LOC}, COUNT(*) AS orders, SUM(total)::DOUBLE AS revenue, SUM(total)::DOUBLE / COUNT(*) AS average_order_value
FROM v_pos GROUP BY location_id""")
def _(t):
    return pos.history_totals(t.pos_orders)


@query("pos_history_hours", f"""
SELECT {LOC}, hour::BIGINT AS hour, COUNT(*) AS orders FROM v_pos GROUP BY location_id, hour""")
def _(t):
    return pos.history_hours(t.pos_orders)


HISTORY = """, v_hist AS (
  SELECT location_id, menu_item, SUM(quantity)::BIGINT AS quantity, SUM(amount) AS revenue, SUM(food_cost) AS food_cost
  FROM v_pos_items GROUP BY 1, 2)
"""
HISTORY_ROW = f"""{LOC}, menu_item, quantity, revenue::DOUBLE AS revenue, food_cost::DOUBLE AS food_cost,
  (revenue - food_cost)::DOUBLE AS profit, (revenue - food_cost)::DOUBLE / revenue::DOUBLE * 100 AS margin_pct"""


@query("pos_history_items", HISTORY + f"SELECT {HISTORY_ROW} FROM v_hist")
def _(t):
    return pos.history_items(t.pos_orders)


@query("pos_history_top_items", HISTORY + f"""
SELECT {HISTORY_ROW}, rank
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY quantity DESC, menu_item) AS rank FROM v_hist)
WHERE rank <= 10""")
def _(t):
    return pos.history_top_items(t.pos_orders)


@query("pos_menu_by_category", f"""
SELECT {LOC}, category, COUNT(*) AS items, SUM(item_price)::DOUBLE / COUNT(*) AS average_price FROM v_menu
GROUP BY location_id, category""")
def _(t):
    return pos.menu_by_category(t.menu)


@query("pos_merged_top_items", DAYS + f"""
SELECT {LOC}, menu_item, quantity, rank
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY quantity DESC, menu_item) AS rank
      FROM (SELECT location_id, menu_item, SUM(quantity)::BIGINT AS quantity FROM v_day_items WHERE rank <= 10 GROUP BY 1, 2))
WHERE rank <= 10""")
def _(t):
    return pos.merged_top_items(pos.daily_summary(t.pos_orders))


@query("pos_insights", DAYS + f"""
SELECT {LOC}, SUM(total_orders)::BIGINT AS total_orders, SUM(total_revenue)::DOUBLE AS total_revenue,
       SUM(total_revenue)::DOUBLE / SUM(total_orders) AS average_order_value,
       CAST(first(order_date ORDER BY total_revenue DESC, order_date) AS VARCHAR) AS best_day,
       CAST(first(order_date ORDER BY total_revenue, order_date) AS VARCHAR) AS worst_day
FROM v_day GROUP BY location_id""")
def _(t):
    return pos.insights(pos.day_totals(t.pos_orders))


@query("pos_record_counts", """
SELECT 'orders' AS data_type, COUNT(*) AS records FROM v_pos UNION ALL SELECT 'menu', COUNT(*) FROM v_menu
UNION ALL SELECT 'customers', COUNT(*) FROM customer""")
def _(t):
    return pos.record_counts(orders=t.pos_orders, menu=t.menu, customers=t.raw("customer"))


@query("pos_freshness", """
SELECT 'events' AS source, CAST(MAX(ts) AS VARCHAR) AS newest,
       epoch(TIMESTAMP '2024-01-31 00:10:00') - floor(epoch(MAX(ts))) > 30 * 60 AS stale FROM events""")
def _(t):
    return pos.freshness(dt.datetime(2024, 1, 31, 0, 10), events=t.raw("events").withColumnRenamed("ts", "ingest_ts"))


@query("filter_menu_text_search", f"""
SELECT {LOC}, menu_item, ingredient, category, ingest_seq FROM v_menu
WHERE contains(lower(menu_item || ' ' || ingredient || ' ' || category), 'ring economy')""")
def _(t):
    return search_menu_text(t.menu, "Ring ECONOMY", "menu_item", "ingredient", "category").select(
        "location_id", "menu_item", "ingredient", "category", "ingest_seq")


# -- customers -----------------------------------------------------------------------------------

@query("customer_insights", """
SELECT COUNT(*) AS total_customers, COUNT(*) FILTER (n > 5) AS frequent_customers, COUNT(*) FILTER (w) AS weekend_customers,
       COUNT(*) FILTER (spent > 500) AS high_value_customers,
       COUNT(*) FILTER (last < DATE '2001-08-01' - 30) AS lapsed_customers,
       COUNT(*) FILTER (first >= DATE '2001-08-01' - 7) AS new_customers
FROM (SELECT customer_id, COUNT(*) AS n, SUM(paid_amount) AS spent, MIN(visit_date) AS first, MAX(visit_date) AS last,
             bool_or(EXTRACT(DOW FROM visit_date) IN (0, 6)) AS w FROM v_visit GROUP BY customer_id)""")
def _(t):
    return customers.customer_insights(t.visits, AS_OF)


PERSON = """, v_person AS (
  SELECT email, customer_name, phone, SUM(paid_amount) AS total_spent, COUNT(*) AS visit_count, MAX(visit_date) AS last_visit,
         MIN(visit_date) AS first_visit, bool_or(EXTRACT(DOW FROM visit_date) IN (0, 6)) AS weekend
  FROM v_visit WHERE email IS NOT NULL AND email <> '' GROUP BY 1, 2, 3)
"""
PERSON_ROW = """email, customer_name, phone, total_spent::DOUBLE AS total_spent, visit_count,
  CAST(last_visit AS VARCHAR) AS last_visit"""


@query("customer_labels", PERSON + f"""
SELECT * FROM (SELECT {PERSON_ROW}, concat_ws(', ', CASE WHEN visit_count > 5 THEN 'Frequent diners' END,
       CASE WHEN weekend THEN 'Weekend visitor' END, CASE WHEN total_spent > 500 THEN 'High-valued' END,
       CASE WHEN last_visit < DATE '2001-08-01' - 30 THEN 'Lapsed customer' END,
       CASE WHEN first_visit >= DATE '2001-08-01' - 7 THEN 'New customer' END) AS type FROM v_person) WHERE type <> ''""")
def _(t):
    return customers.labelled_customers(t.visits, AS_OF)


def _segment(name, label, where, as_of=AS_OF):
    @query(f"customer_segment_{name}", PERSON + f"SELECT {PERSON_ROW}, '{label}' AS type FROM v_person WHERE {where}")
    def _(t):
        return customers.customers_of_segment(t.visits, label, as_of)


_segment("frequent", "Frequent diners", "visit_count > 5")
_segment("high_valued", "High-valued", "total_spent > 500")
_segment("lapsed", "Lapsed customer", "last_visit < DATE '2001-08-01' - 30")
_segment("new", "New customer", "first_visit >= DATE '1996-07-01' - 7", dt.date(1996, 7, 1))


@query("customer_segment_weekend", """
SELECT email, customer_name, phone, SUM(paid_amount)::DOUBLE AS total_spent, COUNT(*) AS visit_count,
       CAST(MAX(visit_date) AS VARCHAR) AS last_visit, 'Weekend visitor' AS type
FROM v_visit WHERE EXTRACT(DOW FROM visit_date) IN (0, 6) GROUP BY 1, 2, 3""")
def _(t):
    return customers.customers_of_segment(t.visits, "Weekend visitor", AS_OF)


@query("customer_target_list", PERSON + """
SELECT email, customer_name, phone FROM v_person WHERE total_spent > 500""")
def _(t):
    return customers.target_list(t.visits, "High-valued", AS_OF)


@query("campaign_delivery", """
SELECT event_type AS campaign_id, COUNT(*) AS targets, COUNT(*) FILTER (value > 5) AS sent,
       COUNT(*) - COUNT(*) FILTER (value > 5) AS failed, COUNT(*) FILTER (value > 5)::DOUBLE / COUNT(*) * 100 AS delivery_rate
FROM events GROUP BY event_type""")
def _(t):
    log = t.raw("events").select(
        F.col("event_type").alias("campaign_id"), F.when(F.col("value") > 5, "sent").otherwise("failed").alias("status"))
    return customers.delivery_outcome(log)


@query("campaign_states", """
SELECT s_suppkey AS id, CASE WHEN s_acctbal > 7000 THEN 'submitted'
       WHEN s_acctbal > 1000 AND DATE '2001-07-20' + CAST(s_suppkey % 30 AS INT) > DATE '2001-08-01' THEN 'scheduled'
       WHEN s_acctbal > 1000 THEN 'due' ELSE 'draft' END AS state FROM supplier""")
def _(t):
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    rows = t.raw("supplier").select(
        k.alias("id"), F.when(bal > 7000, F.lit(AS_OF)).alias("submitted_at"),
        F.when(bal > 1000, F.date_add(F.lit(dt.date(2001, 7, 20)), (k % 30).cast("int"))).alias("scheduled_at"))
    return customers.campaigns_by_state(rows, AS_OF).select("id", "state")


@query("campaign_library", "SELECT doc_id, source AS content_type FROM documents WHERE source ILIKE '%SRC1%'")
def _(t):
    return customers.library(t.raw("documents").select("doc_id", F.col("source").alias("content_type")), "SRC1")


# -- promotions ----------------------------------------------------------------------------------

DIPS = """, v_daily AS (SELECT location_id, date, SUM(total_amount) AS total_amount FROM v_sales GROUP BY 1, 2),
v_dip0 AS (SELECT *, (SUM(total_amount) OVER (PARTITION BY location_id))::DOUBLE / COUNT(*) OVER (PARTITION BY location_id) AS average
           FROM v_daily),
v_dip1 AS (SELECT *, (average - total_amount::DOUBLE) / average * 100 AS drop_pct FROM v_dip0),
v_dip AS (SELECT *, CASE WHEN drop_pct >= 40 THEN 'Critical' WHEN drop_pct >= 30 THEN 'High' ELSE 'Moderate' END AS severity,
                 CASE WHEN drop_pct >= 40 THEN 40 WHEN drop_pct >= 30 THEN 30 ELSE 20 END AS discount_pct
          FROM v_dip1 WHERE drop_pct >= 20)
"""


def _daily(t):
    return t.sales.groupBy("location_id", "date").agg(F.sum("total_amount").alias("total_amount"))


@query("promo_sales_dips", DIPS + f"""
SELECT {LOC}, CAST(date AS VARCHAR) AS date, total_amount::DOUBLE AS total_amount, average, drop_pct, severity,
       discount_pct::BIGINT AS discount_pct, average - total_amount::DOUBLE AS recoverable FROM v_dip""")
def _(t):
    return promotions.sales_dips(_daily(t))


@query("promo_dip_suggestions", DIPS + f"""
, v_told AS (SELECT *, CAST(date AS VARCHAR) AS day, discount_pct || '%' AS discount,
    (('0x' || substr(md5(CAST(date AS VARCHAR)), 1, 7))::BIGINT % 3 + 1)::INT AS pick FROM v_dip)
SELECT {LOC}, day AS date, 'All menu items (Low sales on ' || day || ')' AS item, severity,
       CASE severity WHEN 'Critical' THEN '🚨' WHEN 'High' THEN '⚠️' ELSE '📊' END || ' Sales on ' || day || ' dropped by '
         || CAST(drop_pct AS DECIMAL(38,1)) || '% compared to daily average of $' || CAST(average AS DECIMAL(38,2)) AS reason,
       ['Flash Sale Boost', 'Combo Value Deal', 'Happy Hour Extension'][pick] AS suggested_offer,
       ['Limited time ' || discount || ' off on all menu items.' || chr(10) || 'Valid only for ' || day || ', drive immediate sales boost.',
        'Buy any main course, get appetizer ' || discount || ' off.' || chr(10) || 'Perfect for increasing average order value.',
        'Extended happy hour with ' || discount || ' off.' || chr(10) || 'Boost traffic during traditionally slow periods.'][pick] AS offer_details,
       CASE severity WHEN 'Critical' THEN 'Immediate action required' WHEN 'High' THEN 'Urgent attention needed'
         ELSE 'Monitor closely' END AS urgency_level,
       'Potential to recover $' || regexp_replace(CAST(CAST(average - total_amount::DOUBLE AS DECIMAL(38,2)) AS VARCHAR), '(\\.\\d)0$', '\\1')
         || ' in lost revenue' AS estimated_impact,
       '24 hours' AS recommended_duration, severity AS implementation_priority FROM v_told""")
def _(t):
    return promotions.dip_suggestions(_daily(t)).withColumn("date", F.col("date").cast("string"))


WEAK = """, v_ih AS (SELECT location_id, menu_item, hour, SUM(sub_revenue) AS revenue FROM v_items GROUP BY 1, 2, 3),
v_ih2 AS (SELECT *, (SUM(revenue) OVER (PARTITION BY location_id, menu_item))::DOUBLE
                    / COUNT(*) OVER (PARTITION BY location_id, menu_item) AS mean FROM v_ih),
v_weak AS (
  SELECT location_id, menu_item, CASE WHEN hour BETWEEN 6 AND 10 THEN 'breakfast' WHEN hour BETWEEN 11 AND 14 THEN 'lunch'
           WHEN hour BETWEEN 15 AND 16 THEN 'afternoon' WHEN hour BETWEEN 17 AND 22 THEN 'dinner' ELSE 'late_night' END AS segment,
         string_agg(lpad(hour::VARCHAR, 2, '0') || ':00', ', ' ORDER BY hour) AS hours,
         SUM(revenue)::DOUBLE / COUNT(*) AS average_revenue
  FROM v_ih2 WHERE revenue::DOUBLE < mean * 0.5 GROUP BY 1, 2, 3)
"""


@query("promo_weak_dayparts", WEAK + f"SELECT {LOC}, menu_item, segment, hours, average_revenue FROM v_weak")
def _(t):
    return promotions.weak_dayparts(dashboard.item_hours(t.sales))


SURPLUS = """, v_surplus AS (
  SELECT *, CASE WHEN quantity >= 2000 THEN 'critical_surplus' WHEN quantity >= 1500 THEN 'high_surplus'
                 ELSE 'moderate_surplus' END AS segment FROM v_words WHERE quantity >= 1000)
"""


@query("promo_surplus_stock", SURPLUS + f"""
SELECT {LOC}, ingredient, quantity, segment, CASE WHEN segment = 'critical_surplus' THEN 'High' ELSE 'Medium' END AS urgency,
       quantity - 500 AS potential_waste FROM v_surplus""")
def _(t):
    return promotions.surplus_stock(t.word_stock)


TARGET = """, v_top AS (
  SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY units DESC, menu_item) AS by_units,
         row_number() OVER (PARTITION BY location_id ORDER BY sub_revenue DESC, menu_item) AS by_revenue,
         row_number() OVER (PARTITION BY location_id ORDER BY sub_revenue - cost DESC, menu_item) AS by_profit FROM v_stats),
v_match AS (
  SELECT m.location_id, m.menu_item, string_agg(m.ingredient, '|' ORDER BY m.ingredient) AS s, COUNT(*) AS c
  FROM (SELECT DISTINCT location_id, menu_item, ingredient FROM v_menu) m
  JOIN (SELECT location_id, ingredient FROM v_inventory WHERE quantity >= 600) i
    ON m.location_id = i.location_id AND m.ingredient = i.ingredient GROUP BY 1, 2),
v_target0 AS (
  SELECT t.location_id, t.menu_item, (by_units <= 5)::INT + (by_revenue <= 15)::INT AS popularity, by_profit <= 5 AS profitable,
         COALESCE(s, '') AS surplus_ingredients, COALESCE(c, 0) AS c
  FROM v_top t LEFT JOIN v_match x ON t.location_id = x.location_id AND t.menu_item = x.menu_item
  WHERE by_units <= 5 OR by_revenue <= 15),
v_target AS (
  SELECT *, CASE WHEN c > 0 THEN 'surplus_reduction' WHEN profitable THEN 'premium' ELSE 'popular' END AS category,
         row_number() OVER (PARTITION BY location_id ORDER BY profitable DESC, popularity DESC, c DESC, menu_item) AS rank
  FROM v_target0)
"""


def _targets(t):
    stats = dashboard.item_stats(t.sales, t.menu)
    return promotions.smart_targets(
        dashboard.ranked_items(stats, "units", 5), dashboard.ranked_items(stats, "revenue", 15),
        dashboard.ranked_items(stats, "profit", 5), t.inventory, t.menu, surplus_from=600.0)


@query("promo_smart_targets", TARGET + f"""
SELECT {LOC}, rank, menu_item, popularity::BIGINT AS popularity, profitable, surplus_ingredients, category FROM v_target
WHERE rank <= 5""")
def _(t):
    return _targets(t).select("location_id", "rank", "menu_item", "popularity", "profitable", "surplus_ingredients", "category")


@query("promo_reasons", TARGET + f"""
SELECT {LOC}, menu_item,
       concat_ws(chr(10), CASE WHEN profitable THEN 'High profit margin item with proven returns' END,
         CASE popularity WHEN 2 THEN 'Consistently top-performing menu item' WHEN 1 THEN 'Growing customer favorite' END,
         CASE WHEN c > 0 THEN 'Helps reduce surplus of: ' || replace(surplus_ingredients, '|', ', ') END) AS reason,
       CASE category WHEN 'premium' THEN 'Fine dining enthusiasts|Special occasion diners|Food critics'
         WHEN 'popular' THEN 'Regular customers|Social media followers|Value seekers'
         ELSE 'Price-sensitive customers|Bulk buyers|Large groups' END AS audience,
       CASE category WHEN 'premium' THEN 'Email newsletter|Instagram|Direct SMS to VIP customers'
         WHEN 'popular' THEN 'Social media|In-app notifications|Table displays'
         ELSE 'Push notifications|Daily specials board|Staff recommendations' END AS channels
FROM v_target WHERE rank <= 5""")
def _(t):
    return promotions.with_reason(_targets(t)).select("location_id", "menu_item", "reason", "audience", "channels")


PICK = "(('0x' || substr(md5({0}), 1, 7))::BIGINT % {1} + 1)::INT"
OFFER = f"""CASE category
  WHEN 'surplus_reduction' THEN ['Chef''s Special Feature', 'Limited Time Creation'][{PICK.format('menu_item', 2)}]
  WHEN 'premium' THEN ['Premium Spotlight Deal', 'Gourmet Bundle'][{PICK.format('menu_item', 2)}]
  ELSE ['Fan Favorite Special', 'Trending Item Deal'][{PICK.format('menu_item', 2)}] END"""


@query("promo_offers", TARGET + f"""
SELECT {LOC}, menu_item, category, {OFFER} AS offer FROM v_target WHERE rank <= 5""")
def _(t):
    return promotions.with_offer(_targets(t), F.col("category"), "menu_item").select("location_id", "menu_item", "category", "offer")


COPY = (("email", 1, "Subject: {item} - {offer}"), ("email", 2, "This week: {offer} on {item}"),
        ("sms", 1, "{item}: {offer}"), ("sms", 2, "Now on: {item}, {offer}"), ("sms", 3, "{offer} for {item}"))


@query("promo_campaign_copy", TARGET + f""", v_offer AS (SELECT location_id, menu_item AS item, {OFFER} AS offer FROM v_target WHERE rank <= 5)
SELECT {LOC}, item, offer, 'email' AS channel,
       ['Subject: ' || item || ' - ' || offer, 'This week: ' || offer || ' on ' || item][{PICK.format('item', 2)}] AS copy FROM v_offer
UNION ALL SELECT location_id, item, offer, 'sms',
       [item || ': ' || offer, 'Now on: ' || item || ', ' || offer, offer || ' for ' || item][{PICK.format('item', 3)}] FROM v_offer""")
def _(t):
    templates = t.spark.createDataFrame(COPY, "channel string, seq int, text string")
    offers = promotions.with_offer(_targets(t), F.col("category"), "menu_item").select(
        "location_id", F.col("menu_item").alias("item"), "offer")
    return promotions.campaign_copy(offers, templates)


@query("promo_suggestions", DIPS + WEAK + SURPLUS + f"""
SELECT {LOC}, kind, subject, detail, rank FROM (
  SELECT location_id, 'sales_dip' AS kind, CAST(date AS VARCHAR) AS subject, severity AS detail,
         row_number() OVER (PARTITION BY location_id ORDER BY date) AS rank FROM v_dip
  UNION ALL SELECT location_id, 'daypart', menu_item, segment,
         row_number() OVER (PARTITION BY location_id ORDER BY menu_item, segment) FROM v_weak
  UNION ALL SELECT location_id, 'surplus', ingredient, segment,
         row_number() OVER (PARTITION BY location_id ORDER BY ingredient) FROM v_surplus) WHERE rank <= 5""")
def _(t):
    return promotions.suggestions(
        promotions.sales_dips(_daily(t)), promotions.weak_dayparts(dashboard.item_hours(t.sales)),
        promotions.surplus_stock(t.word_stock))


@query("promo_upcoming_events", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type || ' ' || event_id AS event, event_type || ' deal' AS suggested_offer,
       'Write about ' || event_type AS campaign_prompt
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-17'""")
def _(t):
    kind = F.col("event_type")
    rows = t.raw("events").select(
        F.to_date("ts").alias("date"), F.concat_ws(" ", kind, "event_id").alias("event"),
        F.concat(kind, F.lit(" deal")).alias("suggested_offer"), F.concat(F.lit("Write about "), kind).alias("campaign_prompt"))
    return promotions.upcoming_events(rows, dt.date(2024, 1, 10))


# -- usage and subscriptions ---------------------------------------------------------------------

DETAIL = """, v_detail AS (
  SELECT u.user_id, u.subscription_id, p.name AS plan_name, tokens_used, engagements_used,
         COALESCE(s.max_engagements_override, p.max_ai_engagements) AS max_engagements, is_trial, cycle_start, cycle_end,
         COALESCE(m.email, us.email) AS email, COALESCE(m.full_name, us.full_name) AS full_name
  FROM v_usage u JOIN v_subscription s ON u.subscription_id = s.id AND s.is_active JOIN v_plan p ON s.plan_id = p.id
  LEFT JOIN v_manager m ON u.user_id = m.id LEFT JOIN v_user us ON u.user_id = us.id)
"""


def _detail(t):
    return usage.usage_detail(t.usage, t.subscriptions, t.plans, t.managers, t.users)


@query("usage_detail", DETAIL + """
SELECT user_id, subscription_id, plan_name, tokens_used, engagements_used, max_engagements, is_trial,
       CAST(cycle_start AS VARCHAR) AS cycle_start, CAST(cycle_end AS VARCHAR) AS cycle_end, email, full_name FROM v_detail""")
def _(t):
    return _detail(t)


@query("usage_by_plan", DETAIL + """
SELECT plan_name, SUM(users)::BIGINT AS users, SUM(tokens)::BIGINT AS tokens, SUM(engagements)::BIGINT AS engagements,
       SUM(tokens)::DOUBLE / 1000.0::DOUBLE * 0.002::DOUBLE AS cost
FROM (SELECT plan_name, COUNT(DISTINCT user_id) AS users, SUM(tokens_used) AS tokens, SUM(engagements_used) AS engagements
      FROM v_detail WHERE cycle_start >= DATE '2000-01-01' AND cycle_end <= DATE '2000-12-31' GROUP BY plan_name)
GROUP BY GROUPING SETS ((plan_name), ())""")
def _(t):
    year = usage.usage_between(_detail(t), dt.date(2000, 1, 1), dt.date(2000, 12, 31))
    return usage.usage_by_plan(year)


@query("usage_current_cycle", """
SELECT u.user_id, u.subscription_id, tokens_used, engagements_used,
       COALESCE(s.max_engagements_override, p.max_ai_engagements, 10000) AS max_engagements,
       engagements_used::DOUBLE / COALESCE(s.max_engagements_override, p.max_ai_engagements, 10000) AS share_used
FROM v_usage u JOIN v_subscription s ON u.subscription_id = s.id LEFT JOIN v_plan p ON s.plan_id = p.id
WHERE DATE '2001-07-15' BETWEEN cycle_start AND cycle_end""")
def _(t):
    return usage.current_usage(t.usage, t.subscriptions, t.plans, dt.date(2001, 7, 15))


HISTORY_DAYS = """, v_eh AS (
  SELECT CAST(ts AS DATE) AS day, type, COUNT(*) AS engagements, SUM(tokens)::BIGINT AS tokens FROM v_engagement
  WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY 1, 2)
"""


@query("usage_engagement_history", HISTORY_DAYS + """
SELECT CAST(day AS VARCHAR) AS day, type, engagements, tokens FROM v_eh ORDER BY day DESC, type LIMIT 10 OFFSET 10""")
def _(t):
    h = usage.engagement_history(t.engagements, dt.date(2024, 1, 5), dt.date(2024, 1, 25))
    return usage.page(h, [F.col("day").desc(), F.col("type")], 10, 10)


@query("usage_accumulated", """
SELECT user_id, subscription_id, usage_type, SUM(amount)::BIGINT AS usage_count FROM v_usage_log GROUP BY 1, 2, 3""")
def _(t):
    return usage.accumulated(t.usage_log)


@query("usage_limit_checks", """
, v_plan_limit AS (
  SELECT id, 'ai_engagements' AS usage_type, max_ai_engagements AS usage_limit FROM v_plan
  UNION ALL SELECT id, 'restaurants', max_restaurants FROM v_plan UNION ALL SELECT id, 'integrations', max_integrations FROM v_plan)
SELECT s.user_id, l.usage_type, usage_limit, COALESCE(c.n, 0) AS current_usage, COALESCE(c.n >= usage_limit, false) AS limit_exceeded
FROM v_subscription s JOIN v_plan_limit l ON s.plan_id = l.id
LEFT JOIN (SELECT user_id, usage_type, SUM(amount)::BIGINT AS n FROM v_usage_log GROUP BY 1, 2) c
  ON s.user_id = c.user_id AND l.usage_type = c.usage_type WHERE s.is_active""")
def _(t):
    counts = usage.accumulated(t.usage_log).select("user_id", "usage_type", "usage_count")
    return usage.limit_checks(counts, t.subscriptions, t.plans)


@query("usage_trial_states", """
SELECT id, user_id, CAST(trial_end_date AS VARCHAR) AS trial_end_date, d::BIGINT AS days_left,
       CASE WHEN d < 0 THEN 'expired' WHEN d <= 1 THEN 'ending' ELSE 'reminder' END AS state
FROM (SELECT *, trial_end_date - DATE '2001-08-01' AS d FROM v_subscription WHERE is_trial AND is_active) WHERE d <= 3""")
def _(t):
    return usage.trial_states(t.subscriptions, AS_OF)


@query("usage_due_renewals", """
SELECT s.id, s.user_id, price::DOUBLE AS price, CAST(end_date AS VARCHAR) AS end_date,
       CAST(end_date + CASE WHEN is_yearly THEN 365 ELSE 30 END AS VARCHAR) AS next_end_date
FROM v_subscription s JOIN v_plan p ON s.plan_id = p.id
WHERE is_active AND NOT is_trial AND auto_renew AND end_date <= DATE '2001-08-01'""")
def _(t):
    return usage.due_renewals(t.subscriptions, t.plans, AS_OF)


@query("usage_trials_with_managers", """
SELECT s.user_id, s.id, CAST(trial_end_date AS VARCHAR) AS trial_end_date, d::BIGINT AS days_left,
       CASE WHEN d < 0 THEN 'expired' WHEN d <= 1 THEN 'ending' ELSE 'reminder' END AS state, m.email, m.full_name
FROM (SELECT *, trial_end_date - DATE '2001-08-01' AS d FROM v_subscription WHERE is_trial AND is_active) s
LEFT JOIN v_manager m ON s.user_id = m.id WHERE d <= 3""")
def _(t):
    return usage.with_manager(usage.trial_states(t.subscriptions, AS_OF), t.managers)


@query("usage_renewals_with_managers", """
SELECT s.user_id, s.id, price::DOUBLE AS price, CAST(end_date AS VARCHAR) AS end_date,
       CAST(end_date + CASE WHEN is_yearly THEN 365 ELSE 30 END AS VARCHAR) AS next_end_date, m.email, m.full_name
FROM v_subscription s JOIN v_plan p ON s.plan_id = p.id LEFT JOIN v_manager m ON s.user_id = m.id
WHERE is_active AND NOT is_trial AND auto_renew AND end_date <= DATE '2001-08-01'""")
def _(t):
    return usage.with_manager(usage.due_renewals(t.subscriptions, t.plans, AS_OF), t.managers)


@query("usage_subscription_history", """
SELECT s.id, s.user_id, p.name AS plan_name, price::DOUBLE AS price, is_active, is_trial, CAST(end_date AS VARCHAR) AS end_date
FROM v_subscription s JOIN v_plan p ON s.plan_id = p.id""")
def _(t):
    return usage.subscription_history(t.subscriptions, t.plans)


@query("usage_all_subscriptions_page", """
SELECT s.id, s.user_id, p.name AS plan_name, price::DOUBLE AS price, is_active, is_trial, CAST(end_date AS VARCHAR) AS end_date,
       COALESCE(m.email, u.email) AS email, COALESCE(m.full_name, u.full_name) AS full_name
FROM v_subscription s JOIN v_plan p ON s.plan_id = p.id LEFT JOIN v_manager m ON s.user_id = m.id
LEFT JOIN v_user u ON s.user_id = u.id WHERE is_active ORDER BY end_date DESC, s.id LIMIT 50 OFFSET 25""")
def _(t):
    rows = usage.all_subscriptions(t.subscriptions, t.plans, t.managers, t.users, active_only=True)
    return usage.page(rows, [F.col("end_date").desc(), F.col("id")], 50, 25)


@query("usage_far_page", """
SELECT id, user_id, type, is_read, position, total, unread FROM (
  SELECT id, user_id, type, is_read, row_number() OVER (ORDER BY created_at DESC, id) - 1 AS position,
         COUNT(*) OVER () AS total, COUNT(*) FILTER (NOT is_read) OVER () AS unread FROM v_notification)
WHERE position BETWEEN total // 2 AND total // 2 + 49""")
def _(t):
    path = shared_path(t.spark, "notifications")
    t.notifications.write.parquet(path)
    rows = t.spark.read.parquet(path)
    directory = pages.build(rows, [F.col("created_at").desc(), F.col("id")], shared_path(t.spark, "pages"), slice_rows=2000)
    unread = rows.agg(F.count_if(~F.col("is_read"))).scalar()
    return pages.page(t.spark, directory, 50, directory.total // 2).select(
        "id", "user_id", "type", "is_read", "position", F.lit(directory.total).cast("long").alias("total"), unread.alias("unread"))


METER = """, v_numbered AS (
  SELECT e.*, row_number() OVER (PARTITION BY user_id, cycle_start ORDER BY ts, engagement_id) AS nth FROM v_engagement e),
v_meter AS (
  SELECT n.engagement_id, n.user_id, n.cycle_start, nth, max_engagements AS lim FROM v_numbered n JOIN v_limit l ON n.user_id = l.user_id)
"""


@query("usage_metered", METER + """
SELECT engagement_id, user_id, CAST(cycle_start AS VARCHAR) AS cycle_start, LEAST(nth, lim) AS engagements_used,
       LEAST(nth, lim) * 600 AS tokens_used, nth <= lim AS accepted, LEAST(nth, lim)::DOUBLE / lim AS share_used,
       nth <= lim AND LEAST(nth, lim)::DOUBLE / lim >= 0.9 AND (nth - 1)::DOUBLE / lim < 0.9 AS alert FROM v_meter""")
def _(t):
    return usage.metered(t.engagements.select("engagement_id", "user_id", "cycle_start", "ts"), t.limits)


@query("usage_cycle_counters", METER + """
SELECT user_id, CAST(cycle_start AS VARCHAR) AS cycle_start, LEAST(COUNT(*), MAX(lim)) AS engagements_used,
       LEAST(COUNT(*), MAX(lim)) * 600 AS tokens_used FROM v_meter GROUP BY user_id, cycle_start""")
def _(t):
    return usage.cycle_counters(t.engagements, t.limits)


@query("set_union_people", """
SELECT id, email, full_name FROM v_manager UNION SELECT id, email, full_name FROM v_user""")
def _(t):
    return usage.people(t.managers, t.users)


@query("notification_counts", """
SELECT user_id, COUNT(*) AS total, COUNT(*) FILTER (NOT is_read) AS unread, COUNT(*) FILTER (is_read) AS read
FROM v_notification GROUP BY user_id""")
def _(t):
    return access.notification_counts(t.notifications)


@query("notification_page", """
SELECT id, user_id, type, is_read, CAST(created_at AS VARCHAR) AS created_at FROM v_notification
ORDER BY created_at DESC, id LIMIT 20 OFFSET 40""")
def _(t):
    return usage.page(t.notifications, [F.col("created_at").desc(), F.col("id")], 20, 40)


@query("latest_row_per_owner", """
SELECT id, user_id, type, is_read, CAST(created_at AS VARCHAR) AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM v_notification) WHERE r = 1""")
def _(t):
    return access.newest_per_owner(t.notifications, "user_id", "created_at")


# -- access --------------------------------------------------------------------------------------

STAFF = """, v_staff AS (
  SELECT r.name AS restaurant_name, l.name, l.position, MIN(employee_id) AS employee_id, l.location_id
  FROM v_labor l JOIN v_restaurant r ON l.location_id = r.id WHERE l.name IS NOT NULL GROUP BY 1, 2, 3, 5)
"""


@query("access_staff", STAFF + f"SELECT {LOC}, restaurant_name, name, position, employee_id FROM v_staff")
def _(t):
    return access.staff_of(t.restaurants, t.labor)


@query("access_scope", """
SELECT m.id AS manager_id, m.email, m.role, r.id::BIGINT AS restaurant_id, r.name AS restaurant_name, r.active
FROM v_manager m JOIN v_assignment a ON a.manager_id = m.id JOIN v_restaurant r ON r.id = a.restaurant_id""")
def _(t):
    return access.scope_of(t.managers, t.assignments, t.restaurants)


@query("access_managers_with_superior", """
SELECT m.id, m.email, m.role, m2.email AS regional_email, r.name AS restaurant_name
FROM v_manager m LEFT JOIN v_manager m2 ON m.regional_manager_id = m2.id LEFT JOIN v_assignment a ON a.manager_id = m.id
LEFT JOIN v_restaurant r ON r.id = a.restaurant_id AND r.active""")
def _(t):
    return access.managers_with_superior(t.managers, t.assignments, t.restaurants)


@query("access_inactive_restaurants", """
SELECT r.id::BIGINT AS id, r.name, c.email AS creator_email, d.email AS deactivator_email FROM v_restaurant r
LEFT JOIN v_manager c ON r.created_by = c.id LEFT JOIN v_manager d ON r.deactivated_by = d.id WHERE NOT r.active""")
def _(t):
    return access.inactive_restaurants(t.restaurants, t.managers)


@query("access_unassigned_restaurants", """
SELECT id::BIGINT AS id, name FROM v_restaurant r WHERE active
  AND NOT EXISTS (SELECT 1 FROM v_assignment a WHERE a.restaurant_id = r.id)""")
def _(t):
    return access.unassigned(t.restaurants, t.assignments)


@query("access_regional_without_manager", """
SELECT id::BIGINT AS id, name FROM v_restaurant r WHERE active
  AND EXISTS (SELECT 1 FROM v_assignment a JOIN v_manager m ON a.manager_id = m.id WHERE a.restaurant_id = r.id AND m.role = 'regional_manager')
  AND NOT EXISTS (SELECT 1 FROM v_assignment a JOIN v_manager m ON a.manager_id = m.id WHERE a.restaurant_id = r.id AND m.role = 'restaurant_manager')""")
def _(t):
    return access.regional_without_manager(t.restaurants, t.assignments, t.managers)


def _without(role):
    @query(f"access_without_{role}", f"""
SELECT id::BIGINT AS id, name FROM v_restaurant r WHERE active AND NOT EXISTS (
  SELECT 1 FROM v_assignment a JOIN v_manager m ON a.manager_id = m.id WHERE a.restaurant_id = r.id AND m.role = '{role}')""")
    def _(t):
        return access.without_role(t.restaurants, t.assignments, t.managers, role)


_without(access.REGIONAL)
_without(access.MANAGER)


@query("access_latest_document", """
SELECT r.id::BIGINT AS location_id, r.name, d.document, CAST(d.created_at AS VARCHAR) AS created_at FROM v_restaurant r
LEFT JOIN (SELECT user_id AS location_id, first(props ORDER BY ts DESC) AS document, MAX(ts) AS created_at FROM events GROUP BY 1) d
  ON r.id = d.location_id""")
def _(t):
    docs = t.raw("events").select(F.col("user_id").alias("location_id"), F.col("props").alias("document"), F.col("ts").alias("created_at"))
    return access.latest_document(t.restaurants, docs)


@query("access_store_ids", """
SELECT n.name, r.store_id, r.store_id IS NOT NULL AS is_store
FROM (SELECT 'NATION_' || l_linenumber AS name FROM lineitem GROUP BY 1) n
LEFT JOIN (SELECT name, store_id FROM v_restaurant WHERE active) r ON n.name = r.name""")
def _(t):
    names = t.raw("lineitem").select(F.concat(F.lit("NATION_"), F.col("l_linenumber").cast("string")).alias("name")).distinct()
    return access.store_ids(t.restaurants, names)


@query("access_manager_counts", """
SELECT r.id::BIGINT AS id, r.name, COUNT(a.manager_id) AS managers FROM v_restaurant r
LEFT JOIN v_assignment a ON a.restaurant_id = r.id GROUP BY 1, 2""")
def _(t):
    return access.manager_counts(t.restaurants, t.assignments)


@query("access_restaurants_per_manager", """
SELECT m.id, m.email, CAST(0 AS BIGINT) AS page, COALESCE(string_agg(DISTINCT r.name, ', ' ORDER BY r.name), '') AS restaurants
FROM v_manager m LEFT JOIN v_assignment a ON a.manager_id = m.id LEFT JOIN v_restaurant r ON r.id = a.restaurant_id AND r.active
GROUP BY m.id, m.email""")
def _(t):
    return access.restaurants_per_manager(t.managers, t.assignments, t.restaurants)


@query("access_role_counts", f"""
SELECT {LOC}, position, COUNT(DISTINCT name) AS staff FROM v_labor GROUP BY location_id, position""")
def _(t):
    return access.role_counts(t.labor)


@query("access_affected_emails", """
SELECT DISTINCT a.restaurant_id::BIGINT AS restaurant_id, x.email
FROM v_assignment a JOIN v_manager m ON a.manager_id = m.id
JOIN (SELECT id, email FROM v_manager UNION ALL
      SELECT m.id, s.email FROM v_manager m JOIN v_manager s ON m.regional_manager_id = s.id) x ON x.id = m.id""")
def _(t):
    return access.affected_emails(t.restaurants, t.assignments, t.managers)


@query("access_staff_directory", STAFF + """
SELECT restaurant_name, position, CAST(0 AS BIGINT) AS page, string_agg(name, ', ' ORDER BY name) AS names
FROM v_staff GROUP BY 1, 2""")
def _(t):
    return access.staff_directory(t.restaurants, t.labor)


@query("access_one_row_per_manager", """
SELECT id, email, role, regional_manager_id FROM v_manager""")
def _(t):
    rows = t.managers.select("id", "email", "role", "regional_manager_id")
    return access.one_per_id(rows.join(t.assignments.select(F.col("manager_id").alias("id")), "id", "left"))


# -- vectors and text ----------------------------------------------------------------------------

@query("vector_top_k", """, v_cell AS (
  SELECT category, i, AVG(x::DOUBLE) AS m FROM (SELECT category, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM v_chunk)
  GROUP BY 1, 2),
v_query AS (SELECT category, list(m ORDER BY i) AS q FROM v_cell GROUP BY category)
SELECT category::BIGINT AS query_id, category::BIGINT AS category, chunk_id, ROUND(similarity, 6) AS similarity, rank
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY similarity DESC, chunk_id) AS rank
      FROM (SELECT c.category, c.chunk_id, list_cosine_similarity(c.embedding::DOUBLE[], q.q) AS similarity
            FROM v_chunk c JOIN v_query q ON c.category = q.category)) WHERE rank <= 5""")
def _(t):
    queries = vectors.centroids(t.chunks, "category").withColumn("query_id", F.col("category"))
    return vectors.similar_chunks(t.chunks, queries, ["category"]).withColumn("similarity", F.round("similarity", 6))


@query("vector_similar_history", """, v_first AS (
  SELECT owner_id, filename, first(embedding ORDER BY chunk_id) AS q, MIN(chunk_id) AS query_id FROM v_chunk GROUP BY 1, 2)
SELECT query_id, owner_id::BIGINT AS owner_id, chunk_id, ROUND(similarity, 6) AS similarity, rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, owner_id ORDER BY similarity DESC, chunk_id) AS rank
      FROM (SELECT f.query_id, c.owner_id, c.chunk_id, list_cosine_similarity(c.embedding::DOUBLE[], f.q::DOUBLE[]) AS similarity
            FROM v_chunk c JOIN v_first f ON c.owner_id = f.owner_id)) WHERE rank <= 10""")
def _(t):
    first = t.chunks.groupBy("owner_id", "filename").agg(
        F.min_by("embedding", "chunk_id").alias("embedding"), F.min("chunk_id").alias("query_id"))
    return vectors.similar_chunks(t.chunks, first, ["owner_id"], k=10).withColumn("similarity", F.round("similarity", 6))


@query("vector_index_top_k", """, v_e AS (
  SELECT vec_id AS id, label % 2 AS owner_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL),
v_u AS (SELECT id, owner_id, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS u FROM v_e WHERE list_dot_product(e, e) > 0),
v_d AS (SELECT owner_id, u, min(id) AS vec, list(id ORDER BY id) AS ids FROM v_u GROUP BY owner_id, u),
v_plane AS (
  SELECT t, b, list(CASE WHEN md5(t || ':' || b || ':' || d)[1] < '8' THEN 1.0::DOUBLE ELSE -1.0 END ORDER BY d) AS s
  FROM range(16) x(t), range(32) y(b), range(64) z(d) GROUP BY t, b),
v_margin AS (SELECT owner_id, vec, u, t, b, list_dot_product(u, s) AS m FROM v_d, v_plane),
v_code AS (SELECT owner_id, vec, t, sum(CASE WHEN m > 0 THEN 1::BIGINT << (31 - b) ELSE 0 END)::BIGINT AS code FROM v_margin GROUP BY ALL),
v_start AS (
  SELECT owner_id, CASE WHEN count(*) < 128 THEN 0 ELSE least(32, ceil(length(bin(count(*) // 128)) / 4) * 4) END AS first FROM v_d GROUP BY 1),
v_depth AS (SELECT unnest(range(0, 33, 4)) AS depth),
v_at AS (
  SELECT owner_id, vec, t, depth, code >> (32 - depth) AS prefix FROM v_code JOIN v_start USING (owner_id), v_depth WHERE depth >= first),
v_bucket AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY owner_id, t, depth, prefix) AS n FROM v_at) WHERE n <= 128 OR depth = 32
  QUALIFY row_number() OVER (PARTITION BY owner_id, vec, t ORDER BY depth) = 1),
v_asked AS (SELECT id AS query_id, owner_id, vec, u FROM v_u JOIN v_d USING (owner_id, u) WHERE id % 100 = 0),
v_near AS (
  SELECT owner_id, vec, t, depth, b, row_number() OVER (PARTITION BY owner_id, vec, t, depth ORDER BY abs(m), b) AS r
  FROM v_margin, v_depth WHERE b < depth),
v_look AS (
  SELECT owner_id, vec, t, depth, code >> (32 - depth) AS prefix FROM v_code, v_depth
  UNION ALL SELECT owner_id, vec, t, depth, xor(code >> (32 - depth), 1::BIGINT << (depth - 1 - b)) FROM v_near JOIN v_code USING (owner_id, vec, t) WHERE r < 8),
v_met AS (
  SELECT DISTINCT a.query_id, a.owner_id, k.vec FROM v_asked a JOIN v_look l USING (owner_id, vec)
  JOIN v_bucket k ON k.owner_id = l.owner_id AND k.t = l.t AND k.depth = l.depth AND k.prefix = l.prefix),
v_scored AS (
  SELECT query_id, m.owner_id, unnest(ids) AS chunk_id, list_dot_product(d.u, a.u) AS similarity
  FROM v_met m JOIN v_d d USING (owner_id, vec) JOIN v_asked a USING (query_id))
SELECT query_id, owner_id::BIGINT AS owner_id, chunk_id, ROUND(similarity, 6) AS similarity, rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM v_scored) WHERE rank <= 10""")
def _(t):
    index = vector_index.build(t.chunks, ["owner_id"])
    asked = t.chunks.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    return vector_index.similar_chunks(index, asked, k=10).withColumn("similarity", F.round("similarity", 6))


@query("vector_catalog", """
SELECT owner_id::BIGINT AS owner_id, category::BIGINT AS category, filename, COUNT(DISTINCT chunk_id) AS chunks,
       CAST(MAX(created_at) AS VARCHAR) AS last_update FROM v_chunk GROUP BY 1, 2, 3""")
def _(t):
    return vectors.catalog(t.chunks)


@query("vector_reduced_norm", """
SELECT vec_id, ROUND(sqrt(list_sum(list_transform(r, lambda x: x * x))), 6) AS norm, ROUND(r[1] / sqrt(list_sum(list_transform(r, lambda x: x * x))), 6) AS first
FROM (SELECT vec_id, list_transform(range(0, 21), lambda i: (e[3 * i + 1] + e[3 * i + 2] + e[3 * i + 3]) / 3) AS r
      FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""")
def _(t):
    # scaled to length one: the norm before scaling is taken from the first cell
    e = vectors.doubles("embedding")
    cell = (F.get(e, F.lit(0)) + F.get(e, F.lit(1)) + F.get(e, F.lit(2))) / 3
    first = F.get(F.col("r"), F.lit(0))
    return vectors.with_reduced(t.raw("embeddings"), "embedding", "r").select(
        "vec_id", F.round(cell / first, 6).alias("norm"), F.round(first, 6).alias("first"))


@query("vector_reduced_whole", """
SELECT vec_id, unnest(range(0, len(r)))::BIGINT AS cell, ROUND(unnest(r) / n, 6) AS value
FROM (SELECT vec_id, list_resize(r, 1024, 0) AS r, sqrt(list_sum(list_transform(r, lambda x: x * x))) AS n
      FROM (SELECT vec_id, list_transform(range(0, 21), lambda i: (e[3 * i + 1] + e[3 * i + 2] + e[3 * i + 3]) / 3) AS r
            FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)))""")
def _(t):
    cells = vectors.with_reduced(t.raw("embeddings"), "embedding", "r").select("vec_id", F.posexplode("r").alias("cell", "value"))
    return cells.withColumn("value", F.round("value", 6))


@query("vector_not_embedded", """
SELECT DISTINCT 'file' || p_size AS filename FROM part WHERE 'file' || p_size NOT IN (SELECT filename FROM v_chunk)""")
def _(t):
    files = t.raw("part").select(F.concat(F.lit("file"), F.col("p_size").cast("string")).alias("filename")).distinct()
    return vectors.not_embedded(files, t.chunks, ["filename"])


@query("vector_already_embedded", """
SELECT DISTINCT 'file' || p_size AS filename FROM part WHERE 'file' || p_size IN (SELECT filename FROM v_chunk)""")
def _(t):
    files = t.raw("part").select(F.concat(F.lit("file"), F.col("p_size").cast("string")).alias("filename")).distinct()
    return vectors.already_embedded(files, t.chunks, ["filename"])


@query("vector_resolved_names", """
SELECT DISTINCT lower(n_name) AS name, n_name AS resolved FROM nation""")
def _(t):
    asked = t.raw("nation").select(F.lower("n_name").alias("name")).distinct()
    return vectors.resolve_names(asked, t.raw("nation").select(F.col("n_name").alias("name")), "name")


@query("text_row_chunks", """, v_row AS (
  SELECT c_nationkey, c_custkey, 'c_custkey: ' || c_custkey || ' c_name: ' || c_name || ' c_mktsegment: ' || c_mktsegment AS line,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer)
SELECT c_nationkey::BIGINT AS c_nationkey, (rn - 1) // 20 AS chunk_id, string_agg(line, chr(10) ORDER BY rn) AS text, COUNT(*) AS rows
FROM v_row GROUP BY 1, 2""")
def _(t):
    rows = vectors.row_text(t.raw("customer"), ["c_custkey", "c_name", "c_mktsegment"])
    return vectors.row_chunks(rows, ["c_nationkey"], "c_custkey")


@query("text_fixed_chunks", """
SELECT doc_id, i::BIGINT AS chunk_id, substring(text, i * 1000 + 1, 1000) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i FROM documents)""")
def _(t):
    return vectors.text_chunks(t.raw("documents"), ["doc_id"], "text")


@query("text_fixed_chunks_of_1500", """
SELECT doc_id, i::BIGINT AS chunk_id, substring(text, i * 1500 + 1, 1500) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1500.0) AS BIGINT))) AS i FROM documents)""")
def _(t):
    return vectors.text_chunks(t.raw("documents"), ["doc_id"], "text", 1500)


@query("text_conversations_newest_first", """
SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS position,
       MAX(turn) OVER (PARTITION BY conv_id) AS last_turn, COUNT(*) OVER (PARTITION BY conv_id) AS messages FROM conversations""")
def _(t):
    return vectors.conversations_newest_first(t.raw("conversations"), "conv_id", "turn")
