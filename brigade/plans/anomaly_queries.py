"""Anomalies, efficiency, risk, causes and notices over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brigade.operators import anomaly, causes, efficiency, notices, risk
from brigade.plans.registry import query
from brigade.plans.views import AS_OF

LOC = "location_id::BIGINT AS location_id"

# z-scores of the sample stay below the default of 12, so the queries state a lower threshold
HIGH_Z = 1.5

VIEWS = """, v_loc AS (
  SELECT location_id, COUNT(*) AS n, SUM(total_amount)::DOUBLE / COUNT(total_amount) AS mean_amount,
         stddev_samp(total_amount::DOUBLE) AS std_amount FROM v_sales GROUP BY location_id),
v_hours AS (SELECT location_id, hour, COUNT(*) AS cnt FROM v_sales WHERE hour IS NOT NULL GROUP BY 1, 2),
v_busy AS (
  SELECT h.location_id, h.hour, h.cnt FROM v_hours h
  JOIN (SELECT location_id, quantile_cont(cnt, 0.25) AS cut FROM v_hours GROUP BY location_id) c
    ON h.location_id = c.location_id WHERE cnt > cut),
v_method AS (
  SELECT location_id, payment_method, COUNT(*) AS n,
         COUNT(*)::DOUBLE / (SUM(COUNT(*)) OVER (PARTITION BY location_id))::DOUBLE AS method_share
  FROM v_sales WHERE payment_method IS NOT NULL GROUP BY 1, 2),
v_emp AS (
  SELECT location_id, employee_id, COUNT(*) AS n, SUM(total_amount)::DOUBLE / COUNT(total_amount) AS mean_amount,
         stddev_samp(total_amount::DOUBLE) AS std_amount
  FROM v_sales WHERE employee_id IS NOT NULL GROUP BY 1, 2),
v_scored AS (
  SELECT s.*, CASE WHEN l.std_amount > 0 THEN (total_amount::DOUBLE - l.mean_amount) / l.std_amount END AS z,
         CASE WHEN e.std_amount > 0 THEN (total_amount::DOUBLE - e.mean_amount) / e.std_amount END AS ez, e.n AS en,
         b.hour IS NULL AS off_all,
         b.hour IS NULL OR b.hour IN (0, 1, 2, 3, 4, 5, 23) AS off_hours, m.method_share
  FROM v_sales s JOIN v_loc l ON s.location_id = l.location_id
  LEFT JOIN v_emp e ON s.location_id = e.location_id AND s.employee_id = e.employee_id
  LEFT JOIN v_busy b ON s.location_id = b.location_id AND s.hour = b.hour
  LEFT JOIN v_method m ON s.location_id = m.location_id AND s.payment_method = m.payment_method),
v_anomaly AS (
  SELECT location_id, 'high_value_transactions' AS category, NULL AS pattern, sale_id, employee_id, total_amount AS amount,
         date, hour, z AS score, CASE WHEN z > 5 THEN 'high' ELSE 'medium' END AS severity FROM v_scored WHERE z > 1.5
  UNION ALL
  SELECT location_id, 'unusual_time_transactions', NULL, sale_id, employee_id, total_amount, date, hour, NULL, 'medium'
  FROM v_scored WHERE off_hours
  UNION ALL
  SELECT s.location_id, 'employee_pattern_anomalies', 'repeated_identical_transactions', sale_id, s.employee_id,
         s.total_amount, date, hour, c::DOUBLE, CASE WHEN c >= 5 THEN 'high' ELSE 'medium' END
  FROM v_sales s JOIN (SELECT location_id, employee_id, total_amount, COUNT(*) AS c FROM v_sales
                       WHERE employee_id IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) >= 10) r
    ON s.location_id = r.location_id AND s.employee_id = r.employee_id AND s.total_amount = r.total_amount
  UNION ALL
  SELECT location_id, 'employee_pattern_anomalies', 'unusual_transaction', sale_id, employee_id, total_amount, date, hour,
         ez, CASE WHEN abs(ez) > 5 THEN 'high' ELSE 'medium' END FROM v_scored WHERE en >= 8 AND abs(ez) > 2
  UNION ALL
  SELECT location_id, 'payment_method_anomalies', NULL, sale_id, employee_id, total_amount, date, hour, method_share, 'low'
  FROM v_scored WHERE method_share < 0.1 OR payment_method IN ('Bitcoin', 'Cryptocurrency', 'Gift Card', 'Wire Transfer')
  UNION ALL
  SELECT location_id, 'discount_anomalies', NULL, sale_id, employee_id, total_amount, date, hour, discount_percent::DOUBLE,
         CASE WHEN discount_percent > 50 THEN 'medium' ELSE 'low' END FROM v_scored WHERE discount_percent > 20)
"""
ROW = f"""SELECT {LOC}, category, pattern, sale_id, employee_id, amount::DOUBLE AS amount, CAST(date AS VARCHAR) AS date,
       hour::BIGINT AS hour, ROUND(score, 6) AS score, severity FROM v_anomaly"""


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


def _anomaly(name, where, run):
    query(name, VIEWS + ROW + f" WHERE {where}")(lambda t: _rounded(run(t)))


_anomaly("anomaly_high_value", "category = 'high_value_transactions'", lambda t: anomaly.high_value(t.sales, HIGH_Z))
_anomaly("anomaly_unusual_time", "category = 'unusual_time_transactions'", lambda t: anomaly.unusual_time(t.sales))
_anomaly("anomaly_employee_outliers", "pattern = 'unusual_transaction'", lambda t: anomaly.employee_outliers(t.sales))
_anomaly("anomaly_unusual_payment", "category = 'payment_method_anomalies'", lambda t: anomaly.unusual_payment(t.sales))
_anomaly("anomaly_high_discount", "category = 'discount_anomalies'", lambda t: anomaly.high_discount(t.sales))
_anomaly("anomaly_all", "true", lambda t: anomaly.all_anomalies(t.sales, HIGH_Z))


# amounts of the sample hardly repeat; whole thousands per employee do
REPEATED = """, v_thousands AS (SELECT * REPLACE (CAST(floor(total_amount / 100000) * 100000 AS DECIMAL(18,2)) AS total_amount) FROM v_sales)
"""


def _thousands(t):
    return t.sales.withColumn("total_amount", (F.floor(F.col("total_amount") / 100000) * 100000).cast("decimal(18,2)"))


@query("anomaly_repeated_identical", REPEATED + f"""
SELECT s.{LOC}, 'employee_pattern_anomalies' AS category, 'repeated_identical_transactions' AS pattern, sale_id,
       s.employee_id, s.total_amount::DOUBLE AS amount, CAST(date AS VARCHAR) AS date, hour::BIGINT AS hour,
       c::DOUBLE AS score, CASE WHEN c >= 5 THEN 'high' ELSE 'medium' END AS severity
FROM v_thousands s JOIN (SELECT location_id, employee_id, total_amount, COUNT(*) AS c FROM v_thousands
                         WHERE employee_id IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) >= 3) r
  ON s.location_id = r.location_id AND s.employee_id = r.employee_id AND s.total_amount = r.total_amount""")
def _(t):
    return anomaly.repeated_identical(_thousands(t), at_least=3)


@query("anomaly_baseline", VIEWS + f"""
SELECT {LOC}, mean_amount, ROUND(std_amount, 4) AS std_amount, '2001-08-01' AS as_of FROM v_loc""")
def _(t):
    return anomaly.baseline(t.sales, AS_OF).withColumn("std_amount", F.round("std_amount", 4))


@query("window_location_z_score", VIEWS + f"SELECT {LOC}, sale_id, ROUND(z, 6) AS z_score FROM v_scored")
def _(t):
    return anomaly.with_z(t.sales, "location_id").select("location_id", "sale_id", F.round("z_score", 6).alias("z_score"))


@query("window_employee_z_score", VIEWS + f"""
SELECT {LOC}, sale_id, ROUND(ez, 6) AS z_score FROM v_scored WHERE employee_id IS NOT NULL""")
def _(t):
    known = t.sales.where(F.col("employee_id").isNotNull())
    return anomaly.with_z(known, "location_id", "employee_id").select("location_id", "sale_id", F.round("z_score", 6).alias("z_score"))


@query("window_method_share", VIEWS + f"SELECT {LOC}, payment_method, n, method_share FROM v_method")
def _(t):
    return anomaly.method_shares(t.sales)


@query("anomaly_business_hours", VIEWS + f"""
SELECT {LOC}, hour::BIGINT AS hour, cnt FROM v_busy WHERE hour NOT IN (0, 1, 2, 3, 4, 5, 23)""")
def _(t):
    return anomaly.business_hours(t.sales)


RATES = """COUNT(sale_id) AS transaction_count, SUM(total_amount)::DOUBLE AS revenue, SUM(number_of_items)::BIGINT AS items_sold,
       SUM(number_of_items)::DOUBLE / COUNT(sale_id) AS items_per_transaction,
       SUM(total_amount)::DOUBLE / COUNT(sale_id) AS revenue_per_transaction"""


@query("efficiency_sales_velocity", f"""
SELECT {LOC}, CAST(date AS VARCHAR) AS date, hour::BIGINT AS hour, {RATES} FROM v_sales GROUP BY location_id, date, hour""")
def _(t):
    return efficiency.sales_velocity(t.sales)


@query("efficiency_hour_summary", f"""
SELECT {LOC}, hour::BIGINT AS hour, {RATES} FROM v_sales GROUP BY location_id, hour""")
def _(t):
    return efficiency.hour_summary(t.sales)


PEAK = """, v_hr AS (SELECT location_id, hour, COUNT(sale_id) AS cnt, SUM(total_amount) AS revenue FROM v_sales GROUP BY 1, 2),
v_cut AS (SELECT location_id, quantile_cont(cnt, 0.8) AS cut FROM v_hr GROUP BY location_id),
v_peak AS (
  SELECT h.location_id, string_agg(hour::VARCHAR, '|' ORDER BY hour) FILTER (cnt >= cut) AS peak_hours,
         (SUM(revenue) FILTER (cnt >= cut))::DOUBLE / SUM(revenue)::DOUBLE * 100 AS peak_revenue_pct
  FROM v_hr h JOIN v_cut c ON h.location_id = c.location_id GROUP BY h.location_id)
"""


@query("efficiency_peak_hours", PEAK + f"SELECT {LOC}, peak_hours, peak_revenue_pct FROM v_peak")
def _(t):
    return efficiency.peak_hours(t.sales)


@query("efficiency_employees", f"""
SELECT s.*, l.name, l.role FROM (SELECT {LOC}, employee_id, {RATES} FROM v_sales WHERE employee_id IS NOT NULL
                                 GROUP BY location_id, employee_id) s
LEFT JOIN v_labor l ON s.location_id = l.location_id AND s.employee_id = l.employee_id""")
def _(t):
    return efficiency.employee_efficiency(t.sales, t.labor)


@query("efficiency_order_types", f"SELECT {LOC}, order_type, {RATES} FROM v_sales GROUP BY location_id, order_type")
def _(t):
    return efficiency.order_type_efficiency(t.sales)


@query("efficiency_payment_methods", f"SELECT {LOC}, payment_method, {RATES} FROM v_sales GROUP BY location_id, payment_method")
def _(t):
    return efficiency.payment_efficiency(t.sales)


MENTION = """, v_mention AS (
  SELECT b.location_id, w.ingredient, SUM(b.units)::BIGINT AS usage_count
  FROM v_base b JOIN v_words w ON b.location_id = w.location_id AND contains(lower(b.menu_item), lower(w.ingredient))
  GROUP BY 1, 2)
"""


@query("join_ingredient_in_item_text", MENTION + f"SELECT {LOC}, ingredient, usage_count FROM v_mention")
def _(t):
    return efficiency.ingredient_mentions(t.sales, t.word_stock)


@query("efficiency_ingredient_turnover", MENTION + """
SELECT m.location_id::BIGINT AS location_id, m.ingredient, quantity AS average_quantity, usage_count,
       usage_count::DOUBLE / quantity AS turnover_ratio
FROM v_mention m JOIN v_words w ON m.location_id = w.location_id AND m.ingredient = w.ingredient""")
def _(t):
    return efficiency.ingredient_turnover(t.sales, t.word_stock)


SCORE = PEAK + f""", v_score AS (
  SELECT p.location_id, (LEAST(25, vel * 5) + peak_revenue_pct * 0.25 + LEAST(25, staff * 0.25) + LEAST(25, ords * 5)) / 4 * 4 AS score
  FROM v_peak p
  JOIN (SELECT location_id, AVG(items_per_transaction) AS vel FROM (SELECT location_id, {RATES} FROM v_sales GROUP BY location_id, date, hour) GROUP BY 1) a ON p.location_id = a.location_id
  JOIN (SELECT location_id, AVG(revenue_per_transaction) AS staff FROM (SELECT location_id, {RATES} FROM v_sales WHERE employee_id IS NOT NULL GROUP BY location_id, employee_id) GROUP BY 1) b ON p.location_id = b.location_id
  JOIN (SELECT location_id, AVG(items_per_transaction) AS ords FROM (SELECT location_id, {RATES} FROM v_sales GROUP BY location_id, order_type) GROUP BY 1) c ON p.location_id = c.location_id)
"""


@query("efficiency_score", SCORE + f"SELECT {LOC}, ROUND(score, 4) AS efficiency_score FROM v_score")
def _(t):
    return efficiency.efficiency_score(t.sales).withColumn("efficiency_score", F.round("efficiency_score", 4))


@query("insight_transactions_by_hour", f"""
SELECT {LOC}, hour::BIGINT AS hour, SUM(c)::DOUBLE / COUNT(*) AS average_transactions
FROM (SELECT location_id, date, hour, COUNT(*) AS c FROM v_sales GROUP BY 1, 2, 3) GROUP BY location_id, hour""")
def _(t):
    return efficiency.transactions_by_hour(t.sales)


@query("insight_top_employees", f"""
SELECT {LOC}, employee_id, revenue::DOUBLE AS revenue, transaction_count, rank
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY revenue DESC, employee_id) AS rank
      FROM (SELECT location_id, employee_id, SUM(total_amount) AS revenue, COUNT(*) AS transaction_count FROM v_sales
            WHERE employee_id IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 5""")
def _(t):
    return efficiency.top_employees(t.sales)


RISK = VIEWS + """, v_risk AS (
  SELECT *, (COALESCE(z > 3, false))::INT + off_all::INT + (COALESCE(discount_percent > 25, false))::INT
            + (COALESCE(method_share < 0.05, false))::INT AS risk_score,
         concat_ws('|', CASE WHEN z > 3 THEN 'high_value' END, CASE WHEN off_all THEN 'unusual_time' END,
                   CASE WHEN discount_percent > 25 THEN 'high_discount' END,
                   CASE WHEN method_share < 0.05 THEN 'rare_payment' END) AS risk_factors
  FROM v_scored)
"""


@query("risk_transactions", RISK + f"""
SELECT {LOC}, sale_id, employee_id, total_amount::DOUBLE AS amount, CAST(date AS VARCHAR) AS date, hour::BIGINT AS hour,
       risk_score::BIGINT AS risk_score, risk_factors, CASE WHEN risk_score >= 3 THEN 'high' ELSE 'medium' END AS severity
FROM v_risk WHERE risk_score >= 1""")
def _(t):
    return risk.risk_transactions(t.sales)


PATTERN = REPEATED + """, v_pattern AS (
  SELECT p.location_id, p.total_amount, p.employee_id, c AS occurrence_count
  FROM (SELECT location_id, total_amount, employee_id, COUNT(*) AS c FROM v_thousands WHERE employee_id IS NOT NULL
        GROUP BY 1, 2, 3 HAVING COUNT(*) > 2) p
  JOIN (SELECT location_id, total_amount FROM v_thousands GROUP BY 1, 2 HAVING COUNT(*) > 3) a
    ON p.location_id = a.location_id AND p.total_amount = a.total_amount
  JOIN (SELECT location_id FROM v_thousands GROUP BY 1 HAVING COUNT(*) > 10) n ON n.location_id = p.location_id)
"""


@query("risk_repeated_amounts", PATTERN + f"""
SELECT {LOC}, 'repeated_amount' AS pattern_type, total_amount::DOUBLE AS amount, employee_id, occurrence_count,
       CASE WHEN occurrence_count > 5 THEN 'medium' ELSE 'low' END AS severity FROM v_pattern""")
def _(t):
    return risk.repeated_amounts(_thousands(t))


@query("risk_repeated_amount_sales", PATTERN + """
SELECT s.location_id::BIGINT AS location_id, s.employee_id, s.total_amount::DOUBLE AS amount, sale_id
FROM v_thousands s JOIN v_pattern p ON s.location_id = p.location_id AND s.employee_id = p.employee_id
  AND s.total_amount = p.total_amount""")
def _(t):
    return risk.repeated_amount_sales(_thousands(t))


EMPLOYEE = VIEWS + """, v_emp_risk AS (
  SELECT s.location_id, s.employee_id, COUNT(*) AS transaction_count, SUM(total_amount)::DOUBLE / COUNT(*) AS average_amount,
         SUM(total_amount)::DOUBLE / COUNT(*) > MAX(l.mean_amount) + MAX(l.std_amount) AS f1,
         COUNT(*) FILTER (discount_percent > 0)::DOUBLE / COUNT(*) * 100 > 50 AS f2,
         COUNT(*) FILTER (off_all)::DOUBLE / COUNT(*) * 100 > 20 AS f3
  FROM v_scored s JOIN v_loc l ON s.location_id = l.location_id WHERE s.employee_id IS NOT NULL GROUP BY 1, 2),
v_emp_risk2 AS (
  SELECT e.*, f1::INT + f2::INT + f3::INT AS risk_score,
         concat_ws('|', CASE WHEN f1 THEN 'high_average_amount' END, CASE WHEN f2 THEN 'high_discount_frequency' END,
                   CASE WHEN f3 THEN 'unusual_hours' END) AS risk_factors
  FROM v_emp_risk e WHERE transaction_count >= 5)
"""


@query("risk_employees", EMPLOYEE + """
SELECT e.location_id::BIGINT AS location_id, e.employee_id, l.name, l.role, risk_score::BIGINT AS risk_score, risk_factors,
       transaction_count, average_amount,
       CASE WHEN risk_score >= 3 THEN 'high' WHEN risk_score = 2 THEN 'medium' ELSE 'low' END AS severity
FROM v_emp_risk2 e LEFT JOIN v_labor l ON e.location_id = l.location_id AND e.employee_id = l.employee_id
WHERE risk_score > 0""")
def _(t):
    return risk.employee_risk(t.sales, t.labor)


ADVICE = {
    "c1": ("large_number_of_items", "Review transaction for potential item miscounting or order splitting"),
    "c2": ("high_discount_percentage", "Verify discount authorization and policy compliance"),
    "c3": ("rare_payment_method", "Confirm payment method validity and authorization"),
    "e1": ("high_percentage_unusual_transactions", "Review employee transaction history and provide additional training"),
    "e2": ("unusual_working_hours", "Verify employee schedule and authorization for off-hours work"),
    "e3": ("new_employee", "Provide additional training and supervision for new employee"),
    "i1": ("low_inventory_level", "Restock inventory item and review ordering schedule"),
    "i2": ("high_usage_ingredient", "Increase par level for frequently used ingredient"),
}


def _texts(*flags):
    names = "concat_ws('|', " + ", ".join(f"CASE WHEN {f} THEN '{ADVICE[f][0]}' END" for f in flags) + ") AS causes"
    said = "concat_ws('; ', " + ", ".join(f"CASE WHEN {f} THEN '{ADVICE[f][1]}' END" for f in flags) + ")"
    return f"{names}, CASE WHEN {said} = '' THEN 'No specific recommendations available' ELSE {said} END AS recommendation"


TRANSACTION = VIEWS + f""", v_tcause AS (
  SELECT a.location_id, a.sale_id, a.category AS anomaly_type, {_texts("c1", "c2", "c3")}
  FROM v_anomaly a JOIN (SELECT sale_id, number_of_items > 10 AS c1, discount_percent > 25 AS c2, method_share < 0.05 AS c3
                         FROM v_scored) s ON a.sale_id = s.sale_id
  WHERE a.category IN ('high_value_transactions', 'payment_method_anomalies', 'discount_anomalies'))
"""


@query("cause_transactions", TRANSACTION + f"SELECT {LOC}, sale_id, anomaly_type, causes, recommendation FROM v_tcause")
def _(t):
    return causes.transaction_causes(t.anomalies, t.sales)


ECAUSE = VIEWS + f""", v_ecause AS (
  SELECT a.location_id, a.employee_id, l.name, l.role, a.anomalies, {_texts("e1", "e2", "e3")}
  FROM (SELECT location_id, employee_id, COUNT(*) AS anomalies FROM v_anomaly WHERE category = 'employee_pattern_anomalies'
        GROUP BY 1, 2) a
  JOIN (SELECT location_id, employee_id, COUNT(*) FILTER (abs(ez) > 3)::DOUBLE / COUNT(*) > 0.2 AS e1,
               COUNT(*) FILTER (off_hours)::DOUBLE / COUNT(*) > 0.2 AS e2 FROM v_scored WHERE employee_id IS NOT NULL
        GROUP BY 1, 2) p ON a.location_id = p.location_id AND a.employee_id = p.employee_id
  LEFT JOIN (SELECT *, DATE '2001-08-01' - hire_date < 30 AS e3 FROM v_labor) l
    ON a.location_id = l.location_id AND a.employee_id = l.employee_id)
"""


@query("cause_employees", ECAUSE + f"SELECT {LOC}, employee_id, name, role, anomalies, causes, recommendation FROM v_ecause")
def _(t):
    return causes.employee_causes(t.anomalies, t.sales, t.labor, AS_OF)


NAMED = """, v_named AS (
  SELECT w.location_id, w.ingredient, COUNT(DISTINCT i.sale_id) AS sales_with
  FROM v_items i JOIN v_words w ON i.location_id = w.location_id AND contains(lower(i.menu_item), lower(w.ingredient))
  GROUP BY 1, 2),
v_share AS (
  SELECT n.*, sales_with::DOUBLE / sales AS sale_share FROM v_named n
  JOIN (SELECT location_id, COUNT(*) AS sales FROM v_sales GROUP BY 1) s ON n.location_id = s.location_id)
"""


@query("join_ingredient_in_sale_text", NAMED + f"SELECT {LOC}, ingredient, sales_with, sale_share FROM v_share")
def _(t):
    return causes.ingredient_sale_share(t.sales, t.word_stock)


@query("cause_inventory", NAMED + f"""
SELECT {LOC}, ingredient, quantity, par_level, inventory_ratio, {_texts("i1", "i2")}
FROM (SELECT w.location_id, w.ingredient, quantity, par_level, quantity / par_level AS inventory_ratio, true AS i1,
             COALESCE(sale_share > 0.1, false) AS i2
      FROM v_words w LEFT JOIN v_share s ON w.location_id = s.location_id AND w.ingredient = s.ingredient
      WHERE quantity / par_level < 0.9)""")
def _(t):
    return causes.inventory_causes(t.sales, t.word_stock, ratio_below=0.9)


CLUSTER = VIEWS + """, v_hit AS (
  SELECT * FROM v_sales WHERE sale_id IN (SELECT sale_id FROM v_anomaly)),
v_slot AS (SELECT location_id, date, hour, COUNT(*) AS anomaly_count FROM v_hit GROUP BY 1, 2, 3 HAVING COUNT(*) > 2),
v_mode_e AS (
  SELECT * FROM (SELECT location_id, date, hour, employee_id AS v, COUNT(*) AS c,
                        row_number() OVER (PARTITION BY location_id, date, hour ORDER BY COUNT(*) DESC, employee_id) AS r
                 FROM v_hit WHERE employee_id IS NOT NULL GROUP BY 1, 2, 3, 4) WHERE r = 1 AND c > 1),
v_mode_p AS (
  SELECT * FROM (SELECT location_id, date, hour, payment_method AS v, COUNT(*) AS c,
                        row_number() OVER (PARTITION BY location_id, date, hour ORDER BY COUNT(*) DESC, payment_method) AS r
                 FROM v_hit GROUP BY 1, 2, 3, 4) WHERE r = 1 AND c > 1),
v_cluster AS (
  SELECT s.*, concat_ws('|', 'same_employee_' || e.v, 'same_payment_method_' || p.v) AS common_factors FROM v_slot s
  LEFT JOIN v_mode_e e ON s.location_id = e.location_id AND s.date = e.date AND s.hour = e.hour
  LEFT JOIN v_mode_p p ON s.location_id = p.location_id AND s.date = p.date AND s.hour = p.hour)
"""


@query("cause_time_clusters", CLUSTER + f"""
SELECT {LOC}, CAST(date AS VARCHAR) AS date, hour::BIGINT AS hour, anomaly_count, common_factors,
       'Investigate this time period for potential systematic issues' AS recommendation FROM v_cluster""")
def _(t):
    return causes.time_clusters(t.anomalies, t.sales)


@query("cause_cluster_sales", CLUSTER + """
SELECT h.location_id::BIGINT AS location_id, CAST(h.date AS VARCHAR) AS date, h.hour::BIGINT AS hour, sale_id
FROM v_hit h JOIN v_slot s ON h.location_id = s.location_id AND h.date = s.date AND h.hour = s.hour""")
def _(t):
    return causes.cluster_sales(t.anomalies, t.sales)


@query("cause_frequency", TRANSACTION + ECAUSE[len(VIEWS):] + f"""
SELECT {LOC}, cause, COUNT(*) AS frequency
FROM (SELECT location_id, unnest(string_split(causes, '|')) AS cause FROM v_tcause
      UNION ALL SELECT location_id, unnest(string_split(causes, '|')) FROM v_ecause) WHERE cause <> ''
GROUP BY location_id, cause""")
def _(t):
    found = t.anomalies
    return causes.cause_frequency(
        causes.transaction_causes(found, t.sales), causes.employee_causes(found, t.sales, t.labor, AS_OF))


@query("insight_anomaly_breakdown", VIEWS + f"""
SELECT {LOC}, 'category' AS breakdown, category AS value, COUNT(*) AS n FROM v_anomaly GROUP BY location_id, category
UNION ALL SELECT location_id, 'severity', severity, COUNT(*) FROM v_anomaly GROUP BY location_id, severity
UNION ALL SELECT location_id, 'hour', hour::VARCHAR, COUNT(*) FROM v_anomaly GROUP BY location_id, hour""")
def _(t):
    return notices.anomaly_breakdown(t.anomalies)


@query("insight_fraud_indicators", RISK + EMPLOYEE[len(VIEWS):] + PATTERN + f"""
SELECT {LOC}, 'high_risk_transactions' AS indicator, COUNT(*) AS n FROM v_risk WHERE risk_score >= 1 GROUP BY location_id
UNION ALL SELECT location_id, 'suspicious_patterns', COUNT(*) FROM v_pattern GROUP BY location_id
UNION ALL SELECT location_id, 'employee_risk_scores', COUNT(*) FROM v_emp_risk2 WHERE risk_score > 0 GROUP BY location_id
UNION ALL SELECT location_id, 'high_risk_employees', COUNT(*) FROM v_emp_risk2 WHERE risk_score >= 3 GROUP BY location_id""")
def _(t):
    return notices.fraud_indicators(
        risk.risk_transactions(t.sales), risk.repeated_amounts(_thousands(t)), risk.employee_risk(t.sales))


@query("insight_summary", RISK + SCORE + f"""
SELECT s.{LOC}, ROUND(score, 4) AS efficiency_score, total_anomalies, risk_alerts, high_risk_alerts
FROM v_score s
LEFT JOIN (SELECT location_id, COUNT(*) AS total_anomalies FROM v_anomaly GROUP BY 1) a ON s.location_id = a.location_id
LEFT JOIN (SELECT location_id, COUNT(*) AS risk_alerts, COUNT(*) FILTER (risk_score >= 3) AS high_risk_alerts FROM v_risk
           WHERE risk_score >= 1 GROUP BY 1) r ON s.location_id = r.location_id""")
def _(t):
    return notices.insight_summary(
        t.anomalies, risk.risk_transactions(t.sales),
        efficiency.efficiency_score(t.sales).withColumn("efficiency_score", F.round("efficiency_score", 4)))


@query("notice_anomalies", VIEWS + f"""
, v_pick AS (
  SELECT *, row_number() OVER (PARTITION BY location_id, category, severity ORDER BY sale_id::VARCHAR) AS r FROM v_anomaly
  WHERE category <> 'employee_pattern_anomalies'),
v_epick AS (
  SELECT *, row_number() OVER (PARTITION BY location_id, employee_id ORDER BY sale_id::VARCHAR) AS r FROM v_anomaly
  WHERE category = 'employee_pattern_anomalies' AND employee_id IS NOT NULL)
SELECT {LOC}, category AS rule,
       CASE WHEN category = 'high_value_transactions' AND severity = 'high' THEN 'alert' ELSE 'warning' END AS level,
       severity, CAST(NULL AS VARCHAR) AS subject, COUNT(*) AS n,
       string_agg(sale_id::VARCHAR, '|' ORDER BY sale_id::VARCHAR) FILTER (r <= 5) AS examples
FROM v_pick GROUP BY location_id, category, severity
UNION ALL
SELECT location_id, 'employee_pattern_anomalies', 'alert', 'high', employee_id::VARCHAR, COUNT(*),
       string_agg(sale_id::VARCHAR, '|' ORDER BY sale_id::VARCHAR) FILTER (r <= 3)
FROM v_epick GROUP BY location_id, employee_id HAVING COUNT(*) >= 5""")
def _(t):
    return notices.anomaly_notices(t.anomalies)


@query("notice_off_hours_by_hour", VIEWS + f"""
SELECT {LOC}, hour::BIGINT AS hour, COUNT(*) AS n FROM v_scored WHERE off_hours GROUP BY location_id, hour""")
def _(t):
    return notices.off_hours_by_hour(anomaly.unusual_time(t.sales))


@query("notice_payments_by_method", VIEWS + f"""
SELECT {LOC}, payment_method, COUNT(*) AS n FROM v_scored
WHERE method_share < 0.1 OR payment_method = 'Wire Transfer' GROUP BY location_id, payment_method""")
def _(t):
    return notices.payments_by_method(t.sales)


@query("notice_risk", EMPLOYEE + RISK[len(VIEWS):] + f"""
SELECT {LOC}, 'high_risk_transactions' AS rule, 'alert' AS level, COUNT(*) AS n,
       string_agg(sale_id::VARCHAR, '|' ORDER BY sale_id::VARCHAR) FILTER (r <= 5) AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY sale_id::VARCHAR) AS r FROM v_risk WHERE risk_score >= 3)
GROUP BY location_id
UNION ALL
SELECT location_id, 'high_risk_employees', 'alert', COUNT(*),
       string_agg(employee_id::VARCHAR, '|' ORDER BY employee_id::VARCHAR) FILTER (r <= 5)
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY employee_id::VARCHAR) AS r FROM v_emp_risk2 WHERE risk_score >= 3)
GROUP BY location_id""")
def _(t):
    return notices.risk_notices(risk.risk_transactions(t.sales), risk.employee_risk(t.sales))


@query("notice_causes", TRANSACTION + ECAUSE[len(VIEWS):] + CLUSTER[len(VIEWS):] + f"""
SELECT {LOC}, 'transaction_causes' AS rule, 'info' AS level, cause, COUNT(*) AS n
FROM (SELECT location_id, unnest(string_split(causes, '|')) AS cause FROM v_tcause) WHERE cause <> '' GROUP BY location_id, cause
UNION ALL
SELECT location_id, 'employee_causes', 'info', cause, COUNT(*)
FROM (SELECT location_id, unnest(string_split(causes, '|')) AS cause FROM v_ecause) WHERE cause <> '' GROUP BY location_id, cause
UNION ALL SELECT location_id, 'time_clusters', 'warning', NULL, COUNT(*) FROM v_cluster GROUP BY location_id""")
def _(t):
    found = t.anomalies
    return notices.cause_notices(
        causes.transaction_causes(found, t.sales), causes.employee_causes(found, t.sales, t.labor, AS_OF),
        causes.time_clusters(found, t.sales))


@query("notice_slow_hours", f"""
SELECT {LOC}, hour::BIGINT AS hour, COUNT(*) AS slots, SUM(c)::DOUBLE / COUNT(*) AS average_transactions,
       SUM(revenue)::DOUBLE / COUNT(*) AS average_revenue
FROM (SELECT location_id, date, hour, COUNT(*) AS c, SUM(total_amount) AS revenue FROM v_sales GROUP BY 1, 2, 3)
WHERE c < 5 AND hour NOT IN (0, 1, 2, 3, 4, 5, 23) GROUP BY location_id, hour""")
def _(t):
    return notices.slow_hours(efficiency.sales_velocity(t.sales))


@query("notice_efficiency", PEAK + MENTION + f""", v_subjects AS (
SELECT location_id, 'low_sales_activity' AS rule, hour::VARCHAR AS subject
FROM (SELECT location_id, date, hour FROM v_sales GROUP BY 1, 2, 3 HAVING COUNT(*) < 5)
WHERE hour NOT IN (0, 1, 2, 3, 4, 5, 23)
UNION ALL SELECT location_id, 'peak_concentration', peak_hours FROM v_peak WHERE peak_revenue_pct > 20
UNION ALL SELECT location_id, 'employee_efficiency', employee_id::VARCHAR
FROM (SELECT location_id, employee_id FROM v_sales WHERE employee_id IS NOT NULL GROUP BY 1, 2
      HAVING SUM(number_of_items)::DOUBLE / COUNT(*) < 1.5 OR SUM(total_amount) / COUNT(*) < 10)
UNION ALL SELECT m.location_id, 'low_turnover', m.ingredient
FROM v_mention m JOIN v_words w ON m.location_id = w.location_id AND m.ingredient = w.ingredient
WHERE usage_count::DOUBLE / quantity < 0.1
UNION ALL SELECT location_id, 'order_type_efficiency', order_type
FROM (SELECT location_id, order_type FROM v_sales GROUP BY 1, 2
      HAVING SUM(number_of_items)::DOUBLE / COUNT(*) < 1.5 OR SUM(total_amount) / COUNT(*) < 10))
SELECT {LOC}, rule, COUNT(*) AS n, array_to_string(list_sort(list(DISTINCT subject))[1:5], ', ') AS examples
FROM v_subjects GROUP BY location_id, rule""")
def _(t):
    return notices.efficiency_notices(
        efficiency.sales_velocity(t.sales), efficiency.peak_hours(t.sales), efficiency.employee_efficiency(t.sales),
        efficiency.ingredient_turnover(t.sales, t.word_stock), efficiency.order_type_efficiency(t.sales), peak_above=20.0)


@query("notice_score_band", SCORE + f"""
SELECT {LOC}, ROUND(score, 4) AS efficiency_score,
       CASE WHEN score > 85 THEN 'Excellent' WHEN score > 70 THEN 'Good' WHEN score > 50 THEN 'Average'
            ELSE 'Needs Improvement' END AS band FROM v_score WHERE score > 0""")
def _(t):
    return notices.score_band(efficiency.efficiency_score(t.sales)).withColumn("efficiency_score", F.round("efficiency_score", 4))


@query("notice_preferences", f"""
SELECT n.id, n.user_id, n.type AS category FROM v_notification n
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = n.user_id AND c.c_acctbal < 3000 AND n.type = 'click')""")
def _(t):
    settings = t.raw("customer").select(
        F.col("c_custkey").alias("user_id"), F.lit("click").alias("category"), (F.col("c_acctbal") >= 3000).alias("enabled"))
    return notices.wanted(t.notifications.select("id", "user_id", F.col("type").alias("category")), settings)
