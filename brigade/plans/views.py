"""The sample tables seen as restaurant tables: once in Spark, once as SQL views for the oracle.

A customer nation is a location, an order is a sale, a part is a recipe line, a supplier is an employee
or manager. Both sides state the same mapping independently; neither reads the other's output.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brigade.functions.items import split_items
from brigade.functions.numbers import MONEY, money
from brigade.operators.anomaly import all_anomalies
from brigade.operators.silver import derive_inventory, derive_menu
from brigade.operators.spread import beside, settle

# The reference day of the sample orders and staff.
AS_OF = dt.date(2001, 8, 1)
# Lines of orders that a task looks at when pairs of location and part are found.
TASK_LINES = 500_000


class Tables:
    """Canonical frames over one sample folder; the wide ones are settled once per application."""

    _known: dict[tuple[str, str], Tables] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Tables:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def sales(self) -> DataFrame:
        lines = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_discount", money("l_extendedprice").alias("price")
        )
        parts = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
        # an order has a handful of lines, so a combine before the shuffle would gain nothing: rows are
        # brought together by order first and the short lists are built behind the shuffle
        near = beside(lines, parts, ["l_partkey"]).withColumnRenamed("l_orderkey", "o_orderkey").repartition("o_orderkey")
        per_order = near.groupBy("o_orderkey").agg(
            F.sort_array(F.collect_list(F.struct("l_partkey", "p_name"))).alias("_lines"),
            F.count(F.lit(1)).cast("int").alias("number_of_items"),
            F.sum("price").cast(MONEY).alias("subtotal"),
            F.min("l_suppkey").alias("employee_id"),
            F.round(F.max("l_discount") * 300).cast("int").alias("discount_percent"),
        )
        customers = self.raw("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("location_id"),
            F.col("c_mktsegment").alias("order_type"),
        )
        total = money("o_totalprice")
        zero = F.lit(0).cast(MONEY)
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        text = F.array_join(F.transform("_lines", lambda x: x["p_name"]), ";")
        df = beside(self.raw("orders"), customers, ["o_custkey"]).join(per_order, "o_orderkey", "left")
        return settle(
            df.select(
                "location_id",
                k.alias("sale_id"),
                F.to_date("o_orderdate").alias("date"),
                F.pmod(k * 7 + c, F.lit(24)).cast("int").alias("hour"),
                text.alias("items_sold"),
                split_items(text).alias("items"),
                F.coalesce("number_of_items", F.lit(0)).alias("number_of_items"),
                F.coalesce("subtotal", zero).alias("subtotal"),
                (k % 7).cast(MONEY).alias("tip"),
                total.alias("total_amount"),
                F.when(c % 50 == 0, "Wire Transfer").when(c % 15 == 1, "Check")
                .otherwise(F.col("o_orderpriority")).alias("payment_method"),
                "order_type",
                "employee_id",
                c.alias("customer_id"),
                "discount_percent",
                (1 + k % 4).cast("int").alias("covers"),
                (k % 3).cast(MONEY).alias("comps"),
                F.when((F.col("o_orderstatus") == "P") & (k % 20 == 0), total).otherwise(zero).alias("voids"),
                (c % 5).cast(MONEY).alias("promos"),
            ),
            "sales",
        )

    @cached_property
    def menu(self) -> DataFrame:
        """Recipe lines of a location: the parts sold there."""
        lines = self.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
        # nearly all pairs of a task are distinct, so its memory goes with its rows: their number is set here, or tasks would be
        # brought together by the few bytes that keys take
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // TASK_LINES + 1)
        orders = self.raw("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
        customers = self.raw("customer").select("c_custkey", F.col("c_nationkey").alias("location_id"))
        placed = beside(orders, customers, ["c_custkey"]).select("o_orderkey", "location_id")
        # the lines are dealt by order already, so the orders are shuffled and never broadcast
        sold = lines.repartition(tasks, "o_orderkey").join(placed.hint("merge"), "o_orderkey").select("location_id", "p_partkey").distinct()
        first = F.lit(dt.date(2024, 1, 1))
        df = beside(sold, self.raw("part"), ["p_partkey"]).select(
            "location_id",
            F.date_add(first, F.col("p_size")).alias("date"),
            F.col("p_name").alias("menu_item"),
            F.concat_ws(" ", "p_type", "p_brand").alias("ingredient"),
            F.col("p_size").cast("double").__truediv__(10).alias("amount"),
            money("p_retailprice").alias("unit_cost"),
            F.col("p_type").alias("category"),
            (money("p_retailprice") * 3).cast(MONEY).alias("item_price"),
            F.date_add(first, F.col("p_size")).alias("created_at"),
            F.date_add(first, (F.col("p_partkey") % 60).cast("int")).alias("updated_at"),
            (F.col("p_size") > 5).alias("is_active"),
            F.col("p_partkey").alias("ingest_seq"),
            F.col("p_size"),
        )
        return settle(derive_menu(df), "menu")

    def _stock(self, lines: DataFrame) -> DataFrame:
        df = lines.groupBy("location_id", "ingredient").agg(
            F.sum("p_size").cast("double").alias("quantity"),
            (F.count(F.lit(1)) * 30).cast("double").alias("par_level"),
            F.max("unit_cost").alias("unit_cost"),
            F.max("date").alias("date"),
            (F.min("p_size") - 5).cast("double").alias("waste"),
        )
        return derive_inventory(df.withColumn("is_low", F.col("quantity") < F.col("par_level")))

    @cached_property
    def inventory(self) -> DataFrame:
        return settle(self._stock(self.menu), "inventory")

    @cached_property
    def word_stock(self) -> DataFrame:
        """Stock whose ingredient names occur in item names: the last word of the item."""
        words = self.menu.withColumn("ingredient", F.upper(F.substring_index("menu_item", " ", -1)))
        return settle(self._stock(words), "word_stock")

    @cached_property
    def anomalies(self) -> DataFrame:
        """Anomalies as a stored table for the jobs that explain and report them.

        z-scores of the sample stay below the default of 12, hence the lower threshold.
        """
        return settle(all_anomalies(self.sales, high_value_threshold=1.5), "anomalies")

    @property
    def labor(self) -> DataFrame:
        k = F.col("s_suppkey")
        position = F.element_at(F.array(*[F.lit(x) for x in ("Manager", "Server", "Cook", "Host")]), (k % 4 + 1).cast("int"))
        hours = (4 + k % 8).cast("double")
        return self.raw("supplier").select(
            F.col("s_nationkey").alias("location_id"),
            F.lit(AS_OF).alias("date"),
            k.alias("employee_id"),
            F.col("s_name").alias("name"),
            position.alias("position"),
            F.lower(position).alias("role"),
            (10 + k % 20).cast(MONEY).alias("hourly_rate"),
            hours.alias("hours_worked"),
            F.greatest(F.lit(0.0), hours - 8).alias("overtime_hours"),
            (k % 4 == 0).alias("is_salaried"),
            F.date_sub(F.lit(AS_OF), (k % 400).cast("int")).alias("hire_date"),
            F.when(F.col("s_acctbal") < 1000, F.lit(dt.date(2001, 7, 1))).alias("termination_date"),
        )

    @property
    def restaurants(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.raw("nation").select(
            k.alias("id"), F.col("n_name").alias("name"), (k % 5 != 0).alias("active"),
            (k % 10).cast("long").alias("created_by"), (k * 3 % 10).cast("long").alias("deactivated_by"),
            F.when(k % 3 != 0, F.concat(F.lit("S"), k.cast("string"))).alias("store_id"),
        )

    @property
    def managers(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("id"), F.concat("s_name", F.lit("@m")).alias("email"), F.col("s_name").alias("full_name"),
            F.when(k % 4 == 0, "regional_manager").otherwise("restaurant_manager").alias("role"),
            F.when(k % 4 != 0, k - k % 4).alias("regional_manager_id"),
        )

    @property
    def assignments(self) -> DataFrame:
        return self.raw("supplier").where(F.col("s_acctbal") > 5000).select(
            F.col("s_suppkey").alias("manager_id"), F.col("s_nationkey").alias("restaurant_id")
        )

    @property
    def users(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("@x")).alias("email"),
            F.col("c_name").alias("full_name"),
        )

    @property
    def plans(self) -> DataFrame:
        k = F.col("r_regionkey")
        return self.raw("region").select(
            k.alias("id"), F.col("r_name").alias("name"), ((k + 1) * 10).cast(MONEY).alias("price"),
            (k * 5 + 5).cast("long").alias("max_ai_engagements"), (k + 1).cast("long").alias("max_restaurants"),
            F.lit(2).cast("long").alias("max_integrations"),
        )

    @property
    def subscriptions(self) -> DataFrame:
        k, seg = F.col("c_custkey"), F.col("c_mktsegment")
        return self.raw("customer").select(
            k.alias("id"), k.alias("user_id"), (F.col("c_nationkey") % 5).alias("plan_id"),
            (seg == "BUILDING").alias("is_trial"),
            F.date_add(F.lit(AS_OF), (k % 10 - 4).cast("int")).alias("trial_end_date"),
            F.date_add(F.lit(AS_OF), (k % 60 - 30).cast("int")).alias("end_date"),
            (F.col("c_acctbal") > 1000).alias("auto_renew"),
            (F.col("c_acctbal") > 0).alias("is_active"),
            (seg == "MACHINERY").alias("is_yearly"),
            F.when(seg == "HOUSEHOLD", 8).cast("long").alias("max_engagements_override"),
        )

    @property
    def usage(self) -> DataFrame:
        month = F.trunc(F.to_date("o_orderdate"), "month")
        return self.raw("orders").groupBy(F.col("o_custkey").alias("user_id"), month.alias("cycle_start")).agg(
            F.count(F.lit(1)).alias("engagements_used"), (F.count(F.lit(1)) * 600).alias("tokens_used")
        ).select(
            "user_id", F.col("user_id").alias("subscription_id"), "tokens_used", "engagements_used",
            "cycle_start", F.last_day("cycle_start").alias("cycle_end"),
        )

    @property
    def engagements(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("engagement_id"), "user_id",
            F.to_date(F.date_trunc("week", "ts")).alias("cycle_start"), "ts",
            F.col("event_type").alias("type"), F.lit(600).cast("long").alias("tokens"),
        )

    @property
    def limits(self) -> DataFrame:
        s = self.subscriptions.select("user_id", "plan_id", "max_engagements_override")
        p = self.plans.select(F.col("id").alias("plan_id"), "max_ai_engagements")
        return s.join(p, "plan_id").select(
            "user_id", F.coalesce("max_engagements_override", "max_ai_engagements").alias("max_engagements")
        )

    @property
    def usage_log(self) -> DataFrame:
        kind = (
            F.when(F.col("event_type") == "click", "ai_engagements")
            .when(F.col("event_type") == "view", "restaurants").otherwise("integrations")
        )
        return self.raw("events").select(
            "user_id", F.col("user_id").alias("subscription_id"), kind.alias("usage_type"),
            F.lit(1).cast("long").alias("amount"),
        )

    @property
    def notifications(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("type"),
            (F.col("value") > 10).alias("is_read"), F.col("ts").alias("created_at"),
        )

    @property
    def visits(self) -> DataFrame:
        who = self.raw("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("customer_name"),
            F.concat("c_name", F.lit("@x")).alias("email"), F.concat(F.lit("+1-"), F.col("c_custkey").cast("string")).alias("phone"),
        )
        return self.raw("orders").join(who, "o_custkey").select(
            F.col("o_custkey").alias("customer_id"), "customer_name", "email", "phone",
            (money("o_totalprice") / 1000).cast(MONEY).alias("paid_amount"),
            F.to_date("o_orderdate").alias("visit_date"),
        )

    @cached_property
    def pos_orders(self) -> DataFrame:
        lines = self.raw("lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_quantity", money("l_extendedprice").alias("amount"))
        food = (F.col("amount") * F.lit("0.3").cast("decimal(2,1)")).cast(MONEY)
        near = lines.join(self.raw("part").select("p_partkey", "p_name"), "p_partkey").withColumnRenamed(
            "l_orderkey", "o_orderkey").repartition("o_orderkey")
        per_order = near.groupBy("o_orderkey").agg(
            F.collect_list(
                F.struct(
                    F.col("p_name").alias("menu_item_name"), F.col("l_quantity").cast("int").alias("quantity"),
                    "amount", food.alias("food_cost"),
                )
            ).alias("items")
        )
        who = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("location_id"))
        hour = F.pmod(F.col("o_orderkey") * 7 + F.col("o_custkey"), F.lit(24)).cast("int")
        df = self.raw("orders").join(who, "o_custkey").join(per_order, "o_orderkey", "left")
        return settle(
            df.select(
                "location_id", F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("order_date"),
                (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), hour)).alias("order_ts"),
                money("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"), "items",
            ),
            "pos_orders",
        )

    @property
    def chunks(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("chunk_id"), F.col("label").alias("category"), "embedding",
            (F.col("label") % 2).alias("owner_id"), F.concat(F.lit("file"), F.col("label").cast("string")).alias("filename"),
            F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("vec_id") % 28).cast("int")).alias("created_at"),
        )


# The same mapping as SQL views.
PRELUDE = """
WITH v_lines AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_discount, l_quantity, p_name,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey),
v_order AS (
  SELECT l_orderkey, string_agg(p_name, ';' ORDER BY l_partkey, p_name) AS items_sold, COUNT(*) AS n,
         SUM(price) AS subtotal, MIN(l_suppkey) AS employee_id,
         CAST(ROUND(MAX(l_discount) * 300) AS INT) AS discount_percent
  FROM v_lines GROUP BY l_orderkey),
v_sales AS (
  SELECT c_nationkey AS location_id, o_orderkey AS sale_id, CAST(o_orderdate AS DATE) AS date,
         CAST((o_orderkey * 7 + o_custkey) % 24 AS INT) AS hour, items_sold,
         CAST(COALESCE(n, 0) AS INT) AS number_of_items,
         CAST(COALESCE(subtotal, 0) AS DECIMAL(18,2)) AS subtotal,
         CAST(o_orderkey % 7 AS DECIMAL(18,2)) AS tip, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
         CASE WHEN o_custkey % 50 = 0 THEN 'Wire Transfer' WHEN o_custkey % 15 = 1 THEN 'Check'
              ELSE o_orderpriority END AS payment_method,
         c_mktsegment AS order_type, employee_id, o_custkey AS customer_id, discount_percent,
         CAST(1 + o_orderkey % 4 AS INT) AS covers, CAST(o_orderkey % 3 AS DECIMAL(18,2)) AS comps,
         CASE WHEN o_orderstatus = 'P' AND o_orderkey % 20 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2))
              ELSE CAST(0 AS DECIMAL(18,2)) END AS voids,
         CAST(o_custkey % 5 AS DECIMAL(18,2)) AS promos
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN v_order ON l_orderkey = o_orderkey),
v_items AS (
  SELECT s.location_id, s.sale_id, s.date, s.hour, l.p_name AS menu_item,
         CAST(CAST(CASE WHEN s.total_amount <> 0 THEN s.total_amount ELSE s.subtotal END AS DOUBLE)
              / s.number_of_items AS DECIMAL(18,6)) AS revenue,
         CAST(CAST(s.subtotal AS DOUBLE) / s.number_of_items AS DECIMAL(18,6)) AS sub_revenue
  FROM v_sales s JOIN v_lines l ON l.l_orderkey = s.sale_id),
v_menu AS (
  SELECT location_id, DATE '2024-01-01' + p_size AS date, p_name AS menu_item,
         p_type || ' ' || p_brand AS ingredient, CAST(p_size AS DECIMAL(12,0)) * CAST(0.1 AS DECIMAL(2,1)) AS amount,
         CAST(p_retailprice AS DECIMAL(18,2)) AS unit_cost, p_type AS category,
         CAST(p_retailprice AS DECIMAL(18,2)) * 3 AS item_price, DATE '2024-01-01' + p_size AS created_at,
         DATE '2024-01-01' + CAST(p_partkey % 60 AS INT) AS updated_at, p_size > 5 AS is_active,
         p_partkey AS ingest_seq, p_size
  FROM (SELECT DISTINCT c_nationkey AS location_id, l_partkey FROM lineitem
        JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey) q
  JOIN part ON p_partkey = l_partkey),
v_inventory AS (
  SELECT *, quantity < par_level AS is_low,
         CAST(CAST(quantity AS DECIMAL(14,3)) * unit_cost AS DECIMAL(18,2)) AS total_value,
         CASE WHEN quantity < par_level THEN 'low' ELSE 'normal' END AS alert
  FROM (SELECT location_id, ingredient, CAST(SUM(p_size) AS DOUBLE) AS quantity,
               CAST(30 * COUNT(*) AS DOUBLE) AS par_level, MAX(unit_cost) AS unit_cost, MAX(date) AS date,
               CAST(MIN(p_size) - 5 AS DOUBLE) AS waste
        FROM v_menu GROUP BY location_id, ingredient)),
v_words AS (
  SELECT location_id, upper(string_split(menu_item, ' ')[-1]) AS ingredient, CAST(SUM(p_size) AS DOUBLE) AS quantity,
         CAST(30 * COUNT(*) AS DOUBLE) AS par_level
  FROM v_menu GROUP BY 1, 2),
v_cost AS (
  SELECT location_id, menu_item, CAST(SUM(amount * unit_cost) AS DECIMAL(24,5)) AS unit_cost
  FROM v_menu GROUP BY 1, 2),
v_base AS (
  SELECT location_id, menu_item, COUNT(*) AS units, SUM(revenue) AS revenue, SUM(sub_revenue) AS sub_revenue
  FROM v_items GROUP BY 1, 2),
v_stats AS (
  SELECT b.location_id, b.menu_item, b.units, b.revenue, b.sub_revenue, COALESCE(c.unit_cost, 0) AS unit_cost,
         CAST(COALESCE(c.unit_cost, 0) AS DECIMAL(24,5)) * CAST(b.units AS DECIMAL(12,0)) AS cost
  FROM v_base b LEFT JOIN v_cost c ON b.location_id = c.location_id AND b.menu_item = c.menu_item),
v_profit AS (
  SELECT location_id, menu_item, units, ROUND(revenue, 2) AS revenue, ROUND(cost, 2) AS cost,
         ROUND(revenue - cost, 2) AS gross_profit,
         CASE WHEN revenue > 0 THEN ROUND(CAST(CAST(revenue - cost AS DOUBLE) / CAST(revenue AS DOUBLE) * 100 AS DECIMAL(28,6)), 2)
              ELSE 0 END AS margin_pct
  FROM v_stats),
v_labor AS (
  SELECT s_nationkey AS location_id, DATE '2001-08-01' AS date, s_suppkey AS employee_id, s_name AS name,
         ['Manager','Server','Cook','Host'][CAST(s_suppkey % 4 + 1 AS INT)] AS position,
         lower(['Manager','Server','Cook','Host'][CAST(s_suppkey % 4 + 1 AS INT)]) AS role,
         CAST(10 + s_suppkey % 20 AS DECIMAL(18,2)) AS hourly_rate, CAST(4 + s_suppkey % 8 AS DOUBLE) AS hours_worked,
         CAST(GREATEST(0, s_suppkey % 8 - 4) AS DOUBLE) AS overtime_hours, s_suppkey % 4 = 0 AS is_salaried,
         DATE '2001-08-01' - CAST(s_suppkey % 400 AS INT) AS hire_date,
         CASE WHEN s_acctbal < 1000 THEN DATE '2001-07-01' END AS termination_date
  FROM supplier),
v_restaurant AS (
  SELECT n_nationkey AS id, n_name AS name, n_nationkey % 5 <> 0 AS active, n_nationkey % 10 AS created_by,
         n_nationkey * 3 % 10 AS deactivated_by,
         CASE WHEN n_nationkey % 3 <> 0 THEN 'S' || n_nationkey END AS store_id FROM nation),
v_manager AS (
  SELECT s_suppkey AS id, s_name || '@m' AS email, s_name AS full_name,
         CASE WHEN s_suppkey % 4 = 0 THEN 'regional_manager' ELSE 'restaurant_manager' END AS role,
         CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey - s_suppkey % 4 END AS regional_manager_id FROM supplier),
v_assignment AS (
  SELECT s_suppkey AS manager_id, s_nationkey AS restaurant_id FROM supplier WHERE s_acctbal > 5000),
v_user AS (SELECT c_custkey AS id, c_name || '@x' AS email, c_name AS full_name FROM customer),
v_plan AS (
  SELECT r_regionkey AS id, r_name AS name, CAST((r_regionkey + 1) * 10 AS DECIMAL(18,2)) AS price,
         CAST(r_regionkey * 5 + 5 AS BIGINT) AS max_ai_engagements, CAST(r_regionkey + 1 AS BIGINT) AS max_restaurants,
         CAST(2 AS BIGINT) AS max_integrations FROM region),
v_subscription AS (
  SELECT c_custkey AS id, c_custkey AS user_id, c_nationkey % 5 AS plan_id, c_mktsegment = 'BUILDING' AS is_trial,
         DATE '2001-08-01' + CAST(c_custkey % 10 - 4 AS INT) AS trial_end_date,
         DATE '2001-08-01' + CAST(c_custkey % 60 - 30 AS INT) AS end_date, c_acctbal > 1000 AS auto_renew,
         c_acctbal > 0 AS is_active, c_mktsegment = 'MACHINERY' AS is_yearly,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN CAST(8 AS BIGINT) END AS max_engagements_override
  FROM customer),
v_usage AS (
  SELECT o_custkey AS user_id, o_custkey AS subscription_id, CAST(COUNT(*) * 600 AS BIGINT) AS tokens_used,
         COUNT(*) AS engagements_used, CAST(date_trunc('month', o_orderdate) AS DATE) AS cycle_start,
         last_day(CAST(MIN(o_orderdate) AS DATE)) AS cycle_end
  FROM orders GROUP BY o_custkey, date_trunc('month', o_orderdate)),
v_engagement AS (
  SELECT event_id AS engagement_id, user_id, CAST(date_trunc('week', ts) AS DATE) AS cycle_start, ts,
         event_type AS type, CAST(600 AS BIGINT) AS tokens FROM events),
v_limit AS (
  SELECT s.user_id, COALESCE(s.max_engagements_override, p.max_ai_engagements) AS max_engagements
  FROM v_subscription s JOIN v_plan p ON s.plan_id = p.id),
v_usage_log AS (
  SELECT user_id, user_id AS subscription_id, CAST(1 AS BIGINT) AS amount,
         CASE WHEN event_type = 'click' THEN 'ai_engagements' WHEN event_type = 'view' THEN 'restaurants'
              ELSE 'integrations' END AS usage_type FROM events),
v_notification AS (
  SELECT event_id AS id, user_id, event_type AS type, value > 10 AS is_read, ts AS created_at FROM events),
v_visit AS (
  SELECT o_custkey AS customer_id, c_name AS customer_name, c_name || '@x' AS email, '+1-' || o_custkey AS phone,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(18,2)) AS paid_amount,
         CAST(o_orderdate AS DATE) AS visit_date
  FROM orders JOIN customer ON o_custkey = c_custkey),
v_pos AS (
  SELECT c_nationkey AS location_id, o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date,
         CAST((o_orderkey * 7 + o_custkey) % 24 AS INT) AS hour, CAST(o_totalprice AS DECIMAL(18,2)) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey),
v_pos_items AS (
  SELECT p.location_id, p.order_id, p.order_date, l.p_name AS menu_item, CAST(l.l_quantity AS BIGINT) AS quantity,
         l.price AS amount, CAST(l.price * CAST(0.3 AS DECIMAL(2,1)) AS DECIMAL(18,2)) AS food_cost
  FROM v_pos p JOIN v_lines l ON l.l_orderkey = p.order_id),
v_chunk AS (
  SELECT vec_id AS chunk_id, label AS category, embedding, label % 2 AS owner_id, 'file' || label AS filename,
         DATE '2024-01-01' + CAST(vec_id % 28 AS INT) AS created_at FROM embeddings)
"""
