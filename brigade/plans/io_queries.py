"""Uploads, sinks and streams over real files: written to the shared folder, read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brigade.operators import silver
from brigade.plans.registry import query
from brigade.session import shared_path
from brigade.sources import csv_files, sinks
from brigade.streaming import orders

LOC = "location_id::BIGINT AS location_id"
MONEY_SCHEMA = "location_id bigint, sale_id bigint, date date, total_amount decimal(18,2), seq int"


def _path(t, name: str) -> str:
    return shared_path(t.spark, name)


def _sales(t, factor: int, seq: int) -> DataFrame:
    total = (F.col("total_amount") * factor).cast("decimal(18,2)")
    return t.sales.select(F.col("location_id").cast("long").alias("location_id"), F.col("sale_id").cast("long").alias("sale_id"),
                          "date", total.alias("total_amount"), F.lit(seq).alias("seq"))


def _stored(t, path: str) -> DataFrame:
    return t.spark.read.schema(MONEY_SCHEMA).parquet(path)


# -- uploads -------------------------------------------------------------------------------------

def _uploads(t) -> list[str]:
    """The sales as CSV in two folders: one with all columns, one with few and a comma in a quoted name."""
    a, b = _path(t, "upload"), _path(t, "upload")
    k, text = F.col("sale_id"), lambda c: F.col(c).cast("string")
    t.sales.where(k % 2 == 0).select(
        text("location_id").alias("Location ID"), F.date_format("date", "dd/MM/yyyy").alias("Date"), text("sale_id").alias(" Sale ID "),
        F.format_string("%d:30:00", "hour").alias("Time"), F.to_json("items").alias("Items Sold"), text("number_of_items").alias("Number of Items"),
        text("subtotal").alias("Subtotal"), text("total_amount").alias("Total Amount"), F.col("payment_method").alias("Payment Method"),
    ).write.option("header", True).option("escape", '"').csv(a)
    t.sales.where(k % 2 == 1).select(
        text("location_id").alias("location id"), F.col("items_sold").alias("Note, free\ttext"), text("date").alias("DATE"),
        text("sale_id").alias("Sale ID"), F.concat(F.lit(" "), text("total_amount")).alias("Total Amount"),
    ).write.option("header", True).option("quoteAll", True).csv(b)
    return [a, b]


@query("upload_sales_csv", f"""
SELECT {LOC}, sale_id::VARCHAR AS sale_id, CAST(date AS VARCHAR) AS date, CASE WHEN sale_id % 2 = 0 THEN hour END::BIGINT AS hour,
       CASE WHEN sale_id % 2 = 0 THEN number_of_items ELSE 0 END::BIGINT AS number_of_items,
       CASE WHEN sale_id % 2 = 0 THEN subtotal ELSE 0 END::DOUBLE AS subtotal, total_amount::DOUBLE AS total_amount,
       CASE WHEN sale_id % 2 = 0 THEN payment_method ELSE 'Unknown' END AS payment_method FROM v_sales""")
def _(t):
    raw = csv_files.read_category(t.spark, _uploads(t))
    return silver.clean_sales(raw, F.col("location_id").cast("long")).select(
        "location_id", "sale_id", "date", "hour", "number_of_items", "subtotal", "total_amount", "payment_method")


@query("upload_header_check", """
SELECT 9::BIGINT AS columns, '' AS missing_required, '' AS missing_one_of, 'order type' AS missing_recommended, true AS valid
UNION ALL SELECT 5, '', '', 'items sold|order type|payment method', true""")
def _(t):
    checked = csv_files.check_headers(csv_files.headers(t.spark, _uploads(t)), "Sales")
    return checked.select(F.size("columns").alias("columns"), "missing_required", "missing_one_of", "missing_recommended", "valid").distinct()


# -- sinks ---------------------------------------------------------------------------------------

ROW = f"{LOC}, sale_id, CAST(date AS VARCHAR) AS date"


@query("sink_upsert_written", f"""
SELECT {ROW}, CASE WHEN sale_id % 3 = 0 THEN total_amount ELSE total_amount * 2 END::DOUBLE AS total_amount FROM v_sales""")
def _(t):
    path, keys = _path(t, "upserted"), ["location_id", "sale_id", "date"]
    sinks.upsert_latest(_sales(t, 1, 1).where("sale_id % 3 != 2"), path, keys, ["seq"])
    newer = _sales(t, 2, 2).where("sale_id % 3 != 0").unionByName(_sales(t, 9, 0).where("sale_id % 3 = 0"))
    for _ in range(2):  # a replay changes nothing
        sinks.upsert_latest(newer, path, keys, ["seq"])
    return _stored(t, path).drop("seq")


@query("sink_insert_written", f"""
SELECT {ROW}, CASE WHEN sale_id % 2 = 0 THEN total_amount ELSE total_amount * 3 END::DOUBLE AS total_amount FROM v_sales""")
def _(t):
    path = _path(t, "inserted")
    sinks.insert_new(_sales(t, 1, 1).where("sale_id % 2 = 0"), path, sinks.KEYS["sales"], partition_by=("location_id",))
    sinks.insert_new(_sales(t, 3, 2), path, sinks.KEYS["sales"], partition_by=("location_id",))
    return _stored(t, path).drop("seq")


@query("sink_replace_written", f"""
SELECT {ROW}, CASE WHEN location_id % 2 = 0 THEN total_amount ELSE total_amount * 2 END::DOUBLE AS total_amount FROM v_sales""")
def _(t):
    path = _path(t, "replaced")
    sinks.replace_partitions(_sales(t, 1, 1), path)
    sinks.replace_partitions(_sales(t, 2, 2).where("location_id % 2 = 1"), path)
    return _stored(t, path).drop("seq")


@query("sink_retention_written", f"""
SELECT {ROW}, total_amount::DOUBLE AS total_amount FROM v_sales WHERE date >= DATE '1999-01-01' AND location_id != 3""")
def _(t):
    path = _path(t, "retained")
    sinks.replace_partitions(_sales(t, 1, 1), path)
    sinks.delete_older(t.spark, path, (F.col("date") >= "1999-01-01") & (F.col("location_id") != "3"))
    return _stored(t, path).drop("seq")


@query("sink_delete_written", f"SELECT {ROW}, total_amount::DOUBLE AS total_amount FROM v_sales WHERE sale_id % 5 != 0")
def _(t):
    path = _path(t, "deleted")
    sinks.replace_partitions(_sales(t, 1, 1), path)
    sinks.delete_keys(t.spark, path, t.sales.where("sale_id % 5 = 0"), ["location_id", "sale_id"])
    return _stored(t, path).drop("seq")


@query("sink_append_written", f"""
SELECT {LOC}, 'a.csv' AS filename, COUNT(*) AS n FROM v_sales GROUP BY 1
UNION ALL SELECT location_id, 'b.csv', COUNT(*) FROM v_sales WHERE sale_id % 2 = 0 GROUP BY 1""")
def _(t):
    path = _path(t, "appended")
    sinks.append_tagged(_sales(t, 1, 1), path, "a.csv")
    sinks.append_tagged(_sales(t, 1, 1).where("sale_id % 2 = 0"), path, "b.csv")
    rows = t.spark.read.schema(MONEY_SCHEMA + ", filename string").parquet(path)
    return rows.groupBy("location_id", "filename").agg(F.count(F.lit(1)).alias("n"))


# -- streams -------------------------------------------------------------------------------------

ORDER_SCHEMA = "location_id bigint, order_id bigint, order_date date, order_ts timestamp, total decimal(18,2), ingest_ts timestamp"


def _landed(t) -> str:
    """Orders as JSON files, a third of them twice with a newer total."""
    path = _path(t, "landed")
    rows = t.pos_orders.select(
        F.col("location_id").cast("long").alias("location_id"), "order_id", "order_date", "order_ts", "total",
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ingest_ts"))
    rows.write.json(path)
    rows.where("order_id % 3 = 0").withColumn("total", (F.col("total") + 1).cast("decimal(18,2)")).withColumn(
        "ingest_ts", F.lit("2024-01-02 00:00:00").cast("timestamp")).write.mode("append").json(path)
    return path


@query("stream_keep_latest", f"""
SELECT p.{LOC}, order_id, CAST(order_date AS VARCHAR) AS order_date, CASE WHEN order_id % 3 = 0 THEN total + 1 ELSE total END::DOUBLE AS total FROM v_pos p""")
def _(t):
    table, source = _path(t, "latest"), orders.read_stream(t.spark, _landed(t), ORDER_SCHEMA, files_per_batch=8)
    # the sample has less than one order per location and day, so days would make tiny files here
    orders.keep_latest(source, table, _path(t, "state"), partition_by=("location_id",)).awaitTermination()
    return t.spark.read.schema(ORDER_SCHEMA).parquet(table).select("location_id", "order_id", "order_date", "total")


@query("stream_append_files", f"""
SELECT p.{LOC}, COUNT(*) + COUNT(*) FILTER (order_id % 3 = 0) AS n FROM v_pos p GROUP BY 1""")
def _(t):
    table, source = _path(t, "files"), orders.read_stream(t.spark, _landed(t), ORDER_SCHEMA)
    orders.append_files(source, table, _path(t, "state")).awaitTermination()
    return t.spark.read.schema(ORDER_SCHEMA).parquet(table).groupBy("location_id").agg(F.count(F.lit(1)).alias("n"))
