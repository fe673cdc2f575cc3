"""Point-of-sale JSON payloads: {result: [...]}, a list, or a single object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<menu_item_name: string, quantity: int, amount: double, food_cost: double>"
ORDER = f"struct<id: string, order_date: string, order_ts: string, total: double, status: string, items: array<{ITEM}>>"
MENU = "struct<id: string, name: string, description: string, category: string, price: double, cost: double>"


def records(payload: Column, record: str) -> Column:
    """All records of a payload text, whichever of the three shapes it has."""
    low = F.ltrim(payload)
    as_list = F.from_json(payload, f"array<{record}>")
    wrapped = F.from_json(payload, f"struct<result: array<{record}>>")["result"]
    single = F.array(F.from_json(payload, record))
    found = F.when(low.startswith("["), as_list).otherwise(F.coalesce(wrapped, single))
    # neither a null nor an object without any known field is a record
    return F.filter(found, lambda r: F.to_json(r) != "{}")


def rejects(payloads: DataFrame, record: str = ORDER) -> DataFrame:
    """Payloads that hold no record: broken text, errors, empty answers."""
    return payloads.where(F.coalesce(F.size(records(F.col("payload"), record)), F.lit(0)) < 1)


def read_payloads(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per file with its whole text; each file is one API answer."""
    return spark.read.option("wholetext", True).text(paths).select(
        F.col("value").alias("payload"), F.col("_metadata.file_path").alias("path")
    )


def orders(payloads: DataFrame, location_id: Column, ingest_ts: Column) -> DataFrame:
    """Canonical POS orders; the date comes from the record or else from the file's name."""
    rows = payloads.select(
        location_id.alias("location_id"), ingest_ts.alias("ingest_ts"), "path",
        F.explode(records(F.col("payload"), ORDER)).alias("r"),
    )
    named = F.to_date(F.nullif(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    return rows.select(
        "location_id",
        F.col("r.id").alias("order_id"),
        F.coalesce(F.col("r.order_date").try_cast("date"), named).alias("order_date"),
        F.col("r.order_ts").try_cast("timestamp").alias("order_ts"),
        F.coalesce(F.col("r.total"), F.lit(0)).cast("decimal(18,2)").alias("total"),
        F.col("r.status").alias("status"),
        F.col("r.items").alias("items"),
        "ingest_ts",
    )


def menu(payloads: DataFrame, location_id: Column) -> DataFrame:
    rows = payloads.select(
        location_id.alias("location_id"), F.explode(records(F.col("payload"), MENU)).alias("r")
    )
    return rows.select(
        "location_id",
        F.coalesce("r.id", F.lit("")).alias("item_id"),
        F.coalesce("r.name", F.lit("")).alias("name"),
        F.coalesce("r.description", F.lit("")).alias("description"),
        F.coalesce("r.category", F.lit("")).alias("category"),
        F.coalesce("r.price", F.lit(0)).cast("decimal(18,2)").alias("price"),
        F.coalesce("r.cost", F.lit(0)).cast("decimal(18,2)").alias("cost"),
        F.to_json("r").alias("data"),
    )
