"""CSV uploads: scans, header checks and file profiles. Every column is read as text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brigade.functions.clean import header_name
from brigade.operators.spread import top_within
from brigade.sources import csv_records

# Required columns, groups of which one is needed, and recommended columns per category.
HEADER_RULES = {
    "Labor": {
        "required": ["date", "hours worked"],
        "at_least_one": [["position", "role"], ["hourly rate", "total wages"]],
        "recommended": ["employee id", "name", "regular hours", "overtime hours"],
    },
    "Inventory": {
        "required": ["date", "ingredient", "quantity"],
        "at_least_one": [["unit cost", "total value"]],
        "recommended": ["category", "unit of measure", "par level"],
    },
    "Sales": {
        "required": ["date"],
        "at_least_one": [["total amount", "subtotal", "total sales", "revenue"]],
        "recommended": ["sale id", "items sold", "order type", "payment method"],
    },
    "Menu": {
        "required": ["menu item"],
        "at_least_one": [["item price", "unit cost"]],
        "recommended": ["category", "ingredient", "amount"],
    },
}


def file_name(path: Column | None = None) -> Column:
    return F.element_at(F.split(F.input_file_name() if path is None else path, "/"), -1)


def headers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per file: its header line, names lower-cased and trimmed.

    Each task keeps one candidate line per file, so no file is gathered as a whole.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"),
    ).where(F.col("_at") == 0)
    first = lines.groupBy("path").agg(F.min_by("value", "_id").alias("line"))
    # commas inside quotes belong to a name
    cells = F.split("line", r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    names = F.transform(cells, lambda c: F.trim(F.replace(F.lower(c), F.lit('"'), F.lit(""))))
    return first.select("path", file_name(F.col("path")).alias("filename"), names.alias("columns"))


def check_headers(header_rows: DataFrame, category: str) -> DataFrame:
    """One row per file: is it valid, and what is missing."""
    if category not in HEADER_RULES:
        raise ValueError(f"unknown category {category}, expected one of {sorted(HEADER_RULES)}")
    rules = HEADER_RULES[category]

    def texts(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    lacking = [
        F.when(~F.arrays_overlap("columns", texts(group)), F.lit(" or ".join(group))) for group in rules["at_least_one"]
    ]
    return header_rows.select(
        "filename",
        "columns",
        F.array_except(texts(rules["required"]), F.col("columns")).alias("missing_required"),
        F.filter(F.array(*lacking), lambda x: x.isNotNull()).alias("missing_one_of"),
        F.array_except(texts(rules["recommended"]), F.col("columns")).alias("missing_recommended"),
    ).withColumn("valid", (F.size("missing_required") == 0) & (F.size("missing_one_of") == 0))


OPTIONS = {"escape": '"', "mode": "PERMISSIVE"}


def read_upload(spark: SparkSession, path: str | Sequence[str], header: Sequence[str], breaks: bool = True) -> DataFrame:
    """Files that share one header, all columns as text, with the file's name; every file is read in splits.

    Line breaks inside quotes are kept; with ``breaks=False`` the files are known to have none.
    """
    columns = [header_name(c) for c in header]
    if breaks:
        return csv_records.read(spark, path, columns, OPTIONS).withColumn("filename", file_name(F.col("path"))).drop("path")
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.option("header", True).options(**OPTIONS).schema(schema).csv(path)
    return df.withColumn("filename", file_name(F.col("_metadata.file_path")))


def read_category(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All files of a category, columns aligned by name.

    One scan per different header over the files that have it; those with line breaks inside quotes, which a scan of the
    text finds, are read by records. The file names pass through the driver, as they do for any scan.
    """
    broken = set(csv_records.with_breaks(spark, paths))
    variants: dict[tuple, list[str]] = {}
    for r in headers(spark, paths).select("columns", "path").toLocalIterator():
        variants.setdefault((tuple(r["columns"]), r["path"] in broken), []).append(unquote(r["path"]))
    parts = [read_upload(spark, sorted(own), columns, breaks) for (columns, breaks), own in sorted(variants.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_all(spark: SparkSession, folders: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """A lazy frame per category."""
    return {category: read_category(spark, paths) for category, paths in folders.items()}


def file_profile(rows: DataFrame) -> DataFrame:
    """Rows and columns per file."""
    width = len([c for c in rows.columns if c != "filename"])
    return rows.groupBy("filename").agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(width))


def preview(rows: DataFrame, order: str, n: int = 5) -> DataFrame:
    return top_within(rows, ["filename"], [F.col(order)], n)
