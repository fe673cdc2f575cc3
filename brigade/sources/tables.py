"""Stored tables: scans by location and date, and retention."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(
    spark: SparkSession, path: str, columns: Sequence[str], locations: Sequence | None = None,
    start: dt.date | None = None, end: dt.date | None = None, date_column: str = "date",
) -> DataFrame:
    """Projected and filtered parquet scan; both reach the files."""
    df = spark.read.parquet(path)
    if locations is not None:
        df = df.where(F.col("location_id").isin(list(locations)))
    if start is not None:
        df = df.where(F.col(date_column) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(date_column) <= F.lit(end))
    return df.select(*columns)


def scan_jdbc(
    spark: SparkSession, url: str, table: str, columns: Sequence[str], partition_column: str,
    lower: int, upper: int, partitions: int, **options: str,
) -> DataFrame:
    """Relational scan split over a numeric column, so that the executors read in parallel."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=partition_column, lowerBound=str(lower),
                 upperBound=str(upper), numPartitions=str(partitions), **options)
        .load()
        .select(*columns)
    )


def kept(df: DataFrame, as_of: dt.date, days: int = 30, col: str = "date") -> DataFrame:
    """Rows not older than the retention; rows without a date stay."""
    return df.where(F.col(col).isNull() | (F.col(col) >= F.lit(as_of - dt.timedelta(days=days))))


def without_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key was not deleted."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")
