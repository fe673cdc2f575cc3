"""Pages of a large ordered list: the order is laid down once, and a page reads only the slices it lies in."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_ROWS = 100_000


class Directory(NamedTuple):
    """An ordered list on disk: its rows by slice, and how many each slice holds."""

    path: str
    before: tuple[int, ...]  # rows before each slice, and in all
    slices: tuple[int, ...]

    @property
    def total(self) -> int:
        return self.before[-1]


def build(df: DataFrame, order: Sequence[Column], path: str, slice_rows: int = SLICE_ROWS) -> Directory:
    """Write the rows of ``df`` in slices of about ``slice_rows`` in the given order, which must be unique.

    The input should be stored: it is counted, sampled for the borders of slices and then read once more.
    """
    slices = max(1, -(-df.count() // slice_rows))
    laid = df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id())
    # slices are sorted where they lie: the window's key is that of the shuffle's task
    numbered = laid.withColumn("_at", F.row_number().over(Window.partitionBy("_slice").orderBy(*order)) - 1)
    numbered.write.partitionBy("_slice").parquet(f"{path}/rows")
    counts = df.sparkSession.read.parquet(f"{path}/rows").groupBy("_slice").agg(F.count(F.lit(1)).alias("n"))
    counts.write.parquet(f"{path}/counts")
    return open_directory(df.sparkSession, path)


def open_directory(spark: SparkSession, path: str) -> Directory:
    """A directory that was built before, also by another session; one short row per slice comes to the driver."""
    before, slices = [0], []
    for number, n in sorted(tuple(r) for r in spark.read.parquet(f"{path}/counts").select("_slice", "n").collect()):
        slices.append(number)
        before.append(before[-1] + n)
    return Directory(path, tuple(before), tuple(slices))


def page(spark: SparkSession, directory: Directory, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + limit - 1 with their ``position`` in the whole list, from the slices that hold them."""
    rows = spark.read.parquet(f"{directory.path}/rows")
    wanted, place = F.lit(False), F.lit(0)
    for number, begin, end in zip(directory.slices, directory.before, directory.before[1:]):
        if begin < offset + limit and end > offset:
            here = F.col("_slice") == number
            wanted = wanted | (here & F.col("_at").between(max(offset - begin, 0), offset + limit - 1 - begin))
            place = F.when(here, F.lit(begin)).otherwise(place)
    return rows.where(wanted).withColumn("position", (place + F.col("_at")).cast("long")).drop("_slice", "_at")
