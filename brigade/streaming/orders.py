"""Order streams: landing, keep-latest tables and windowed summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brigade.functions.numbers import MONEY
from brigade.operators.spread import scratch
from brigade.sources import sinks

ORDER_KEY = ("location_id", "order_id", "order_date")


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream, with a fixed schema."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.load(path)


def first_arrivals(orders: DataFrame, delay: str = "1 day", keys: Sequence[str] = ORDER_KEY) -> DataFrame:
    """Each order once, the first version that arrives; state is dropped behind the watermark."""
    return orders.withWatermark("order_ts", delay).dropDuplicatesWithinWatermark(list(keys))


def keep_latest(orders: DataFrame, table: str, checkpoint: str, newest_by: Sequence[str] = ("ingest_ts",),
                partition_by: Sequence[str] = ("location_id", "order_date"), **trigger) -> StreamingQuery:
    """Upsert each micro-batch into the table. Replaying a batch gives the same table.

    The table is partitioned by columns of the key, location and order date unless told otherwise: a batch reads and
    rewrites the days it touches and no others.
    """
    def write(batch: DataFrame, _: int) -> None:
        with scratch(batch.sparkSession):
            sinks.upsert_latest(batch, table, ORDER_KEY, newest_by, partition_by=partition_by)

    return orders.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(orders: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Orders and revenue per store and tumbling window; partial sums are merged before the shuffle."""
    w = F.window("order_ts", width)
    sums = orders.withWatermark("order_ts", delay).groupBy("location_id", w).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("total").cast(MONEY)).alias("revenue")
    )
    return sums.select("location_id", F.col("window.start").alias("start"), "orders", "revenue")


def write_windows(summary: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Closed windows only, once each, as parquet."""
    return (
        summary.writeStream.format("parquet").outputMode("append").option("path", table)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def append_files(rows: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Rows appended to one table per restaurant, each file exactly once, tagged with its name."""
    tagged = rows.withColumn("filename", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return (
        tagged.writeStream.format("parquet").partitionBy("location_id").option("path", table)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
