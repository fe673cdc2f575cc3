"""Alerts from streams: usage near the limit. Alerts on uploads are in ``uploads``, metering with limits in ``metering``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brigade.functions.numbers import ratio
from brigade.operators.usage import ALERT_SHARE, with_default_limit
from brigade.sources import sinks

def usage_alerts(
    log: DataFrame, limits: DataFrame, alerts: str, checkpoint: str, cycle: str = "30 days",
    delay: str = "1 day", alert_share: float = ALERT_SHARE, cycles: DataFrame | None = None, **trigger,
) -> StreamingQuery:
    """One alert per user and cycle when the share of the limit reaches the mark.

    Wants user_id and ts in the log; each engagement arrives once. Counts are merged map-side, so a busy
    user is one small state row, and a new cycle starts at zero. ``cycles`` (user_id, cycle_start, cycle_end; end
    exclusive) are the billing cycles of the subscriptions; their state is one row per user and cycle. Without them
    windows of ``cycle`` are used, whose state is dropped once the watermark has passed their end.
    """
    if cycles is None:
        counts = log.withWatermark("ts", delay).groupBy("user_id", F.window("ts", cycle).alias("w")).agg(
            F.count(F.lit(1)).alias("used")).select("user_id", F.col("w.start").alias("cycle_start"), "used")
    else:
        c = cycles.select(F.col("user_id").alias("_user"), F.col("cycle_start").cast("timestamp").alias("cycle_start"),
                          F.col("cycle_end").cast("timestamp").alias("_end"))
        inside = (F.col("user_id") == F.col("_user")) & (F.col("ts") >= F.col("cycle_start")) & (F.col("ts") < F.col("_end"))
        counts = log.join(c, inside).groupBy("user_id", "cycle_start").agg(F.count(F.lit(1)).alias("used"))

    def write(batch: DataFrame, _: int) -> None:
        share = ratio(F.least("used", "max_engagements"), "max_engagements", 0.0)
        hit = (
            with_default_limit(batch, limits)
            .where(share >= alert_share)
            .select("user_id", "cycle_start", "max_engagements")
        )
        sinks.insert_new(hit, alerts, ("user_id", "cycle_start"), partition_by=("cycle_start",))

    return (
        counts.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
