"""Usage metering on a stream: accept or reject each engagement, alert near the limit, close cycles when their time is over.

State is one counter for each user and cycle, kept together for the users of a bucket: a bucket and cycle is fetched and stored once a
micro-batch, and its rows are numbered as frames, so that users cost no calls of their own. Engagements of a micro-batch are counted in the order of their time and id, behind
all that came in earlier batches; so a log that arrives in the order of time gives what ``usage.metered`` gives on the whole log, and
an engagement that comes late takes the next number. When the watermark passes the end of a cycle, a timer emits the cycle's
counters and drops their state. Engagements of a closed cycle are rejected without a number.

A busy user's rows do not pile up in one task: of each Arrow batch only as many rows of a user and cycle as the limit allows are
contenders, all later ones are over the limit for certain and are dealt out. Of the contenders a task holds those within the
limit, and HELD others at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from brigade.functions.numbers import ratio
from brigade.operators.spread import attach
from brigade.operators.usage import ALERT_SHARE, DEFAULT_LIMIT, TOKENS_PER_ENGAGEMENT
from brigade.streaming.state import rocksdb

ENGAGEMENT, CYCLE = "engagement", "cycle"
SPARE = 64  # tasks' worth of keys among which rows over the limit are dealt
BUCKETS = 512  # groups of users, the same for the whole life of a checkpoint
HELD = 200_000  # rows that are gathered before those over the limit go


def with_cycles(log: DataFrame, cycles: DataFrame) -> DataFrame:
    """Engagements with the billing cycle they fall into (user_id, cycle_start, cycle_end; end exclusive); rows without a user stay, to move the clock."""
    c = cycles.select(F.col("user_id").alias("_user"), F.col("cycle_start").cast("date").alias("cycle_start"), F.col("cycle_end").cast("date").alias("cycle_end"))
    inside = (F.col("user_id") == F.col("_user")) & (F.col("ts") >= F.col("cycle_start")) & (F.col("ts") < F.col("cycle_end"))
    return log.join(c, inside, "left").where("user_id IS NULL OR _user IS NOT NULL").drop("_user")


def _contenders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with the place to which each goes: 0, or a spare one for those behind as many earlier ones as the limit."""
    for batch in batches:
        frame = batch.select(["user_id", "cycle_start", "_at", "engagement_id"]).to_pandas()
        earlier = frame.sort_values(["_at", "engagement_id"]).groupby(["user_id", "cycle_start"], dropna=False).cumcount().sort_index().to_numpy()
        limit = batch.column("_limit").to_numpy(zero_copy_only=False)
        # the first row goes there in any case, so that every cycle has its counter
        place = np.where(earlier < np.maximum(limit, 1), 0, 1 + np.arange(len(limit)) % SPARE)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(place.astype(np.int32))], names=batch.schema.names)


class Meter(StatefulProcessor):
    """Counters of the users of one bucket in one cycle."""

    def __init__(self, user: str) -> None:
        self.user = user  # type of the users' ids

    def init(self, handle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", f"users array<{self.user}>, used array<bigint>")

    def _counters(self) -> dict:
        known = self.used.get()
        return dict(zip(known[0], known[1], strict=True)) if known else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, ends, _, place = key
        if ends <= timerValues.getCurrentWatermarkInMs():
            for part in rows:
                yield _told(part, 0)
            return
        if place:
            for part in rows:
                yield _told(part, part["lim"] + 1)
            return
        counters = self._counters()
        if not counters:
            self.handle.registerTimer(int(ends))
        held, n = [], 0
        for part in rows:
            held.append(part)
            n += len(part)
            if n >= HELD:
                first, over = _first(held, counters)
                yield _told(over, over["lim"] + 1)
                held, n = [first], 0
        first, over = _first(held, counters)
        if len(over):
            yield _told(over, over["lim"] + 1)
        yield _told(first, first["_used"] + first["_rank"] + 1)
        now = {user: counters.get(user, 0) for part in (first, over) for user in part["user_id"].drop_duplicates().tolist()}
        last = first.groupby("user_id", sort=False).size()
        counters |= now | {user: now[user] + n for user, n in zip(last.index.tolist(), last.tolist(), strict=True)}
        self.used.update((list(counters), list(counters.values())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        counters = self._counters()
        self.used.clear()
        if counters:
            n = len(counters)
            yield pd.DataFrame({
                "kind": CYCLE, "user_id": pd.Series(list(counters)), "cycle": int(key[0]), "engagement_id": pd.Series([None] * n, dtype=object), "known": False,
                "lim": 0, "nth": pd.Series(list(counters.values()), dtype="int64")})

    def close(self) -> None:
        pass


def _first(held: list[pd.DataFrame], counters: dict) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Of the rows of several users the earliest of each that still fit its limit, with their rank from 0, and the others."""
    rows = pd.concat(held, ignore_index=True).sort_values(["user_id", "at", "known", "engagement_id"], kind="stable")
    rows["_used"] = rows["user_id"].map(counters).fillna(0).astype("int64") if counters else 0
    rows["_rank"] = rows.groupby("user_id", sort=False).cumcount()
    fits = rows["_used"] + rows["_rank"] < rows["lim"]
    return rows[fits], rows[~fits]


def _told(rows: pd.DataFrame, nth) -> pd.DataFrame:
    """Rows with their place in the cycle, 0 where the cycle is closed."""
    return pd.DataFrame({"kind": ENGAGEMENT, **{c: rows[c] for c in ("user_id", "cycle", "engagement_id", "known", "lim")}, "nth": nth}, index=rows.index)


def _result(told: DataFrame, tokens: int, alert_share: float) -> DataFrame:
    """The columns of ``decisions`` and ``closed_cycles`` from what ``Meter`` gives."""
    nth, limit, cycle = F.col("nth"), F.col("lim"), F.col("kind") == CYCLE
    number = F.when(nth > 0, nth)  # none where the cycle is closed
    used = F.when(cycle, nth).when(number.isNotNull(), F.least(number, limit))  # least alone would skip the null
    accepted = F.coalesce(number <= limit, F.lit(False))
    share = F.when(number.isNotNull(), ratio(used, limit, 0.0))
    before = ratio(number - 1, limit, 0.0)
    alert = accepted & (share >= alert_share) & (before < alert_share)
    return told.select(
        "kind", F.when(F.col("known"), F.col("engagement_id")).alias("engagement_id"), "user_id", F.date_from_unix_date("cycle").alias("cycle_start"),
        used.alias("engagements_used"), (used * tokens).alias("tokens_used"), F.when(~cycle, accepted).alias("accepted"),
        F.when(~cycle, share).alias("share_used"), F.when(~cycle, alert).alias("alert"))


def meter(
    log: DataFrame, limits: DataFrame, table: str, checkpoint: str, delay: str = "1 day", tokens: int = TOKENS_PER_ENGAGEMENT,
    alert_share: float = ALERT_SHARE, **trigger,
) -> StreamingQuery:
    """Meter a stream of engagements: engagement_id, user_id, ts, cycle_start and cycle_end (dates, end exclusive).

    ``limits``: user_id, max_engagements, one row for a user; others have DEFAULT_LIMIT. Each micro-batch writes its rows to a
    folder of its own number, by kind; see ``decisions`` and ``closed_cycles``. A repeated batch overwrites its folder.
    """
    spark = log.sparkSession
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    known = limits.select("user_id", F.col("max_engagements").cast("long").alias("_limit"))
    bounded = attach(timed, known, ["user_id"])
    ends = F.unix_millis(F.col("cycle_end").cast("timestamp"))
    rows = bounded.select(
        "engagement_id", "user_id", F.col("cycle_start").cast("date").alias("cycle_start"), ends.alias("_ends"), F.unix_micros("ts").alias("_at"),
        F.coalesce("_limit", F.lit(DEFAULT_LIMIT)).alias("_limit"), F.lit(0).alias("_place"))
    placed = rows.mapInArrow(_contenders, rows.schema)
    # rows without a user have moved the clock by now; frames have no whole numbers beside nulls, so null ids are marked, and
    # Spark makes named tuples of their rows, which lose names that begin with an underscore
    identity, user = rows.schema["engagement_id"].dataType, rows.schema["user_id"].dataType
    keyed = placed.where("user_id IS NOT NULL AND cycle_start IS NOT NULL").select(
        F.unix_date("cycle_start").alias("cycle"), F.col("_ends").alias("ends"), F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.col("_place").alias("place"), "user_id", F.coalesce("engagement_id", F.lit("0").cast(identity)).alias("engagement_id"),
        F.col("engagement_id").isNotNull().alias("known"), F.coalesce("_at", F.lit(-(1 << 63)).cast("long")).alias("at"), F.col("_limit").alias("lim"))
    out = T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("user_id", user), T.StructField("cycle", T.IntegerType()), T.StructField("engagement_id", identity),
        T.StructField("known", T.BooleanType()), T.StructField("lim", T.LongType()), T.StructField("nth", T.LongType())])
    made = keyed.groupBy("cycle", "ends", "bucket", "place").transformWithStateInPandas(Meter(user.simpleString()), out, "Update", "EventTime")

    def write(batch: DataFrame, number: int) -> None:
        _result(batch, tokens, alert_share).write.mode("overwrite").partitionBy("kind").parquet(f"{table}/batch={number}")

    with rocksdb(spark):
        return made.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
            **(trigger or {"availableNow": True})).start()


def decisions(spark: SparkSession, table: str) -> DataFrame:
    """One row for each engagement so far, with the columns of ``usage.metered``."""
    return spark.read.parquet(table).where(F.col("kind") == ENGAGEMENT).select(
        "engagement_id", "user_id", "cycle_start", "engagements_used", "tokens_used", "accepted", "share_used", "alert")


def closed_cycles(spark: SparkSession, table: str) -> DataFrame:
    """The counters of each cycle that is over, as ``usage.cycle_counters`` has them."""
    return spark.read.parquet(table).where(F.col("kind") == CYCLE).select("user_id", "cycle_start", "engagements_used", "tokens_used")
