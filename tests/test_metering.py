"""Metering on a stream against the batch operators, in several batches, after restarts, at the end of cycles."""

import random

import pytest
from pyspark.sql import functions as F

from brigade.operators import usage
from brigade.streaming import metering, orders
from tests.conftest import rows
from tests.test_streaming import dirs, feed

LOG = "engagement_id bigint, user_id string, ts timestamp, cycle_start date, cycle_end date"
LIMITS = [("a", 5), ("b", 40), ("none", 0)]
COLUMNS = ["engagement_id", "user_id", "cycle_start", "engagements_used", "tokens_used", "accepted", "share_used", "alert"]


def row(i, user, day, minute, cycle):
    start, end = cycle
    return {"engagement_id": i, "user_id": user, "ts": f"2025-01-{day:02d} {minute // 60:02d}:{minute % 60:02d}:00", "cycle_start": f"2025-01-{start:02d}",
            "cycle_end": f"2025-01-{end:02d}"}


WEEKS = [(1, 8), (8, 15), (15, 22)]


def log(seed):
    """Three weeks; user c has the default limit, a third of all rows belong to b."""
    rnd = random.Random(seed)
    out = []
    for i in range(400):
        week = rnd.choice(WEEKS)
        out.append(row(i, rnd.choice("aabbbc") if i % 9 else "none", rnd.randrange(week[0], week[1]), rnd.randrange(0, 1440, 30), week))
    return sorted(out, key=lambda r: (r["ts"], r["engagement_id"]))


def clock(day):
    return {"engagement_id": None, "user_id": None, "ts": f"2025-02-{day:02d} 00:00:00", "cycle_start": None, "cycle_end": None}


def batch_log(spark, parts):
    data = [r for p in parts for r in p if r["user_id"]]
    return spark.createDataFrame([(r["engagement_id"], r["user_id"], r["ts"], r["cycle_start"]) for r in data], "engagement_id bigint, user_id string, t string, c string").select(
        "engagement_id", "user_id", F.col("t").cast("timestamp").alias("ts"), F.col("c").cast("date").alias("cycle_start"))


@pytest.mark.parametrize("seed,parts", [(1, 5), (2, 2)])
def test_stream_equals_batch_after_restarts(spark, seed, parts):
    src, table, ck = dirs("in", "table", "ck")
    limits = spark.createDataFrame(LIMITS, "user_id string, max_engagements bigint")
    data = log(seed)
    step = len(data) // parts + 1
    files = [data[k * step : (k + 1) * step] for k in range(parts)]
    # each part is a run of its own: the counters live through the restart; a row without a user only moves the clock
    feed(lambda: metering.meter(orders.read_stream(spark, src, LOG), limits, table, ck, delay="1 hour"), src, [*files, [clock(20)]])
    whole = batch_log(spark, files)
    want = usage.metered(whole, limits)
    assert rows(metering.decisions(spark, table), *COLUMNS) == rows(want, *COLUMNS)
    assert metering.decisions(spark, table).where("alert").count() > 3
    # every cycle was closed once, with the batch's counters, and nothing is left in the state
    assert rows(metering.closed_cycles(spark, table)) == rows(usage.cycle_counters(whole, limits).select("user_id", "cycle_start", "engagements_used", "tokens_used"))
    state = spark.read.format("statestore").option("stateVarName", "used").load(ck)
    assert state.count() == 0


def test_late_rows_take_the_next_number_and_closed_cycles_reject(spark):
    src, table, ck = dirs("in", "table", "ck")
    limits = spark.createDataFrame(LIMITS, "user_id string, max_engagements bigint")
    files = [
        [row(1, "a", 3, 600, WEEKS[0]), row(2, "a", 3, 610, WEEKS[0])],
        [row(3, "a", 2, 0, WEEKS[0])],  # earlier than what was counted
        [row(5, "a", 16, 0, WEEKS[2]), row(4, "a", 16, 0, WEEKS[2])],  # the same time: by id; closes the first cycle
        [row(6, "a", 4, 0, WEEKS[0])],
    ]
    feed(lambda: metering.meter(orders.read_stream(spark, src, LOG), limits, table, ck, delay="1 hour"), src, files)
    assert rows(metering.decisions(spark, table).select("engagement_id", "engagements_used", "accepted")) == [
        (1, 1, True), (2, 2, True), (3, 3, True), (4, 1, True), (5, 2, True), (6, None, False)]
    assert rows(metering.closed_cycles(spark, table).select("engagements_used")) == [(3,)]


def test_a_busy_user_is_dealt_out(spark):
    """Rows over the limit do not go to the user's task."""
    import pyarrow as pa

    src, table, ck = dirs("in", "table", "ck")
    limits = spark.createDataFrame(LIMITS, "user_id string, max_engagements bigint")
    data = [row(i, "b", 2, i % 1400, WEEKS[0]) for i in range(3000)]
    feed(lambda: metering.meter(orders.read_stream(spark, src, LOG), limits, table, ck, delay="1 hour"), src, [data])
    assert rows(metering.decisions(spark, table), *COLUMNS) == rows(usage.metered(batch_log(spark, [data]), limits), *COLUMNS)
    batch = pa.RecordBatch.from_pydict({
        "engagement_id": [*range(100)], "user_id": ["b"] * 100, "cycle_start": [0] * 100, "_ends": [1] * 100, "_at": [*range(100, 0, -1)],
        "_limit": [10] * 100, "_place": [0] * 100})
    placed = next(metering._contenders(iter([batch]))).column("_place").to_pylist()
    assert [p == 0 for p in placed] == [False] * 90 + [True] * 10 and len(set(placed)) > 60


def test_cycles_of_subscriptions(spark):
    log = spark.createDataFrame([(1, "a", "2025-01-03 10:00:00"), (2, "a", "2025-02-01 00:00:00"), (3, "x", "2025-01-03 10:00:00"), (4, None, "2025-01-03 10:00:00")],
                                "engagement_id bigint, user_id string, t string").select("engagement_id", "user_id", F.col("t").cast("timestamp").alias("ts"))
    cycles = spark.createDataFrame([("a", "2025-01-01", "2025-02-01"), ("a", "2025-02-01", "2025-03-01")], "user_id string, cycle_start string, cycle_end string")
    got = rows(metering.with_cycles(log, cycles).select("engagement_id", F.col("cycle_start").cast("string")))
    assert got == [(1, "2025-01-01"), (2, "2025-02-01"), (4, None)]


def test_one_call_for_the_users_of_a_bucket(spark):
    """The state has a row for each bucket and cycle, not one for each user; each user keeps a counter and a limit of its own."""
    src, table, ck = dirs("in", "table", "ck")
    n = 2 * metering.BUCKETS
    limits = spark.createDataFrame([(f"u{k}", k % 3) for k in range(n)], "user_id string, max_engagements bigint")
    files = [[row(3 * k + i, f"u{k}", 2 + i, 600, WEEKS[0]) for k in range(n)] for i in range(3)]
    files[1].append(row(None, "u1", 2, 700, WEEKS[0]))
    feed(lambda: metering.meter(orders.read_stream(spark, src, LOG), limits, table, ck, delay="1 hour"), src, [files[0] + files[1], files[2]])
    got = metering.decisions(spark, table)
    assert rows(got, *COLUMNS) == rows(usage.metered(batch_log(spark, files), limits), *COLUMNS)
    assert got.where("accepted").count() == n // 3 * 3
    state = spark.read.format("statestore").option("stateVarName", "used").load(ck)
    assert state.count() <= metering.BUCKETS
