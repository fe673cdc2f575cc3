"""Streams with duplicates, newer versions and late rows, against the batch result."""

import json
import tempfile

from pyspark.sql import functions as F

from brigade import schemas
from brigade.streaming import alerts, orders, uploads
from tests.conftest import rows

SCHEMA = "location_id string, order_id string, order_date date, order_ts timestamp, total decimal(18,2), ingest_ts timestamp"


def order(i, ts, total, seen):
    return {"location_id": f"L{i % 2}", "order_id": f"o{i}", "order_date": ts[:10], "order_ts": ts, "total": total, "ingest_ts": seen}


FILES = [
    [order(i, f"2025-03-01 {8 + i}:00:00", 10.0 + i, "2025-03-01 20:00:00") for i in range(6)],
    [order(i, f"2025-03-01 {8 + i}:00:00", 20.0 + i, "2025-03-01 21:00:00") for i in range(3)],  # newer versions
    [order(10, "2025-03-01 07:00:00", 5.0, "2025-03-02 05:00:00")],  # late, within the watermark
    [order(11, "2025-03-03 09:00:00", 7.0, "2025-03-03 09:01:00")],
    [order(12, "2025-02-20 09:00:00", 9.0, "2025-03-03 10:00:00")],  # later than the watermark
    [order(13, "2025-03-09 09:00:00", 7.0, "2025-03-09 09:01:00")],  # next days close the windows
    [order(14, "2025-03-12 09:00:00", 1.0, "2025-03-12 09:01:00")],
]


def feed(query, folder, files):
    """One file after the other, each run to the end."""
    for i, part in enumerate(files):
        with open(f"{folder}/{i:03d}.json", "w") as f:
            f.write("\n".join(json.dumps(r, default=str) for r in part))
        q = query()
        q.awaitTermination(120)
        assert q.exception() is None


def dirs(*names):
    base = tempfile.mkdtemp(prefix="stream-")
    import os
    out = []
    for n in names:
        os.makedirs(f"{base}/{n}") if n == "in" else None
        out.append(f"{base}/{n}")
    return out


def test_keep_latest_matches_batch(spark):
    src, table, ck = dirs("in", "table", "ck")
    feed(lambda: orders.keep_latest(orders.read_stream(spark, src, SCHEMA), table, ck), src, FILES)
    everything = spark.read.schema(SCHEMA).json(src)
    want = everything.groupBy("location_id", "order_id", "order_date").agg(F.max_by("total", "ingest_ts").alias("total"))
    cols = ["location_id", "order_id", "total"]
    assert rows(spark.read.parquet(table), *cols) == rows(want, *cols)


def test_keep_latest_leaves_other_days_alone(spark):
    import os

    src, table, ck = dirs("in", "table", "ck")
    feed(lambda: orders.keep_latest(orders.read_stream(spark, src, SCHEMA), table, ck), src, [FILES[0], FILES[3]])
    day = f"{table}/location_id=L0/order_date=2025-03-01"
    before = sorted(os.listdir(day))
    feed(lambda: orders.keep_latest(orders.read_stream(spark, src, SCHEMA), table, ck), src, [FILES[0], FILES[3], FILES[5], FILES[6]])
    assert sorted(os.listdir(day)) == before


def test_usage_alerts_follow_billing_cycles(spark):
    src, table, ck = dirs("in", "alerts", "ck")
    limits = spark.createDataFrame([("u", 10)], "user_id string, max_engagements long")
    cycles = spark.createDataFrame([("u", "2025-01-01", "2025-02-01"), ("u", "2025-02-01", "2025-03-01")], "user_id string, cycle_start string, cycle_end string")
    day = lambda d, n: [{"user_id": "u", "ts": f"{d} 10:{i:02d}:00"} for i in range(n)]
    files = [day("2025-01-02", 4) + day("2025-01-31", 5), day("2025-02-01", 8)]  # nine in January, eight in February
    feed(lambda: alerts.usage_alerts(orders.read_stream(spark, src, "user_id string, ts timestamp"), limits, table, ck, cycles=cycles), src, files)
    got = spark.read.schema("user_id string, cycle_start timestamp, max_engagements long").parquet(table)
    assert rows(got.select("user_id", F.to_date("cycle_start").cast("string").alias("d"))) == [("u", "2025-01-01")]


def test_windows_drop_only_what_is_behind_the_watermark(spark):
    src, table, ck = dirs("in", "table", "ck")
    feed(lambda: orders.write_windows(orders.windowed(orders.read_stream(spark, src, SCHEMA)), table, ck), src, [FILES[0], *FILES[2:]])
    got = rows(spark.read.parquet(table).select("location_id", F.to_date("start").cast("string").alias("d"), "orders", F.col("revenue").cast("double").alias("r")))
    assert got == [
        ("L0", "2025-03-01", 4, 10.0 + 12 + 14 + 5),
        ("L1", "2025-03-01", 3, 11.0 + 13 + 15),
        ("L1", "2025-03-03", 1, 7.0),
        ("L1", "2025-03-09", 1, 7.0),
    ]


def test_first_arrivals_keeps_one_version(spark):
    src, table, ck = dirs("in", "table", "ck")
    def run():
        first = orders.first_arrivals(orders.read_stream(spark, src, SCHEMA))
        return orders.write_windows(first, table, ck)
    feed(run, src, FILES[:2])
    assert sorted(float(r["total"]) for r in spark.read.parquet(table).collect()) == [10.0, 11.0, 12.0, 13.0, 14.0, 15.0]


def test_append_files_tags_and_never_repeats(spark):
    src, table, ck = dirs("in", "table", "ck")
    feed(lambda: orders.append_files(orders.read_stream(spark, src, SCHEMA), table, ck), src, FILES[:3])
    q = orders.append_files(orders.read_stream(spark, src, SCHEMA), table, ck)
    q.awaitTermination(60)
    got = spark.read.parquet(table)
    assert got.count() == 10
    assert rows(got.groupBy("filename").count()) == [("000.json", 6), ("001.json", 3), ("002.json", 1)]


def test_usage_alert_fires_once_per_cycle(spark):
    src, table, ck = dirs("in", "alerts", "ck")
    limits = spark.createDataFrame([("u", 10), ("v", 100)], "user_id string, max_engagements long")

    def day(d, user, n):
        return [{"user_id": user, "ts": f"{d} 10:{i:02d}:00"} for i in range(n)]

    files = [
        day("2025-01-05", "u", 8) + day("2025-01-05", "v", 20),  # 0.8
        day("2025-01-06", "u", 1),  # 0.9: alert
        day("2025-01-07", "u", 5),  # above the limit, no second alert
        day("2025-02-20", "u", 9),  # next cycle: alert again
    ]
    run = lambda: alerts.usage_alerts(orders.read_stream(spark, src, "user_id string, ts timestamp"), limits, table, ck)
    feed(run, src, files[:1])
    assert spark.read.schema("user_id string, cycle_start timestamp, max_engagements long").parquet(table).count() == 0
    base = len(files[:1])
    for i, part in enumerate(files[1:], base):
        with open(f"{src}/{i:03d}.json", "w") as f:
            f.write("\n".join(json.dumps(r) for r in part))
        q = run()
        q.awaitTermination(120)
    got = spark.read.parquet(table)
    assert rows(got, "user_id") == [("u",), ("u",)]
    assert got.select("cycle_start").distinct().count() == 2


def test_uploads_raise_alerts_once(spark):
    src, table, found, ck = dirs("in", "sales", "alerts", "ck")
    schema = ("location_id string, sale_id string, date date, hour int, total_amount decimal(18,2), employee_id string, "
              "payment_method string, discount_percent double")

    def sale(i, day, pct):
        return {"location_id": "L", "sale_id": f"s{i}", "date": day, "hour": 12, "total_amount": 10 + i, "employee_id": "e",
                "payment_method": "Cash", "discount_percent": pct}

    files = [
        [sale(i, "2025-01-01", 5.0) for i in range(5)] + [sale(9, "2025-01-01", 30.0)],
        [sale(9, "2025-01-01", 30.0), sale(20, "2025-01-01", 60.0)],  # one repeated row, one new
    ]
    feed(lambda: uploads.alert_on_upload(orders.read_stream(spark, src, schema), table, f"{table}-figures", found, ck), src, files)
    assert spark.read.parquet(table).count() == 7
    discounts = spark.read.parquet(found).where("category = 'discount_anomalies'")
    assert rows(discounts, "sale_id", "severity") == [("s20", "medium"), ("s9", "low")]
