"""Summaries and alerts that are kept up to date batch by batch, against the batch operators over all rows."""

import glob
import os
import random
import tempfile

from pyspark.sql import functions as F

from brigade.operators import anomaly, anomaly_history, pos
from brigade.plans import catalogue
from brigade.sources import sinks
from brigade.streaming import summaries, uploads
from tests.conftest import rows

ORDERS = ("location_id string, order_id string, order_date date, order_ts timestamp, total decimal(18,2), status string, "
          "items array<struct<menu_item_name: string, quantity: int, amount: double, food_cost: double>>, ingest_ts timestamp")


def order_rows(spark, rnd, n, age, days=(1, 2, 3)):
    data = []
    for _ in range(n):
        i, day = rnd.randrange(40), rnd.choice(days)
        items = [(rnd.choice(["Pie", "Tea", "Soup", None]), rnd.randrange(1, 4), 2.0, 1.0) for _ in range(rnd.randrange(0, 4))]
        ts = None if rnd.random() < 0.1 else f"2025-03-{day:02d} {rnd.randrange(24):02d}:00:00"
        data.append((rnd.choice(["L", "M", None]), f"o{i}", f"2025-03-{day:02d}", ts, str(rnd.randrange(100)), "x", items, f"2025-04-01 {rnd.randrange(age, age + 3):02d}:{rnd.randrange(60):02d}:{rnd.randrange(60):02d}"))
    raw = spark.createDataFrame(data, "location_id string, order_id string, d string, t string, total string, status string, " + ORDERS[ORDERS.index("items") : ORDERS.index(", ingest")] + ", s string")
    return raw.select("location_id", "order_id", F.col("d").cast("date").alias("order_date"), F.col("t").cast("timestamp").alias("order_ts"),
                      F.col("total").cast("decimal(18,2)").alias("total"), "status", "items", F.col("s").cast("timestamp").alias("ingest_ts"))


def flat(summary):
    days = rows(summary.select("location_id", F.col("order_date").cast("string"), "total_orders", F.col("total_revenue").cast("double"), "average_order_value"))
    items = rows(summary.select("location_id", F.col("order_date").cast("string"), F.explode_outer("top_items")))
    hours = rows(summary.select("location_id", F.col("order_date").cast("string"), F.explode_outer("hourly_revenue").alias("h", "r")).select("location_id", "order_date", "h", F.col("r").cast("double")))
    return days, items, hours


class Broken(Exception):
    pass


def test_summary_after_any_batches(spark, monkeypatch):
    rnd, base = random.Random(1), tempfile.mkdtemp(prefix="incremental-")
    table, sums = f"{base}/orders", f"{base}/sums"
    batches = [order_rows(spark, rnd, 50, age) for age in (4, 1, 6, 3)]  # newer and older versions in turn
    write, calls = sinks.replace_partitions, []

    def breaks(df, path, by):
        """The second batch breaks off between the sums and the orders, the third before the sums."""
        calls.append(path)
        if (len(calls), path) in {(4, table), (7, sums)}:
            raise Broken
        write(df, path, by)

    monkeypatch.setattr(sinks, "replace_partitions", breaks)
    for number, batch in enumerate(batches):
        for _ in range(2):  # repeated after the break, or after all was done
            try:
                summaries.apply(batch, number, table, sums)
            except Broken:
                summaries.apply(batch, number, table, sums)
    whole = batches[0].unionByName(batches[1]).unionByName(batches[2]).unionByName(batches[3])
    latest = sinks.latest(whole, ["location_id", "order_id", "order_date"], ["ingest_ts"])
    stored = spark.read.schema(ORDERS).parquet(table)
    assert rows(stored.select("order_id", F.col("ingest_ts").cast("string"))) == rows(latest.select("order_id", F.col("ingest_ts").cast("string")))
    got = summaries.daily_summary(summaries.sums_of(spark, sums, whole.schema))
    # a null store is a group of its own; joins of the batch operator drop its maps, so it is compared by its totals
    assert flat(got.where("location_id IS NOT NULL")) == flat(pos.daily_summary(latest.where("location_id IS NOT NULL")))
    assert flat(got)[0] == rows(pos.day_totals(latest).select("location_id", F.col("order_date").cast("string"), "total_orders", F.col("total_revenue").cast("double"), "average_order_value"))


def test_rows_of_the_summary_are_saved_by_each_batch(spark, monkeypatch):
    """Days that share a folder stay apart, and the saved rows follow the orders, also after a break behind any of the three writes."""
    rnd, base = random.Random(2), tempfile.mkdtemp(prefix="incremental-")
    table, sums, daily = f"{base}/orders", f"{base}/sums", f"{base}/daily"
    batches = [order_rows(spark, rnd, 50, age, days) for age, days in ((4, (1, 2, 3)), (1, (2, 4)), (6, (3, 4)), (3, (1, 4)))]
    write, left = sinks.replace_partitions, []

    def breaks(df, path, by):
        write(df, path, by)
        if left and left.pop():
            raise Broken

    monkeypatch.setattr(sinks, "replace_partitions", breaks)
    whole = None
    for number, batch in enumerate(batches):
        left[:] = [[], [True], [True, False], [True, False, False]][number]  # the last one says what the next write does
        for _ in range(2):
            try:
                summaries.apply(batch, number, table, sums, partition_by=("location_id",), daily=daily)
            except Broken:
                summaries.apply(batch, number, table, sums, partition_by=("location_id",), daily=daily)
        whole = batch if whole is None else whole.unionByName(batch)
        latest = sinks.latest(whole, ["location_id", "order_id", "order_date"], ["ingest_ts"])
        got = summaries.saved(spark, daily, whole.schema)
        assert flat(got.where("location_id IS NOT NULL")) == flat(pos.daily_summary(latest.where("location_id IS NOT NULL")))
        assert flat(got)[0] == rows(pos.day_totals(latest).select("location_id", F.col("order_date").cast("string"), "total_orders", F.col("total_revenue").cast("double"), "average_order_value"))
    assert rows(spark.read.schema(ORDERS).parquet(table).select("order_id", F.col("ingest_ts").cast("string"))) == rows(latest.select("order_id", F.col("ingest_ts").cast("string")))
    # the last batch brought nothing for the second and third day
    marks = summaries.sums_of(spark, sums, whole.schema).where("kind = 'total'").groupBy(F.dayofmonth("order_date").alias("d")).agg(F.max("last_batch"))
    assert rows(marks)[1:3] == [(2, 1), (3, 2)]


def test_totals_of_the_stream_are_those_of_days(spark):
    """Two days of one quarter are two rows, and orders without a date or total count as well."""
    base = tempfile.mkdtemp(prefix="days-")
    some = [(3, 1, "F", 5.0, "1998-02-01"), (4, 1, "F", 6.0, "1998-02-01"), (6, 2, "F", 7.0, "1998-02-02"), (7, 1, "F", 8.0, None), (9, 1, "F", None, "1997-12-31"), (10, 2, "F", 9.0, "1997-12-31")]
    spark.createDataFrame(some, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string").write.parquet(f"{base}/orders.parquet")
    spark.createDataFrame([(1, 5), (2, None)], "c_custkey long, c_nationkey int").write.parquet(f"{base}/customer.parquet")
    spark.createDataFrame([(1, "Pie"), (2, "Tea")], "p_partkey long, p_name string").write.parquet(f"{base}/part.parquet")
    lines = [(k, k % 2 + 1, 2.0, 3.0) for k in (3, 4, 6, 9)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double").write.parquet(f"{base}/lineitem.parquet")
    got = catalogue.runnable("stream_daily_summary_totals")(spark, base)
    assert rows(got, "location_id", "order_date", "total_orders", "total_revenue", "average_order_value") == sorted([
        (5, "1998-02-01", 2, 11.0, 5.5), (5, None, 1, 8.0, 8.0), (5, "1997-12-31", 1, 0.0, 0.0), (None, "1998-02-02", 1, 7.0, 7.0), (None, "1997-12-31", 1, 9.0, 9.0)],
        key=lambda r: tuple(map(str, r)))


def test_untouched_days_are_not_read(spark):
    rnd, base = random.Random(3), tempfile.mkdtemp(prefix="incremental-")
    table, sums = f"{base}/orders", f"{base}/sums"
    first = order_rows(spark, rnd, 60, 1).where("location_id IS NOT NULL")
    summaries.apply(first, 0, table, sums)
    for path in (table, sums):
        for f in glob.glob(f"{path}/location_id=*/order_date=2025-03-01/part-*"):
            os.truncate(f, 10)  # reading it would fail
    summaries.apply(order_rows(spark, rnd, 20, 5, days=(2, 4)).where("location_id IS NOT NULL"), 1, table, sums)
    assert summaries.sums_of(spark, sums, first.schema).where("order_date > '2025-03-01' AND kind = 'total' AND last_batch = 1").count() > 0


SALES = ("location_id string, sale_id string, date date, hour int, total_amount decimal(18,2), employee_id string, payment_method string, discount_percent double")


def sales_rows(spark, rnd, day, n):
    data = []
    for k in range(n):
        amount = None if rnd.random() < 0.05 else rnd.choice([10, 10, 11, 12, 500 if rnd.random() < 0.1 else 13])
        data.append((rnd.choice(["L", "L", "M"]), f"s{day}-{k}", f"2025-03-{day:02d}", rnd.choice([None, 3, 9, 12, 12, 12, 18]), str(amount) if amount else None,
                     rnd.choice(["e1", "e2", None]), rnd.choice(["Cash", "Card", "Card", "Check" if rnd.random() < 0.2 else "Card", None]), float(rnd.choice([0, 5, 25, 60]))))
    return spark.createDataFrame(data, "location_id string, sale_id string, d string, hour int, t string, employee_id string, payment_method string, discount_percent double").select(
        "location_id", "sale_id", F.col("d").cast("date").alias("date"), "hour", F.col("t").cast("decimal(18,2)").alias("total_amount"), "employee_id", "payment_method", "discount_percent")


def found(df):
    return rows(df.select("location_id", "category", "pattern", "sale_id", "employee_id", F.col("amount").cast("double"), F.col("date").cast("string"), "hour", F.round("score", 6), "severity"))


LIMITS = {"high_value_threshold": 2.0, "repeated_at_least": 10}


def test_alerts_against_the_whole_history(spark):
    rnd, base = random.Random(4), tempfile.mkdtemp(prefix="uploads-")
    table, history, alerts = f"{base}/sales", f"{base}/history", f"{base}/alerts"
    whole = None
    for number in range(4):
        batch = sales_rows(spark, rnd, number + 1, 60)
        again = batch if whole is None else batch.unionByName(whole.limit(20))  # known sales come again and are no new ones
        for _ in range(2):  # a repeated batch changes nothing
            uploads.apply(again, number, table, history, alerts, merge_every=2, **LIMITS)
        whole = batch if whole is None else whole.unionByName(batch)
        want = anomaly.all_anomalies(whole, *LIMITS.values()).where(F.col("date") == F.lit(f"2025-03-{number + 1:02d}").cast("date"))
        assert found(spark.read.parquet(f"{alerts}/upload={number}")) == found(want)
        assert spark.read.parquet(table).count() == 60 * (number + 1)
    # what was merged is gone, and the history still stands for all sales
    assert len(os.listdir(f"{history}/employee/batches")) <= 2 and len(os.listdir(f"{history}/employee/merged")) == 1
    every = uploads.known(spark, history, 99)
    assert found(anomaly_history.judged(whole, every, **LIMITS)) == found(anomaly.all_anomalies(whole, *LIMITS.values()))
    got = rows(anomaly_history.baseline(every["location"], "2025-04-01").select("location_id", F.round("mean_amount", 9), F.round("std_amount", 9)))
    assert got == rows(anomaly.baseline(whole, "2025-04-01").select("location_id", F.round("mean_amount", 9), F.round("std_amount", 9)))


def test_moments_far_from_zero_merge_exactly(spark):
    """Large amounts with a small spread: differences of squares would lose it."""
    rnd = random.Random(5)
    data = [("L", "e", str(1e9 + rnd.randrange(100) / 100), k % 7) for k in range(700)]
    df = spark.createDataFrame(data, "location_id string, employee_id string, t string, part int").select(
        "location_id", "employee_id", F.col("t").cast("decimal(18,2)").alias("total_amount"), F.lit(1).alias("hour"), "part")
    each = None
    for k in range(7):
        part = anomaly_history.moments(df.where(F.col("part") == k), ["location_id"])
        each = part if each is None else each.unionByName(part)
    got = anomaly_history.amount_stats(anomaly_history.merge("location", each)).first()
    want = anomaly.amount_stats(df, "location_id").first()
    assert got["mean_amount"] == want["mean_amount"] and abs(got["std_amount"] / want["std_amount"] - 1) < 1e-6


def test_a_folder_gets_few_files(spark):
    """Rows are brought together by folder before a write: tasks do not put a file each into every folder."""
    base = tempfile.mkdtemp(prefix="folders-")
    rows_in = spark.range(400).select((F.col("id") % 5).alias("location_id"), (F.col("id") % 3).alias("order_date"), "id").repartition(20)
    for k, write in enumerate((lambda p: sinks.replace_partitions(rows_in, p, ("location_id", "order_date")),
                               lambda p: sinks.insert_new(rows_in, p, ["location_id", "order_date", "id"], ("location_id", "order_date")),
                               lambda p: sinks.append_tagged(rows_in, p, "a.csv", ("location_id", "order_date")))):
        write(f"{base}/{k}")
        assert len(glob.glob(f"{base}/{k}/location_id=*/order_date=*/part-*")) == 15
        assert spark.read.parquet(f"{base}/{k}").count() == 400


def test_parts_of_orders_with_gaps(spark):
    """Items without a name or quantity, null items, orders without items or time; taken out again nothing is left."""
    data = [("L", "o1", [("Pie", 2, 1.0, 1.0), None, (None, None, 1.0, 1.0)], "2025-03-01 05:00:00", "3"), ("L", "o2", None, None, None), (None, "o3", [], "2025-03-01 05:10:00", "4")]
    raw = spark.createDataFrame(data, "location_id string, order_id string, " + ORDERS[ORDERS.index("items") : ORDERS.index(", ingest")] + ", t string, total string")
    some = raw.select("location_id", F.lit("2025-03-01").cast("date").alias("order_date"), F.col("t").cast("timestamp").alias("order_ts"), F.col("total").cast("decimal(18,2)").alias("total"), "items")
    made = summaries.parts(some)
    assert rows(made.select("location_id", "kind", "name", "rows", "quantity", F.col("amount").cast("double"))) == sorted([
        ("L", "total", "", 1, 0, 3.0), ("L", "hour", "5", 1, 0, 3.0), ("L", "item", "Pie", 1, 2, 0.0), ("L", "item", "Unknown", 1, 0, 0.0), ("L", "item", "Unknown", 1, 0, 0.0),
        ("L", "total", "", 1, 0, 0.0), (None, "total", "", 1, 0, 4.0), (None, "hour", "5", 1, 0, 4.0)], key=lambda r: tuple(map(str, r)))
    assert summaries.merged(made.unionByName(summaries.parts(some, -1))).count() == 0
