"""CSV uploads, JSON payloads and sinks on real files."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brigade.operators import pos, silver
from brigade.sources import csv_files, pos_json, sinks, tables
from tests.conftest import rows

SALES_A = """Date,Sale ID,Time,Items Sold,Number of Items,Subtotal,Tip,Total Amount,Employee ID,Is Loyalty Member,Promotion ID,Discount Percent,Order Type,Payment Method,Covers
17/09/2024,T-81,18:05:00,Ramen;Gyoza;Tea,3,42,4.25,46.25,733,TRUE,9,25,Patio,Voucher,4
2024-09-17,T-82,25:99:00,"[""Ramen"",""Gyoza""]",2,abc,,20,734,yes,,0,Counter,,x
09/17/2024,T-83,9:00:00,,0,5,0,5,734,x,,,Counter,Coins,1
31/31/2024,T-84,10:00:00,Tea,1,1,0,1,734,1,,25,Counter,Coins,1
"""
SALES_B = """ DATE , Sale ID,Total Amount,Extra Column
18/09/2024,T-85,7.25,more
"""
LABOR = """Date,Employee ID,Name,Position,Hours Worked,Hourly Rate,Is Salaried,Shift Start,Shift End,Is Overtime,Department,Overtime Hours
17/09/2024,733,Noor Vale,Barista,6,21.5,FALSE,7:15:00,13:15:00,FALSE,Counter,1.5
17/09/2024,734,Ida,,10,10,FALSE,9:00:00,17:00:00,,,
"""
INVENTORY = """Date,Ingredient,Quantity,Par Level,Unit Cost,Is Low,Unit of Measure,Supplier,Last Ordered Date
19/09/2024,Miso,12,30,4.75,TRUE,kg,North Mill,11/09/2024
19/09/2024,Nori,5,0,1,,,,
"""
MENU = """Menu Item,Ingredient,Amount,Unit Cost,Created At,Category,Item Price,Is Active
Ramen,Miso,0.25,4.75,05/09/2024,Soup,14,TRUE
Gyoza,Leaf,2,1,05/09/2024,,0,
"""


def write(folder, **files):
    out = []
    for name, text in files.items():
        p = f"{folder}/{name}.csv"
        with open(p, "w") as f:
            f.write(text)
        out.append(p)
    return out


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="src-")


def test_sales_upload(spark, folder):
    raw = csv_files.read_category(spark, write(folder, a=SALES_A, b=SALES_B))
    got = {r["sale_id"]: r for r in silver.clean_sales(raw, F.lit("L")).collect()}
    assert set(got) == {"T-81", "T-82", "T-83", "T-84", "T-85"}
    one = got["T-81"]
    assert (one["date"], one["hour"], one["items"], one["total_amount"]) == (dt.date(2024, 9, 17), 18, ["Ramen", "Gyoza", "Tea"], Decimal("46.25"))
    assert one["discount_applied"] == Decimal("10.50") and one["is_loyalty_member"] and one["filename"] == "a.csv"
    two = got["T-82"]
    assert (two["hour"], two["items"], two["subtotal"], two["payment_method"], two["covers"]) == (None, ["Ramen", "Gyoza"], Decimal("0.00"), "Unknown", None)
    assert got["T-83"]["date"] == dt.date(2024, 9, 17) and got["T-83"]["items"] is None and got["T-83"]["hour"] == 9
    assert got["T-84"]["date"] is None
    assert got["T-85"]["total_amount"] == Decimal("7.25") and got["T-85"]["filename"] == "b.csv"


def test_other_uploads(spark, folder):
    labor_file, stock_file, menu_file = write(folder, labor=LABOR, stock=INVENTORY, menu=MENU)
    labor = {r["employee_id"]: r for r in silver.clean_labor(csv_files.read_category(spark, [labor_file]), F.lit("L")).collect()}
    assert labor["733"]["overtime_hours"] == 1.5 and labor["733"]["total_wages"] == Decimal("129.00")
    assert labor["734"]["overtime_hours"] == 2.0 and labor["734"]["is_overtime"] and labor["734"]["position"] == "Unknown"
    stock = {r["ingredient"]: r for r in silver.clean_inventory(csv_files.read_category(spark, [stock_file]), F.lit("L")).collect()}
    assert stock["Miso"]["total_value"] == Decimal("57.00") and stock["Miso"]["inventory_ratio"] == 0.4 and stock["Miso"]["alert"] == "low"
    assert stock["Nori"]["inventory_ratio"] == 0.0 and stock["Nori"]["supplier"] == "Unknown"
    menu = {r["menu_item"]: r for r in silver.clean_menu(csv_files.read_category(spark, [menu_file]), F.lit("L")).collect()}
    assert float(menu["Ramen"]["total_cost"]) == 1.1875 and menu["Ramen"]["profit_margin"] == pytest.approx((14 - 1.1875) / 14 * 100)
    assert menu["Gyoza"]["profit_margin"] == 0.0 and menu["Gyoza"]["category"] == "Unknown"


def test_header_checks(spark, folder):
    paths = write(folder, good=SALES_A, bad="Sale ID,Covers\n1,2\n", short=SALES_B)
    got = {r["filename"]: r for r in csv_files.check_headers(csv_files.headers(spark, paths), "Sales").collect()}
    assert got["good.csv"]["valid"] and got["short.csv"]["valid"] and not got["bad.csv"]["valid"]
    assert got["bad.csv"]["missing_required"] == ["date"]
    assert got["bad.csv"]["missing_one_of"] == ["total amount or subtotal or total sales or revenue"]
    assert got["short.csv"]["missing_recommended"] == ["items sold", "order type", "payment method"]
    with pytest.raises(ValueError):
        csv_files.check_headers(csv_files.headers(spark, paths), "Other")


def test_profile_and_preview(spark, folder):
    raw = csv_files.read_category(spark, write(folder, a=SALES_A, b=SALES_B))
    assert rows(csv_files.file_profile(raw), "filename", "rows") == [("a.csv", 4), ("b.csv", 1)]
    assert csv_files.preview(raw, "sale_id", 2).count() == 3


def test_insert_new_ignores_known_keys(spark, folder):
    path = f"{folder}/t"
    a = spark.createDataFrame([("L", "1", dt.date(2025, 1, 1), 5), ("L", "1", dt.date(2025, 1, 1), 6), ("M", "2", None, 7)],
                              "location_id string, sale_id string, date date, v int")
    for _ in range(2):
        sinks.insert_new(a, path, sinks.KEYS["sales"])
    assert spark.read.parquet(path).count() == 2


def test_upsert_keeps_the_newest_and_leaves_other_partitions(spark, folder):
    path = f"{folder}/t"
    schema = "location_id string, order_id string, v int, ts int"
    sinks.upsert_latest(spark.createDataFrame([("L", "1", 1, 1), ("L", "2", 2, 1), ("M", "1", 3, 1)], schema), path, ["location_id", "order_id"], ["ts"])
    untouched = sorted(os.listdir(f"{path}/location_id=M"))
    batch = spark.createDataFrame([("L", "1", 10, 2), ("L", "1", 9, 1), ("L", "2", 0, 0), ("L", "3", 4, 1)], schema)
    for _ in range(2):
        sinks.upsert_latest(batch, path, ["location_id", "order_id"], ["ts"])
    assert rows(spark.read.parquet(path), "location_id", "order_id", "v") == [("L", "1", 10), ("L", "2", 2), ("L", "3", 4), ("M", "1", 3)]
    assert sorted(os.listdir(f"{path}/location_id=M")) == untouched


def test_replace_append_delete_and_documents(spark, folder):
    path = f"{folder}/t"
    schema = "location_id string, item string, date date"
    d = dt.date(2025, 3, 1)
    sinks.replace_partitions(spark.createDataFrame([("L", "a", d), ("M", "b", d)], schema), path)
    sinks.replace_partitions(spark.createDataFrame([("L", "c", d)], schema), path)
    assert rows(spark.read.parquet(path), "location_id", "item") == [("L", "c"), ("M", "b")]
    old = spark.createDataFrame([("L", "old", d - dt.timedelta(days=40)), ("N", "older", d - dt.timedelta(days=50))], schema)
    old.write.mode("append").partitionBy("location_id").parquet(path)
    assert tables.kept(spark.read.parquet(path), d).count() == 2
    sinks.delete_older(spark, path, F.col("date") >= F.lit(d - dt.timedelta(days=30)))
    assert rows(spark.read.parquet(path), "location_id", "item") == [("L", "c"), ("M", "b")]
    log = f"{folder}/log"
    for name in ("x.csv", "y.csv"):
        sinks.append_tagged(spark.createDataFrame([("L", "a", d)], schema), log, name)
    assert rows(spark.read.parquet(log), "filename") == [("x.csv",), ("y.csv",)]
    gone = spark.createDataFrame([("x.csv",)], "filename string")
    assert tables.without_keys(spark.read.parquet(log), gone, ["filename"]).count() == 1
    docs = f"{folder}/docs"
    sinks.write_documents(spark.createDataFrame([("L", "total_sales", 5.0)], "location_id string, kpi string, value double"), docs)
    assert spark.read.json(docs).first()["kpi"] == "total_sales"
    assert '"item":"a"' in sinks.with_data_copy(spark.createDataFrame([("L", "a", d)], schema)).first()["data"]


def test_scan_pushes_filters_and_columns(spark, folder):
    path = f"{folder}/t"
    spark.createDataFrame([("L", 1, dt.date(2025, 1, 1), "x")], "location_id string, v int, date date, big string").write.parquet(path)
    plan = tables.scan(spark, path, ["v"], ["L"], dt.date(2025, 1, 1), dt.date(2025, 1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "big" not in plan and "GreaterThanOrEqual(date" in plan


def test_payload_shapes(spark, folder):
    order = '{"id": "1", "order_ts": "2025-03-01 09:00:00", "total": 10.5, "items": [{"menu_item_name": "A", "quantity": 2, "amount": 8, "food_cost": 3}]}'
    for name, text in {"orders_2025-03-01": '{"result": [%s, %s]}' % (order, order.replace('"1"', '"2"')), "orders_2025-03-02": "[%s]" % order,
                       "orders_2025-03-03": order}.items():
        with open(f"{folder}/{name}.json", "w") as f:
            f.write(text)
    got = pos_json.orders(pos_json.read_payloads(spark, folder), F.lit("L"), F.lit("2025-03-04").cast("timestamp"))
    assert rows(got, "order_id", F.col("order_date").cast("string")) == [
        ("1", "2025-03-01"), ("1", "2025-03-02"), ("1", "2025-03-03"), ("2", "2025-03-01")]
    assert pos.history_items(got).first()["quantity"] == 8
    menu = spark.createDataFrame([('{"result": [{"id": "7", "name": "Pie", "price": 3}]}',)], "payload string").withColumn("path", F.lit(""))
    one = pos_json.menu(menu, F.lit("L")).first()
    assert one["name"] == "Pie" and one["price"] == Decimal("3.00") and one["cost"] == Decimal("0.00")


def test_cleaned_tables_have_the_canonical_schemas(spark, folder):
    from brigade import schemas

    paths = dict(zip(("sales", "labor", "stock", "menu"), write(folder, sales=SALES_A, labor=LABOR, stock=INVENTORY, menu=MENU)))
    made = {
        schemas.SALES: silver.clean_sales(csv_files.read_category(spark, [paths["sales"]]), F.lit("L")),
        schemas.LABOR: silver.clean_labor(csv_files.read_category(spark, [paths["labor"]]), F.lit("L")),
        schemas.INVENTORY: silver.clean_inventory(csv_files.read_category(spark, [paths["stock"]]), F.lit("L")),
        schemas.MENU: silver.clean_menu(csv_files.read_category(spark, [paths["menu"]]), F.lit("L")),
    }
    for ddl, df in made.items():
        want = spark.createDataFrame([], ddl).schema
        assert [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in want.fields]


def test_quoted_commas_and_line_breaks(spark, folder):
    text = 'Date,"Total, all",Sale ID\n2024-09-17,5,"T\n91"\n2024-09-18,6,T-92\n'
    raw = csv_files.read_category(spark, write(folder, a=text))
    assert raw.columns == ["date", "total,_all", "sale_id", "filename"]
    assert rows(raw, "sale_id", "`total,_all`") == [("T\n91", "5"), ("T-92", "6")]


def test_bad_payloads_are_rejected(spark):
    texts = ["oops", '{"result": null}', '{"error": "x"}', "[null]", '{"result": [{"id": "1", "total": 2}, null]}']
    df = spark.createDataFrame([(t, "") for t in texts], "payload string, path string")
    got = pos_json.orders(df, F.lit("L"), F.lit("2024-09-18").cast("timestamp"))
    assert rows(got, "order_id", F.col("total").cast("double")) == [("1", 2.0)]
    assert rows(pos_json.rejects(df), "payload") == sorted((t,) for t in texts[:4])


def test_first_row_of_a_key_wins(spark):
    df = spark.range(200).select((F.col("id") * 0).alias("k"), F.col("id").alias("ingest_seq"), (F.col("id") % 7).alias("v"))
    for n in (1, 3, 16):
        assert rows(sinks.first_of_key(df.repartition(n), ["k"])) == [(0, 0, 0)]


def test_sinks_keep_null_padded_and_escaped_partitions(spark, folder):
    path, schema = f"{folder}/t", "location_id string, order_id string, v int, date date"
    d, old = dt.date(2025, 3, 1), dt.date(2024, 1, 1)
    places = [None, "01", "1", "a:b", "x y"]
    first = spark.createDataFrame([(p, "a", 1, d) for p in places] + [("01", "z", 1, old), ("a:b", "z", 1, old)], schema)
    sinks.upsert_latest(first, path, ["location_id", "order_id"], ["v"])
    sinks.upsert_latest(spark.createDataFrame([(p, "c", 2, d) for p in places], schema), path, ["location_id", "order_id"], ["v"])
    read = lambda: rows(spark.read.schema(schema).parquet(path), "location_id", "order_id")
    whole = [(p, o) for p in places for o in "ac"] + [("01", "z"), ("a:b", "z")]
    by_text = lambda r: tuple(map(str, r))
    assert read() == sorted(whole, key=by_text)
    sinks.delete_older(spark, path, F.col("date") >= F.lit(d))
    assert read() == sorted(whole[:10], key=by_text)
    sinks.delete_keys(spark, path, spark.createDataFrame([(None, "a"), ("01", "c")], "location_id string, order_id string"), ["location_id", "order_id"], schema=first.schema)
    assert read() == sorted([x for x in whole[:10] if x not in [(None, "a"), ("01", "c")]], key=by_text)
    sinks.delete_older(spark, path, F.col("location_id") != "1")
    assert [r for r in read() if r[0] == "1"] == [] and len(read()) == 6


def test_dates_of_the_last_century_and_free_forms(spark):
    from brigade.functions import clean

    df = spark.createDataFrame([("03/15/95",), ("12/31/69",), ("12/31/68",), ("oops",)], "t string")
    assert [str(r[0]) for r in df.select(clean.parse_date("t", clean.SHORT_DATE_FORMS)).collect()] == ["1995-03-15", "1969-12-31", "2068-12-31", "None"]
    free = spark.createDataFrame([("March 5, 2024",), ("2024/03/05",), ("03-05-2024",), ("5 Mar 2024",), ("25-03-2024",)], "t string")
    assert [str(r[0]) for r in free.select(clean.parse_date("t")).collect()] == ["2024-03-05"] * 4 + ["2024-03-25"]


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


@pytest.mark.parametrize("known", [False, True])
def test_deletes_touch_only_their_partitions(spark, folder, known):
    path, schema = f"{folder}/t", "location_id string, order_id string, v int, date date"
    d, old = dt.date(2025, 3, 1), dt.date(2024, 1, 1)
    places = [None, "01", "1", "a:b", "x y", "100%"]
    data = [(p, o, 1, d) for p in places for o in "ab"] + [("gone", "a", 1, old), ("gone 2", "a", 1, old), ("02", "a", 1, old), ("02", "b", 1, d)]
    spark.createDataFrame(data, schema).repartition(1).write.partitionBy("location_id").parquet(path)
    given = spark.createDataFrame([], schema).schema if known else None
    read = lambda: rows(spark.read.schema(schema).parquet(path), "location_id", "order_id")
    by_text = lambda r: tuple(map(str, r))
    before = files_of(path)
    sinks.delete_older(spark, path, F.col("date") >= F.lit(d), schema=given)
    want = {(p, o) for p, o, _, day in data if day == d}
    assert read() == sorted(want, key=by_text)
    # the emptied partitions are gone, one is written anew, every other file is the same
    assert {f for f in files_of(path) if "=02" not in f} == {f for f in before if "=02" not in f and "=gone" not in f}
    assert not [x for x in os.listdir(path) if x.startswith("location_id=gone")]
    before = files_of(path)
    marks = [("01", "a"), (None, "b"), ("a:b", "a"), ("a:b", "b"), ("100%", "a"), ("none", "a"), ("x y", "c")]
    for _ in range(2):  # a second run finds nothing to do
        sinks.delete_keys(spark, path, spark.createDataFrame(marks, "location_id string, order_id string"), ["location_id", "order_id"], schema=given)
        assert read() == sorted(want - set(marks), key=by_text)
    changed = {f.split("location_id=")[1].split("/")[0] for f in before ^ files_of(path)}
    assert changed == {"01", "__HIVE_DEFAULT_PARTITION__", "a%3Ab", "100%25"}
    sinks.delete_keys(spark, path, spark.createDataFrame([(1,)], "location_id int"), ["location_id"], schema=given)
    assert not [r for r in read() if r[0] == "1"] and [r for r in read() if r[0] == "01"]


def test_delete_by_a_key_beside_the_partition(spark, folder):
    path = f"{folder}/t"
    spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z"), (3, "c", "w")], "location_id int, k string, v string").write.partitionBy("location_id").parquet(path)
    before = files_of(path)
    sinks.delete_keys(spark, path, spark.createDataFrame([("a",)], "k string"), ["k"])
    assert rows(spark.read.parquet(path), "location_id", "k", "v") == [(1, "b", "y"), (3, "c", "w")]
    assert {f for f in before if "=3/" in f} <= files_of(path) and "location_id=2" not in os.listdir(path)
    sinks.delete_keys(spark, f"{folder}/none", spark.createDataFrame([("a",)], "k string"), ["k"])


def test_scratch_removes_settled_tables(spark):
    from brigade.operators import spread

    with spread.scratch(spark):
        kept = spread.settle(spark.range(3))
        with spread.scratch(spark):
            inner = spread.settle(spark.range(3)).inputFiles()
        there = kept.inputFiles()
        assert not [f for f in inner if os.path.exists(f.removeprefix("file://"))] and os.path.exists(there[0].removeprefix("file://"))
    assert not os.path.exists(os.path.dirname(there[0].removeprefix("file://")))


def csv_text(seed, rows_=300, newline="\n"):
    """Records with line breaks, commas and quotes at every place of quoted fields, and quotes inside plain ones."""
    import random

    rnd = random.Random(seed)
    pieces = ["a", "b c", ",", newline, '""', "x,y", newline * 2, "'", "é"]
    out = ["id,one,two,three"]
    for i in range(rows_):
        cells = [str(i)]
        for _ in range(3):
            kind = rnd.random()
            cells.append("" if kind < 0.1 else '5" pipe' if kind < 0.2 else rnd.choice(["plain", "w z", "'"]) if kind < 0.5 else
                         '"' + "".join(rnd.choices(pieces, k=rnd.randrange(0, 6))) + '"')
        out.append(",".join(cells))
    return newline.join(out) + newline


@pytest.mark.parametrize("size", [64, 257, 1000, 1 << 20])
def test_records_over_splits_equal_a_read_of_whole_files(spark, folder, size):
    paths = write(folder, a=csv_text(1), b=csv_text(2, 40), c="id,one,two,three\n1,2,3,4\n", d='id,one,two,three\n\n"1\n",2,"3\n\n",4')
    header = ["id", "one", "two", "three"]
    want = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema("id string, one string, two string, three string").csv(paths)
    old = [(k, spark.conf.get(k)) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        scanned = csv_files.csv_records.lines(spark, paths[:1]).rdd.getNumPartitions()
        got = csv_files.read_upload(spark, paths, header).drop("filename")
        assert rows(got) == rows(want)
        both = csv_files.read_category(spark, paths)
        assert rows(both.drop("filename")) == rows(want)
        assert rows(both.groupBy("filename").count()) == [("a.csv", 300), ("b.csv", 40), ("c.csv", 1), ("d.csv", 1)]
    finally:
        for k, v in old:
            spark.conf.set(k, v)
    assert scanned >= 4 or size > 4000  # one file is read by many tasks
    assert sorted(os.path.basename(p) for p in csv_files.csv_records.with_breaks(spark, paths)) == ["a.csv", "b.csv", "d.csv"]


def test_a_quote_that_never_closes_ends_on_its_line(spark, folder):
    (path,) = write(folder, a='id,one\n1,"x\ny"\n2,"open\n3,z\n4,w\n')
    got = csv_files.read_upload(spark, path, ["id", "one"])
    assert [r[0] for r in rows(got, "id")] == ["1", "2", "3", "4"] and rows(got.where("id = '3'"), "one") == [("z",)]
