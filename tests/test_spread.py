"""Joins, ranks and lists on skewed keys against brute force."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from brigade.operators import spread
from tests.conftest import rows


def skewed(spark, n=3000, seed=1):
    r = random.Random(seed)
    data = [("hot" if r.random() < 0.4 else f"k{r.randint(0, 40)}", i, r.randint(0, 50)) for i in range(n)]
    data += [(None, n + i, 1) for i in range(20)]
    return spark.createDataFrame(data, "k string, id long, v long")


def test_attach_gives_the_same_rows_broadcast_or_fanned_out(spark):
    fact = skewed(spark)
    stats = fact.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    want = rows(fact.join(stats, ["k"], "left"))
    for how in ("left", "inner"):
        want = rows(fact.join(stats, ["k"], how))
        assert rows(spread.attach(fact, stats, ["k"], how, weight="n")) == want
        fanned = spread.attach(fact, stats, ["k"], how, weight="n", broadcast_bytes=0, hot_rows=50)
        assert rows(fanned) == want
        assert rows(spread.attach(fact, stats, ["k"], how, broadcast_bytes=0)) == want


def test_attach_spreads_the_hot_key(spark):
    fact = skewed(spark)
    stats = fact.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    fanned = spread.attach(fact, stats, ["k"], "inner", weight="n", broadcast_bytes=0, hot_rows=100)
    plan = fanned._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan


def test_one_to_many_attach(spark):
    fact = skewed(spark)
    many = spark.createDataFrame([("hot", 1, 900), ("hot", 2, 900), ("k1", 3, 5)], "k string, tag int, n long")
    want = rows(fact.join(many, ["k"], "inner"))
    assert rows(spread.attach(fact, many, ["k"], "inner", weight="n", broadcast_bytes=0, hot_rows=100)) == want


def test_running_equals_window(spark):
    fact = skewed(spark)
    order = [F.col("v").desc(), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    want = rows(
        fact.withColumn("rank", F.row_number().over(w).cast("long")).withColumn(
            "sum_v", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    for slices in (1, 3, 16):
        got = spread.running(fact, ["k"], order, totals={"sum_v": F.col("v")}, slices=slices)
        assert rows(got) == want


def test_paged_list_keeps_every_value(spark):
    df = spark.createDataFrame([("a", f"v{i:03d}") for i in range(25)] + [("b", "x")], "g string, v string")
    got = {(r["g"], r["page"]): r["vs"] for r in spread.paged_list(df, ["g"], "v", "vs", page_rows=10).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("b", 0)}
    assert ", ".join(got["a", p] for p in range(3)) == ", ".join(f"v{i:03d}" for i in range(25))
    assert got["b", 0] == "x"


def test_top_within_limits_before_the_shuffle(spark):
    df = spread.top_within(skewed(spark), ["k"], [F.col("v").desc(), F.col("id")], 3)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    assert df.where("k = 'hot'").count() == 3


def test_pairs_of_location_and_part_are_found_by_tasks_of_few_lines(spark, monkeypatch):
    """The number of tasks goes with the lines, also where their bytes would fit into one."""
    import tempfile

    from brigade.plans import views

    base, dealt = tempfile.mkdtemp(prefix="menu-"), []
    for name, rows_of in {
        "lineitem": "SELECT id % 100 AS l_orderkey, id % 7 AS l_partkey FROM range(1000)", "orders": "SELECT id AS o_orderkey, id % 9 AS o_custkey FROM range(100)",
        "customer": "SELECT id AS c_custkey, CAST(id % 3 AS INT) AS c_nationkey FROM range(9)",
        "part": "SELECT id AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 't' AS p_type, CAST(id AS INT) AS p_size, 1.0D AS p_retailprice FROM range(7)",
    }.items():
        spark.sql(rows_of).write.parquet(f"{base}/{name}.parquet")
    frame = type(spark.range(1))
    plain = frame.repartition
    monkeypatch.setattr(views, "TASK_LINES", 50)
    monkeypatch.setattr(frame, "repartition", lambda df, n, *c: dealt.append((n, c)) or plain(df, n, *c))
    assert views.Tables(spark, base).menu.count() == 21
    assert (21, ("o_orderkey",)) in dealt


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_side_beyond_its_bound_is_not_broadcast(spark):
    """Its file is small, so Spark alone would broadcast it."""
    import tempfile

    path = tempfile.mkdtemp(prefix="side-") + "/side"
    spark.range(2000).selectExpr("id % 50 AS k", "repeat('x', 500) AS t").write.parquet(path)
    side = spark.read.parquet(path)
    fact = spark.range(300).selectExpr("IF(id % 7 = 0, NULL, id % 60) AS k", "id AS v")
    for how in ("inner", "left"):
        want = rows(fact.join(side, ["k"], how))
        near, far = spread.beside(fact, side, ["k"], how), spread.beside(fact, side, ["k"], how, broadcast_bytes=1 << 20)
        assert rows(near) == rows(far) == want
        assert "BroadcastHashJoin" in plan_of(near) and "BroadcastHashJoin" not in plan_of(far)
    assert rows(spread.beside(fact, side.limit(0), ["k"])) == []
    for weight in (None, "n"):
        far = spread.attach(fact, side.withColumn("n", F.lit(1)), ["k"], "left", weight=weight, broadcast_bytes=1 << 20)
        assert rows(far.drop("n")) == want
        # with a weight the few hot keys are broadcast, and nothing else
        assert plan_of(far).count("BroadcastHashJoin") == (1 if weight else 0)


def test_sales_and_menu_broadcast_no_large_part_customer_or_order_table(spark, monkeypatch):
    import tempfile

    from brigade.plans import views

    base, plans = tempfile.mkdtemp(prefix="sides-"), []
    for name, rows_of in {
        "lineitem": """SELECT id % 101 AS l_orderkey, id % 8 AS l_partkey, id % 5 AS l_suppkey, 0.01D * (id % 9) AS l_discount,
                       CAST(id AS DOUBLE) AS l_extendedprice FROM range(1000)""",
        "orders": """SELECT IF(id = 3, NULL, id) AS o_orderkey, IF(id = 4, NULL, id % 10) AS o_custkey, 'P' AS o_orderstatus, 10.0D * id AS o_totalprice,
                     DATE'2000-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(100)""",
        "customer": "SELECT id % 8 AS c_custkey, 'n' AS c_name, CAST(id % 3 AS INT) AS c_nationkey, 'BUILDING' AS c_mktsegment FROM range(9)",
        "part": """SELECT IF(id = 6, NULL, id % 5) AS p_partkey, 'n' || id AS p_name, 'b' AS p_brand, 't' AS p_type, CAST(id AS INT) AS p_size,
                   1.0D AS p_retailprice FROM range(7)""",
    }.items():
        spark.sql(rows_of).write.parquet(f"{base}/{name}.parquet")
    plain = views.settle
    monkeypatch.setattr(views, "settle", lambda df, name: plans.append(plan_of(df)) or plain(df, name))
    found = []
    for most in (1 << 20, 0):
        monkeypatch.setattr(spread, "SIDE_BYTES", most)
        t = views.Tables(spark, base)
        found.append((rows(t.sales), rows(t.menu)))
    assert found[0] == found[1] and all(found[0])
    for plan in plans[2:]:
        assert not any(f"BroadcastHashJoin [{key}#" in plan for key in ("l_partkey", "p_partkey", "o_custkey", "c_custkey", "o_orderkey"))


def test_a_large_surplus_is_not_broadcast(spark, monkeypatch):
    import tempfile

    from brigade.operators import promotions

    path = tempfile.mkdtemp(prefix="stock-") + "/stock"
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a")], "location_id int, menu_item string")
    menu = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "a", "y"), (1, "b", "z"), (2, "a", "x"), (None, "a", "x"), (1, "a", None)],
                                 "location_id int, menu_item string, ingredient string")
    stock = spark.createDataFrame([(1, "x", 2000.0), (1, "x", 1800.0), (1, "y", 1500.0), (1, "z", 1.0), (2, "y", 3000.0), (None, "x", 9000.0), (1, None, 9000.0)],
                                  "location_id int, ingredient string, quantity double")
    stock.write.parquet(path)
    stock = spark.read.parquet(path)
    want = [(1, "a", "x, y", "surplus_reduction"), (1, "b", "", "premium"), (2, "a", "", "popular"), (None, "a", "", "popular")]
    for most in (spread.BROADCAST_BYTES, 0):
        monkeypatch.setattr(spread, "BROADCAST_BYTES", most)
        got = promotions.smart_targets(items, items, items.where("menu_item = 'b'"), stock, menu)
        told = got.select("location_id", "menu_item", F.array_join("surplus_ingredients", ", "), "category")
        assert rows(told) == sorted(want, key=lambda r: tuple(map(str, r)))
        if not most:
            assert "ingredient" not in "".join(x for x in plan_of(got).splitlines() if "BroadcastHashJoin" in x)
