"""Hand-computed results on small tables that hold the boundary cases."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brigade.functions import clean, items, numbers, periods
from brigade.operators import (
    anomaly, causes, customers, dashboard, efficiency, kpi, notices, pos, promotions, risk, silver, usage, vectors,
)
from brigade.plans import bundles
from tests.conftest import rows

D = dt.date(2025, 10, 25)
SALE = ("location_id string, sale_id string, date date, hour int, items_sold string, number_of_items int, subtotal decimal(18,2), "
        "tip decimal(18,2), total_amount decimal(18,2), payment_method string, order_type string, employee_id string, "
        "discount_percent double, comps decimal(18,2), voids decimal(18,2), promos decimal(18,2), covers int")


def sale(i, items_sold="Pizza", total="10.00", subtotal="9.00", hour=12, method="Cash", employee="e1", pct=0.0, comps="0", voids="0",
         promos="0", covers=1, loc="L", date=D, kind="Dine-In", n=1):
    d = Decimal
    return (loc, i, date, hour, items_sold, n, d(subtotal), d("1"), d(total), method, kind, employee, pct, d(comps), d(voids), d(promos), covers)


def sales_of(spark, data):
    return spark.createDataFrame(data, SALE).withColumn("items", items.parse_items("items_sold"))


MENU = "location_id string, menu_item string, ingredient string, amount double, unit_cost decimal(18,2), category string, item_price decimal(18,2), created_at date, ingest_seq long"


def menu_of(spark):
    d = Decimal
    return spark.createDataFrame(
        [
            ("L", "Pizza", "Flour", 0.5, d("2.00"), "Entree", d("18"), D, 1),
            ("L", "Pizza", "Flour", 0.5, d("4.00"), "Entree", d("18"), D + dt.timedelta(days=1), 2),  # repeated line, other cost
            ("L", "Pizza", "beer", 1.0, d("1.00"), "Entree", d("18"), D, 3),
            ("L", "Salad", "steak", 1.0, d("3.00"), "Starter", d("0"), D, 4),
            ("L", "Soup", "watermelon", 1.0, d("2.00"), "Starter", d("5"), D, 5),  # never sold
        ],
        MENU,
    )


def test_item_lists(spark):
    raw = [None, "", '["Pizza","Salad"]', "[broken", "A; ;B", " A ;A", "[]", '["x", null]']
    got = [r["p"] for r in spark.createDataFrame([(x,) for x in raw], "s string").select(items.parse_items("s").alias("p")).collect()]
    assert got[0] is None and got[1] is None
    assert got[2] == ["Pizza", "Salad"]
    assert got[3] == ["[broken"]
    assert got[4] == ["A", "B"]
    assert got[5] == ["A", "A"]


def test_item_shares_and_profit(spark):
    sales = sales_of(spark, [
        sale("1", "Pizza;Salad;Pizza", "30.00"), sale("2", None, "99.00"), sale("3", '["Pizza","Tea"]', "0.00", "8.00"),
        sale("4", "", "5.00"),
    ])
    base = {r["menu_item"]: (r["units"], r["revenue"]) for r in items.item_base(sales).collect()}
    assert base == {"Pizza": (3, Decimal("24.000000")), "Salad": (1, Decimal("10.000000")), "Tea": (1, Decimal("4.000000"))}
    got = {r["menu_item"]: tuple(map(float, (r["cost"], r["gross_profit"], r["margin_pct"]))) for r in
           kpi.gross_profit_per_item(sales, menu_of(spark)).collect()}
    # Pizza unit cost: 0.5*2 + 0.5*4 + 1*1 = 4, repeated lines add up
    assert got == {"Pizza": (12.0, 12.0, 50.0), "Salad": (3.0, 7.0, 70.0), "Tea": (0.0, 4.0, 100.0)}
    pct = kpi.food_cost_pct(sales, menu_of(spark)).first()
    assert float(pct["food_cost_pct"]) == pytest.approx(15 / 38 * 100) and pct["valid"]


def test_cogs_uses_the_last_line_and_substrings(spark):
    sales = sales_of(spark, [sale("1", "Pizza;Salad;Pizza")])
    cost = {r["ingredient"]: float(r["cost"]) for r in kpi.ingredient_cost(sales, menu_of(spark)).collect()}
    assert cost == {"Flour": 4.0, "beer": 2.0, "steak": 3.0}  # last flour line: 0.5*4, two pizzas
    cogs = {r["category"]: float(r["cogs"]) for r in kpi.cogs_by_category(sales, menu_of(spark)).collect()}
    assert cogs == {"Food": 4.0, "Alcohol": 2.0, "Beverages": 3.0}  # s-tea-k
    whole = {r["category"]: float(r["cogs"]) for r in kpi.cogs_by_category(sales, menu_of(spark), word_boundary=True).collect()}
    assert whole == {"Food": 7.0, "Alcohol": 2.0}


def test_net_revenue_takes_a_discount_once(spark):
    sales = sales_of(spark, [sale("1", subtotal="100.00", pct=10.0, comps="1", voids="2", promos="10")])
    assert float(kpi.net_revenue(sales).first()["net_revenue"]) == 100 - 1 - 10 - 2 - 10
    assert float(kpi.net_revenue(sales, "promos").first()["net_revenue"]) == 100 - 1 - 10 - 2
    bare = sales.select("location_id", "total_amount")
    assert float(kpi.net_revenue(bare).first()["net_revenue"]) == 10.0


def test_guests_and_check(spark):
    sales = sales_of(spark, [sale("1", covers=3), sale("2", covers=None)])
    assert kpi.guest_count(sales).first()["guest_count"] == 3
    assert kpi.guest_count(sales.drop("covers")).first()["guest_count"] == 2
    assert kpi.average_check(sales).first()["average_check"] == 6.0


def test_quadrants_with_ties_at_the_median(spark):
    data = [(f"i{n}", u, p) for n, (u, p) in enumerate([(10, "5"), (10, "1"), (2, "5"), (2, "1"), (6, "3")])]
    df = spark.createDataFrame(
        [("L", i, u, Decimal("9"), Decimal("1"), Decimal(p), 1.0) for i, u, p in data],
        "location_id string, menu_item string, units long, revenue decimal(28,2), cost decimal(28,2), gross_profit decimal(28,2), margin_pct double")
    got = {r["menu_item"]: (r["quadrant"], r["profitability_rank"], r["popularity_rank"]) for r in kpi.quadrants_of(df).collect()}
    assert got == {"i0": ("STAR", 1, 1), "i1": ("PLOW HORSE", 4, 2), "i2": ("PUZZLE", 2, 4), "i3": ("DOG", 5, 5), "i4": ("STAR", 3, 3)}
    even = kpi.quadrants_of(df.where("menu_item != 'i4'")).first()
    assert even["median_units"] == 6.0 and even["median_profit"] == 3.0
    counts = kpi.quadrant_counts(kpi.quadrants_of(df)).first()
    assert counts["total_items"] == 5 and counts["star"] == 2


def test_labor_figures(spark):
    labor = spark.createDataFrame(
        [("L", "Cook", 8.0, 0.0, False), ("L", "Cook", 10.0, 12.0, False), ("L", "Manager", 9.0, 1.0, True), ("L", None, 3.0, 0.0, False)],
        "location_id string, position string, hours_worked double, overtime_hours double, is_salaried boolean")
    assert rows(kpi.labor_hours_by_role(labor), "position", "hours") == sorted([("Cook", 18.0), ("Manager", 9.0), (None, 27.0)], key=lambda r: tuple(map(str, r)))
    pct = {r["position"]: (r["overtime_pct"], r["warning"]) for r in kpi.overtime_pct(labor).collect()}
    assert pct["Cook"] == (pytest.approx(12 / 18 * 100), "overtime share is high") and set(pct) == {"Cook", None}


STOCK = "location_id string, date date, ingredient string, quantity double, par_level double, unit_cost decimal(18,2)"


def test_inventory_bands_and_warnings(spark):
    ratios = [39.0, 40.0, 59.0, 60.0, 75.0, 100.0, 130.0, 131.0]
    stock = spark.createDataFrame(
        [("L", D, f"r{int(q)}", q, 100.0, Decimal("1")) for q in ratios] + [("L", D, "nopar", 5.0, 0.0, Decimal("1"))], STOCK)
    band = {r["ingredient"]: r["band"] for r in silver.alert_band(stock).collect()}
    assert band == {"r39": "CRITICAL LOW", "r40": "LOW", "r59": "LOW", "r60": "NORMAL", "r75": "NORMAL", "r100": "NORMAL",
                    "r130": "NORMAL", "r131": "HIGH", "nopar": "NORMAL"}
    low = {r["ingredient"] for r in kpi.low_inventory(stock).collect()}
    assert "r100" in low and "r130" not in low
    cause = {r["ingredient"] for r in causes.inventory_causes(sales_of(spark, [sale("1")]), stock).collect()}
    assert cause == {"r39", "r40", "r59", "r60"}  # below 0.75, a zero par level gives no ratio


def test_waste_only_where_less_was_used(spark):
    sales = sales_of(spark, [sale("1", "Pizza;Pizza;Salad")])
    stock = spark.createDataFrame(
        [("L", D, "Flour", 2.0, 1.0, Decimal("1")), ("L", D, "steak", 1.5, 1.0, Decimal("1")), ("L", D, "salt", 4.0, 1.0, Decimal("1"))], STOCK)
    # two pizzas use 2 x (0.5 + 0.5) flour = all of it, one salad uses 1 steak, nothing uses salt
    assert rows(dashboard.inventory_waste(sales, menu_of(spark), stock), "ingredient", "used", "waste") == [("salt", 0.0, 4.0), ("steak", 1.0, 0.5)]


def test_surplus_boundaries(spark):
    stock = spark.createDataFrame([("L", D, f"q{q}", float(q), 1.0, Decimal("1")) for q in (499, 500, 999, 1000, 1499, 1500, 1999, 2000)], STOCK)
    got = rows(promotions.surplus_stock(stock), "ingredient", "segment", "potential_waste")
    assert got == [("q1000", "moderate_surplus", 500.0), ("q1499", "moderate_surplus", 999.0), ("q1500", "high_surplus", 1000.0),
                   ("q1999", "high_surplus", 1499.0), ("q2000", "critical_surplus", 1500.0)]


def test_dayparts(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("h")).select("h", promotions.daypart("h").alias("p"))
    got = [r["p"] for r in df.orderBy("h").collect()]
    assert got == ["late_night"] * 6 + ["breakfast"] * 5 + ["lunch"] * 4 + ["afternoon"] * 2 + ["dinner"] * 6 + ["late_night"]


def test_sales_dips(spark):
    days = [("L", D + dt.timedelta(days=i), Decimal(v)) for i, v in enumerate(["140", "60", "70", "80", "81", "169"])]
    df = spark.createDataFrame(days, "location_id string, date date, total_amount decimal(18,2)")  # mean 100
    assert rows(promotions.sales_dips(df), "total_amount", "severity", "recoverable") == [
        (Decimal("60.00"), "Critical", 40.0), (Decimal("70.00"), "High", 30.0), (Decimal("80.00"), "Moderate", 20.0)]


def test_dip_suggestions(spark):
    days = [("L", dt.date(2024, 3, i + 1), Decimal(v)) for i, v in enumerate(["150", "59.5", "70", "79.75", "82", "169"])]
    days += [("M", None, Decimal("10")), ("M", D, Decimal("190")), ("N", D, None), ("O", D, Decimal("0"))]
    df = spark.createDataFrame(days, "location_id string, date date, total_amount decimal(18,2)")  # means: 101.71, 100, none, 0
    got = {(r["location_id"], r["date"]): r for r in promotions.dip_suggestions(df).collect()}
    assert {k: r["severity"] for k, r in got.items()} == {
        ("L", dt.date(2024, 3, 2)): "Critical", ("L", dt.date(2024, 3, 3)): "High", ("L", dt.date(2024, 3, 4)): "Moderate", ("M", None): "Critical"}
    r = got["L", dt.date(2024, 3, 2)]
    assert r["item"] == "All menu items (Low sales on 2024-03-02)"
    assert r["reason"] == "🚨 Sales on 2024-03-02 dropped by 41.5% compared to daily average of $101.71"
    assert (r["urgency_level"], r["recommended_duration"], r["implementation_priority"]) == ("Immediate action required", "24 hours", "Critical")
    assert r["estimated_impact"] == "Potential to recover $42.21 in lost revenue"
    texts = {
        "Flash Sale Boost": "Limited time {0} off on all menu items.\nValid only for {1}, drive immediate sales boost.",
        "Combo Value Deal": "Buy any main course, get appetizer {0} off.\nPerfect for increasing average order value.",
        "Happy Hour Extension": "Extended happy hour with {0} off.\nBoost traffic during traditionally slow periods."}
    for (place, day), r in got.items():
        if day:
            assert r["offer_details"] == texts[r["suggested_offer"]].format({"Critical": "40%", "High": "30%", "Moderate": "20%"}[r["severity"]], day)
    r = got["M", None]
    assert r["estimated_impact"] == "Potential to recover $90.0 in lost revenue" and r["urgency_level"] == "Immediate action required"
    assert [r[c] for c in ("item", "reason", "suggested_offer", "offer_details")] == [None] * 4
    assert promotions.dip_suggestions(df.limit(0)).count() == 0


def anomaly_sales(spark):
    data = [sale(f"n{i}", total="10.00", hour=12 + i % 3, employee="e1") for i in range(40)]
    data += [sale("big", total="1000.00", hour=13, employee="e2"), sale("night", total="10.00", hour=2, employee="e2"),
             sale("nohour", total="10.00", hour=None, employee="e2"), sale("gift", method="Gift Card", employee="e2"),
             sale("d20", pct=20.0, employee="e3"), sale("d21", pct=21.0, employee="e3"), sale("d51", pct=51.0, employee="e3")]
    data += [sale(f"o{i}", loc="M", total="7.00", employee="x", hour=None) for i in range(3)]
    return sales_of(spark, data)


def test_anomaly_kinds(spark):
    s = anomaly_sales(spark)
    found = anomaly.all_anomalies(s, high_value_threshold=5.0)

    def ids(category, pattern=None):
        df = found.where(F.col("category") == category)
        if pattern:
            df = df.where(F.col("pattern") == pattern)
        return sorted(r["sale_id"] for r in df.collect())

    assert ids("high_value_transactions") == ["big"]
    assert ids("unusual_time_transactions") == ["night", "nohour"]  # location M has no hours at all: no flag
    assert ids("payment_method_anomalies") == ["gift"]
    assert ids("discount_anomalies") == ["d21", "d51"]
    assert len(ids("employee_pattern_anomalies", anomaly.REPEATED)) == 40
    assert {r["severity"] for r in found.where("sale_id = 'd51'").collect()} == {"medium"}
    assert not ids("employee_pattern_anomalies", anomaly.OUTLIER)  # e1 has no spread, e2 too few sales


def test_employee_outliers_need_eight_sales(spark):
    def of(n):
        return sales_of(spark, [sale(f"s{i}", total="10.00", employee="e") for i in range(n - 1)] + [sale("x", total="500.00", employee="e")])

    assert anomaly.employee_outliers(of(7)).count() == 0
    assert rows(anomaly.employee_outliers(of(8)), "sale_id") == [("x",)]


def test_shares_leave_nulls_out(spark):
    data = [sale(f"c{i}") for i in range(77)] + [sale(f"a{i}", method="A") for i in range(4)]
    data += [sale(f"b{i}", method="B") for i in range(7)] + [sale(f"d{i}", method="D") for i in range(12)] + [sale("z", method=None)]
    s = sales_of(spark, data)
    assert {r["payment_method"]: r["method_share"] for r in anomaly.method_shares(s).collect()} == {"Cash": 0.77, "A": 0.04, "B": 0.07, "D": 0.12}
    assert anomaly.unusual_payment(s).count() == 11
    rare = risk.risk_transactions(s).where(F.array_contains("risk_factors", "rare_payment"))
    assert rare.count() == 4


def test_risk_score_is_the_number_of_factors(spark):
    got = risk.risk_transactions(anomaly_sales(spark))
    assert got.where(F.size("risk_factors") != F.col("risk_score")).count() == 0
    by = {r["sale_id"]: r["risk_factors"] for r in got.collect()}
    assert by["big"] == ["high_value"] and by["d51"] == ["high_discount"] and "unusual_time" in by["nohour"]


def test_repeated_amounts(spark):
    data = [sale(f"a{i}", total="5.00", employee="e1") for i in range(6)] + [sale(f"b{i}", total="5.00", employee="e2") for i in range(2)]
    data += [sale(f"c{i}", total="9.00", employee="e3") for i in range(3)]
    s = sales_of(spark, data)
    assert rows(risk.repeated_amounts(s), "employee_id", "occurrence_count", "severity") == [("e1", 6, "medium")]
    assert risk.repeated_amount_sales(s).count() == 6
    assert risk.repeated_amounts(sales_of(spark, data[:10])).count() == 0  # needs more than ten sales


def test_recommendations(spark):
    df = spark.createDataFrame([(["new_employee", "low_inventory_level"],), ([],), (["unknown"],)], "c array<string>")
    got = [r["r"] for r in df.select(causes.recommendation(F.col("c")).alias("r")).collect()]
    assert got[0] == causes.ADVICE["new_employee"] + "; " + causes.ADVICE["low_inventory_level"]
    assert got[1] == got[2] == causes.NO_ADVICE


def test_new_employee_is_less_than_thirty_days(spark):
    s = sales_of(spark, [sale(f"s{e}{i}", total="10.00" if i else "500.00", employee=e) for e in ("a", "b") for i in range(10)])
    labor = spark.createDataFrame([("L", "a", "A", "Cook", D, D - dt.timedelta(days=29)), ("L", "b", "B", "Cook", D, D - dt.timedelta(days=30)),
                                   ("L", "b", "B2", "Cook", D + dt.timedelta(days=1), D)],
                                  "location_id string, employee_id string, name string, role string, date date, hire_date date")
    got = {r["employee_id"]: (r["name"], "new_employee" in r["causes"]) for r in
           causes.employee_causes(anomaly.all_anomalies(s), s, labor, D).collect()}
    assert got == {"a": ("A", True), "b": ("B", False)}


def test_efficiency_score_by_hand(spark):
    s = sales_of(spark, [sale("1", total="10.00", hour=10, n=1), sale("2", total="30.00", hour=11, n=3), sale("3", total="20.00", hour=11, n=2)])
    # velocity (1 + 2.5)/2 = 1.75 -> 8.75; peak hour 11: 50/60 -> 20.8333; staff 20 -> 5; order type 2 -> 10
    want = (8.75 + 0.25 * 50 / 60 * 100 + 5 + 10) / 4 * 4
    assert efficiency.efficiency_score(s).first()["efficiency_score"] == pytest.approx(want)
    assert efficiency.peak_hours(s).first()["peak_hours"] == [11]


def test_score_bands(spark):
    df = spark.createDataFrame([("L", v) for v in (0.0, 50.0, 50.1, 70.1, 85.0, 85.1)], "location_id string, efficiency_score double")
    got = {r["efficiency_score"]: r["band"] for r in notices.score_band(df).collect()}
    assert got == {50.0: "Needs Improvement", 50.1: "Average", 70.1: "Good", 85.0: "Good", 85.1: "Excellent"}


def test_notices_show_five_examples_and_count_all(spark):
    found = anomaly.all_anomalies(sales_of(spark, [sale(f"d{i}", pct=30.0, employee=f"e{i}", total=f"{i}.00") for i in range(9)]))
    n = notices.anomaly_notices(found).where("rule = 'discount_anomalies'").first()
    assert n["n"] == 9 and n["examples"] == ["d0", "d1", "d2", "d3", "d4"]


def test_preferences(spark):
    n = spark.createDataFrame([(1, "fraud"), (1, "other"), (2, "fraud")], "user_id long, category string")
    s = spark.createDataFrame([(1, "fraud", False), (2, "fraud", True)], "user_id long, category string, enabled boolean")
    assert rows(notices.wanted(n, s)) == [(1, "other"), (2, "fraud")]


def visits_of(spark):
    as_of = dt.date(2025, 3, 31)
    def v(c, day, paid="10", email=None):
        return (c, c, f"{c}@x" if email is None else email, "1", Decimal(paid), day)
    data = [v("five", as_of - dt.timedelta(days=31))] * 5 + [v("six", dt.date(2025, 3, 1))] * 6  # a Saturday, 30 days ago
    data += [v("rich", dt.date(2025, 3, 27), "500.01"), v("edge", dt.date(2025, 3, 27), "500"), v("old", dt.date(2025, 2, 24)),
             v("new", as_of - dt.timedelta(days=7)), v("notnew", as_of - dt.timedelta(days=8)), v("none", dt.date(2025, 3, 27), email=""),
             v("sun", dt.date(2025, 3, 23)), v("fri", dt.date(2025, 3, 21)), v("undated", None)]
    return spark.createDataFrame(data, "customer_id string, customer_name string, email string, phone string, paid_amount decimal(18,2), visit_date date"), as_of


def test_customer_segments(spark):
    visits, as_of = visits_of(spark)
    got = {r["customer_name"]: r["type"] for r in customers.labelled_customers(visits, as_of).collect()}
    assert got["six"] == "Frequent diners, Weekend visitor"
    assert got["five"] == "Lapsed customer" and got["old"] == "Lapsed customer"
    assert got["rich"] == "High-valued, New customer" and got["edge"] == "New customer"
    assert got["new"] == "New customer" and got["sun"] == "Weekend visitor"
    assert got["notnew"] == "Weekend visitor"  # eight days ago was a Sunday
    assert not {"fri", "none", "undated"} & set(got)
    one = customers.customer_insights(visits, as_of).first()
    assert (one["total_customers"], one["frequent_customers"], one["high_value_customers"], one["lapsed_customers"]) == (11, 1, 1, 2)
    for label in customers.SEGMENTS:
        if label != "Weekend visitor":
            names = {r["customer_name"] for r in customers.customers_of_segment(visits, label, as_of).collect()}
            assert names == {k for k, t in got.items() if label in t}


def test_pos_orders(spark):
    line = "struct<menu_item_name: string, quantity: int, amount: decimal(18,2), food_cost: decimal(18,2)>"
    d = Decimal
    orders = spark.createDataFrame(
        [("L", "1", D, dt.datetime(2025, 10, 25, 9), d("10"), [("A", 2, d("8"), d("3")), (None, 1, d("2"), d("1"))]),
         ("L", "2", D, dt.datetime(2025, 10, 25, 9, 30), d("20"), []), ("L", "3", D + dt.timedelta(days=1), None, d("5"), [("A", 1, d("5"), d("2"))])],
        f"location_id string, order_id string, order_date date, order_ts timestamp, total decimal(18,2), items array<{line}>")
    day = {r["order_date"]: r for r in pos.daily_summary(orders).collect()}
    assert day[D]["total_orders"] == 2 and float(day[D]["average_order_value"]) == 15.0
    assert day[D]["top_items"] == {"A": 2, "Unknown": 1} and day[D]["hourly_revenue"] == {9: d("30.00")}
    items_ = {r["menu_item"]: (r["quantity"], float(r["profit"])) for r in pos.history_items(orders).collect()}
    assert items_ == {"A": (3, 8.0), "Unknown": (1, 1.0)}
    best = pos.insights(pos.day_totals(orders)).first()
    assert best["best_day"] == D and best["worst_day"] == D + dt.timedelta(days=1)


def test_metered_alerts_once_and_rejects_above_the_limit(spark):
    ts = [dt.datetime(2025, 1, 1, 0, i) for i in range(12)]
    log = spark.createDataFrame([(i, "u", D, t) for i, t in enumerate(ts)], "engagement_id long, user_id string, cycle_start date, ts timestamp")
    limits = spark.createDataFrame([("u", 10)], "user_id string, max_engagements long")
    got = sorted(usage.metered(log, limits).collect(), key=lambda r: r["engagement_id"])
    assert [r["alert"] for r in got] == [False] * 8 + [True] + [False] * 3
    assert [r["accepted"] for r in got] == [True] * 10 + [False] * 2
    assert got[-1]["tokens_used"] == 6000 and got[8]["share_used"] == 0.9


def test_trials(spark):
    data = [(i, i, D + dt.timedelta(days=n), True, True) for i, n in enumerate([-1, 0, 1, 3, 4])]
    subs = spark.createDataFrame(data, "id long, user_id long, trial_end_date date, is_trial boolean, is_active boolean")
    assert rows(usage.trial_states(subs, D), "days_left", "state") == [(-1, "expired"), (0, "ending"), (1, "ending"), (3, "reminder")]


def test_vectors(spark):
    chunks = spark.createDataFrame(
        [(1, "o", [1.0, 0.0]), (2, "o", [-1.0, 0.0]), (3, "o", [0.0, 0.0]), (4, "o", [2.0, 0.0]), (5, "p", [1.0, 0.0]), (6, "o", [0.0, 1.0])],
        "chunk_id long, owner_id string, embedding array<float>")
    q = spark.createDataFrame([("q", "o", [3.0, 0.0])], "query_id string, owner_id string, embedding array<float>")
    for spread in ({}, {"broadcast_bytes": 0, "hot_rows": 2}):
        got = vectors.similar_chunks(chunks, q, ["owner_id"], k=3, **spread).orderBy("rank").collect()
        assert [(r["chunk_id"], round(r["similarity"], 6)) for r in got] == [(1, 1.0), (4, 1.0), (6, 0.0)]


def test_reduced_vectors(spark):
    df = spark.createDataFrame([([3.0, 3.0, 3.0, 0.0, 6.0, 6.0, 9.0],), ([1.0],)], "e array<float>")
    got = [r["r"] for r in vectors.with_reduced(df, "e", "r", length=4).collect()]
    assert got[0] == pytest.approx([0.6, 0.8, 0.0, 0.0]) and got[1] == [0.0] * 4


def test_whole_texts_are_chunked(spark):
    text = "".join(chr(97 + i % 26) for i in range(2501))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "ab")], "id long, text string")
    got = sorted(vectors.text_chunks(df, ["id"], "text").collect())
    assert [(r["id"], r["chunk_id"], len(r["chunk"])) for r in got] == [(1, 0, 1000), (1, 1, 1000), (1, 2, 501), (3, 0, 2)]
    assert "".join(r["chunk"] for r in got if r["id"] == 1) == text


def test_row_chunks(spark):
    df = vectors.row_text(spark.range(45).select(F.lit("f").alias("file"), "id", F.when(F.col("id") != 3, F.col("id")).alias("x")), ["id", "x"])
    got = {r["chunk_id"]: r for r in vectors.row_chunks(df, ["file"], "id").collect()}
    assert {k: r["rows"] for k, r in got.items()} == {0: 20, 1: 20, 2: 5}
    assert got[0]["text"].split("\n")[3] == "id: 3" and got[2]["text"].split("\n")[0] == "id: 40 x: 40"


def test_dates_prefer_day_first(spark):
    raw = ["2025-10-25", "25/10/2025", "10/25/2025", "31/31/2025", "3/4/2025", "", None, "abc"]
    got = [r["d"] for r in spark.createDataFrame([(x,) for x in raw], "s string").select(clean.parse_date("s").alias("d")).collect()]
    assert got == [D, D, D, None, dt.date(2025, 4, 3), None, None, None]
    short = spark.createDataFrame([("10/25/25",)], "s string").select(clean.parse_date("s", clean.SHORT_DATE_FORMS).alias("d")).first()
    assert short["d"] == D


def test_hours_numbers_and_booleans(spark):
    df = spark.createDataFrame([("9:00:00", "abc", "yes"), ("12:30:00", "", "1"), ("25:99:00", " 2.555 ", "x"), (None, None, None)], "t string, n string, b string")
    got = [tuple(r) for r in df.select(clean.parse_hour("t"), numbers.number_or_zero("n"), clean.parse_bool("b")).collect()]
    assert got == [(9, Decimal("0.00"), True), (12, Decimal("0.00"), True), (None, Decimal("2.56"), False), (None, Decimal("0.00"), False)]


def test_periods(spark):
    df = spark.createDataFrame([("L", D - dt.timedelta(days=n)) for n in (0, 7, 8, 15, 30, 31, 180, 365, 366)], "location_id string, date date")
    n = {p: periods.in_period(df, p, D).count() for p in [*periods.PERIOD_DAYS, "All"]}
    assert n == {"Last_week": 2, "Last_15_days": 4, "Last_month": 5, "Last_6_months": 7, "Last_year": 8, "All": 9}
    assert periods.clamped_range(D, D - dt.timedelta(days=40)) == (D - dt.timedelta(days=40), D)
    assert periods.clamped_range(D, D - dt.timedelta(days=40), 20) == (D - dt.timedelta(days=40), D - dt.timedelta(days=20))
    assert periods.checked_range(D, D + dt.timedelta(days=200)) == (D, D + dt.timedelta(days=200))
    with pytest.raises(ValueError):
        periods.checked_range(D, D + dt.timedelta(days=21), periods.SHORT_RANGE_DAYS)
    with pytest.raises(ValueError):
        periods.checked_range(D, D - dt.timedelta(days=1))
    assert periods.last_days_of_data(df).count() == 1
    assert periods.from_cutoff_or_all(df, D + dt.timedelta(days=1)).count() == 9


def test_missing_columns_are_reported(spark):
    s = sales_of(spark, [sale("1")])
    got = bundles.all_kpis(s, None, None, None)
    errors = {r["kpi"]: r["warning"] for r in got.where("metric = 'error'").collect()}
    assert "overtime_pct" in errors and "total_sales" not in errors
    report = {r["kpi"]: r["is_available"] for r in bundles.kpi_availability(got).collect()}
    assert len(report) == 21 and report["total_sales"] and not report["splh"] and not report["table_turn_time"]


def test_item_revenue_adds_up(spark):
    s = sales_of(spark, [sale(str(i), "A;B;C", f"{i}.37") for i in range(1, 50)])
    total = float(items.item_base(s).agg(F.sum("revenue")).first()[0])
    assert total == pytest.approx(sum(i + 0.37 for i in range(1, 50)), abs=1e-3)
