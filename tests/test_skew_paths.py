"""The way beyond the broadcast bound: whole queries with fanned-out joins still match their SQL."""

import pytest

import __spark_entry__ as entry
from brigade.operators import spread
from brigade.plans.registry import QUERIES, tidy
from brigade.plans.views import Tables
from tests import oracle

SF = "/root/testdata/sf0.001"
NAMES = [
    "anomaly_all", "anomaly_repeated_identical", "risk_transactions", "risk_repeated_amount_sales", "cause_transactions",
    "cause_employees", "cause_inventory", "cause_cluster_sales", "join_ingredient_in_item_text", "kpi_menu_quadrants",
    "dash_product_mix", "dash_depletion_by_item", "dash_week_summary", "customer_labels", "usage_metered",
    "usage_detail", "usage_current_cycle", "usage_limit_checks",
    "notice_preferences", "vector_similar_history", "text_conversations_newest_first",
]


@pytest.mark.parametrize("name", NAMES)
def test_without_any_broadcast(spark, monkeypatch, name):
    monkeypatch.setattr(spread, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(spread, "HOT_ROWS", 10)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = tidy(QUERIES[name](Tables(spark, SF)))
        assert oracle.compare(df, oracle.connect(SF), entry.oracle_sql()[name]) is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
