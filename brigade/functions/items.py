"""Sold-item lists: parsing, explosion and the item-grain base the KPIs share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.functions.numbers import MONEY, dbl

SHARE = "decimal(18,6)"
UNIT_COST = "decimal(24,5)"
AMOUNT = "decimal(12,3)"


def split_items(c: Column | str) -> Column:
    """Semicolon list, trimmed, empties dropped."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def parse_items(c: Column | str) -> Column:
    """JSON array text when it is one, a semicolon list otherwise."""
    c = F.col(c) if isinstance(c, str) else c
    as_json = F.when(F.trim(c).startswith("["), F.from_json(F.trim(c), "array<string>"))
    usable = F.when(F.size(F.filter(as_json, lambda x: x.isNotNull())) > 0, as_json)
    return F.when(F.trim(c) != "", F.coalesce(usable, split_items(c)))


def basis(df: DataFrame, revenue_basis: str) -> Column:
    """Revenue of a sale: 'total' takes total_amount, or subtotal when that is 0 or null."""
    if revenue_basis == "subtotal":
        return F.coalesce(F.col("subtotal"), F.lit(0)).cast(MONEY)
    return F.coalesce(
        F.when(F.col("total_amount") != 0, F.col("total_amount")), F.col("subtotal"), F.lit(0)
    ).cast(MONEY)


def sold_items(sales: DataFrame, *keep: str, revenue_basis: str = "total") -> DataFrame:
    """One row per sold item with its equal share of the sale, exact to a millionth.

    ``sales`` needs location_id, items and the amount columns; explode is the only row multiplier.
    """
    with_items = sales.where(F.size("items") > 0)
    share = (dbl(basis(sales, revenue_basis)) / F.size("items")).cast(SHARE)
    return with_items.select(
        "location_id", *keep, F.explode("items").alias("menu_item"), share.alias("revenue")
    )


def item_base(sales: DataFrame, *by: str, revenue_basis: str = "total") -> DataFrame:
    """Units and revenue per location and item (and further keys): combined map-side."""
    return (
        sold_items(sales, *by, revenue_basis=revenue_basis)
        .groupBy("location_id", *by, "menu_item")
        .agg(F.count(F.lit(1)).alias("units"), F.sum("revenue").cast("decimal(28,6)").alias("revenue"))
    )


def line_cost() -> Column:
    return F.col("amount").cast(AMOUNT) * F.col("unit_cost").cast(MONEY)


def item_cost(menu: DataFrame) -> DataFrame:
    """Cost of one unit of a menu item: its recipe lines added up, repeated lines included."""
    return menu.groupBy("location_id", "menu_item").agg(
        F.coalesce(F.sum(line_cost()), F.lit(0)).cast(UNIT_COST).alias("unit_cost")
    )


def recipe_lines(menu: DataFrame) -> DataFrame:
    """One row per (item, ingredient); of repeated lines the one ingested last stays."""
    return (
        menu.groupBy("location_id", "menu_item", "ingredient")
        .agg(F.max_by(F.struct("amount", "unit_cost"), "ingest_seq").alias("line"))
        .select("location_id", "menu_item", "ingredient", "line.amount", "line.unit_cost")
    )


def times(units: Column | str, cost: Column | str) -> Column:
    """Units times unit cost in exact decimals."""
    units = F.col(units) if isinstance(units, str) else units
    cost = F.col(cost) if isinstance(cost, str) else cost
    return cost.cast(UNIT_COST) * units.cast("decimal(12,0)")
