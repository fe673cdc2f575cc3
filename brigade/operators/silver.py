"""Raw rows to the canonical sales, inventory, menu and labor tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.functions import clean
from brigade.functions.items import parse_items
from brigade.functions.numbers import MONEY, dbl, number_or_zero, ratio

# Alert bands of quantity / par, overtime rule, salaried words, assumed hours.
BANDS = (("CRITICAL LOW", 0.4), ("LOW", 0.6))
HIGH_BAND = 1.3
DAILY_HOURS = 8.0
SALARIED_WORDS = ("manager", "supervisor", "director", "chef")
SALARIED_HOURS, HOURLY_HOURS = 160.0, 120.0


def _has(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def clean_sales(raw: DataFrame, location_id: Column | None = None, date_forms=clean.DATE_FORMS) -> DataFrame:
    """Sales rows from an all-text frame with any header spelling."""
    df = clean.normal_headers(raw)
    amount = {c: number_or_zero(_has(df, c)) for c in
              ("subtotal", "tip", "total_amount", "comps", "voids", "promos", "tax")}
    pct = number_or_zero(_has(df, "discount_percent"), "double")
    void = clean.parse_bool(_has(df, "void_status"))
    return df.select(
        (location_id if location_id is not None else _has(df, "location_id")).alias("location_id"),
        clean.text_or(_has(df, "sale_id"), "").alias("sale_id"),
        clean.parse_date(_has(df, "date"), date_forms).alias("date"),
        _has(df, "time").alias("time"),
        clean.parse_hour(_has(df, "time")).alias("hour"),
        _has(df, "items_sold").alias("items_sold"),
        parse_items(_has(df, "items_sold")).alias("items"),
        number_or_zero(_has(df, "number_of_items"), "int").alias("number_of_items"),
        amount["subtotal"].alias("subtotal"),
        amount["tip"].alias("tip"),
        amount["total_amount"].alias("total_amount"),
        clean.text_or(_has(df, "payment_method"), "Unknown").alias("payment_method"),
        clean.text_or(_has(df, "order_type"), "Unknown").alias("order_type"),
        clean.text_or(_has(df, "employee_id"), "").alias("employee_id"),
        _has(df, "customer_id").alias("customer_id"),
        clean.parse_bool(_has(df, "is_loyalty_member")).alias("is_loyalty_member"),
        _has(df, "promotion_id").alias("promotion_id"),
        pct.alias("discount_percent"),
        discount_applied(amount["subtotal"], pct).alias("discount_applied"),
        _has(df, "table_number").alias("table_number"),
        F.trim(_has(df, "covers")).try_cast("int").alias("covers"),
        amount["comps"].alias("comps"),
        amount["voids"].alias("voids"),
        amount["promos"].alias("promos"),
        amount["tax"].alias("tax"),
        _has(df, "daypart").alias("daypart"),
        void.alias("void_status"),
        _has(df, "filename").alias("filename"),
    )


def discount_applied(subtotal: Column, pct: Column) -> Column:
    off = (subtotal * pct.cast("decimal(7,2)") / F.lit(100)).cast(MONEY)
    return F.when(pct > 0, off).otherwise(F.lit(0).cast(MONEY))


def clean_inventory(raw: DataFrame, location_id: Column | None = None, date_forms=clean.DATE_FORMS) -> DataFrame:
    df = clean.normal_headers(raw)
    base = df.select(
        (location_id if location_id is not None else _has(df, "location_id")).alias("location_id"),
        clean.parse_date(_has(df, "date"), date_forms).alias("date"),
        clean.text_or(_has(df, "ingredient"), "Unknown").alias("ingredient"),
        number_or_zero(_has(df, "quantity"), "double").alias("quantity"),
        number_or_zero(_has(df, "par_level"), "double").alias("par_level"),
        number_or_zero(_has(df, "unit_cost")).alias("unit_cost"),
        F.trim(_has(df, "total_value")).try_cast(MONEY).alias("_given_value"),
        clean.text_or(_has(df, "category"), "Unknown").alias("category"),
        clean.text_or(_has(df, "unit_of_measure"), "").alias("unit"),
        clean.parse_bool(_has(df, "is_low")).alias("is_low"),
        number_or_zero(_has(df, "waste"), "double").alias("waste"),
        clean.text_or(_has(df, "supplier"), "Unknown").alias("supplier"),
        clean.parse_date(_has(df, "last_ordered_date"), date_forms).alias("last_ordered_date"),
        _has(df, "filename").alias("filename"),
    )
    return derive_inventory(base)


def derive_inventory(df: DataFrame) -> DataFrame:
    """total_value, inventory_ratio (0 without a par level) and the low/normal alert."""
    computed = (F.col("quantity").cast("decimal(14,3)") * F.col("unit_cost")).cast(MONEY)
    value = F.coalesce("_given_value", computed) if "_given_value" in df.columns else computed
    return (
        df.withColumn("total_value", value)
        .withColumn(
            "inventory_ratio",
            F.when(F.col("par_level") > 0, dbl("quantity") / dbl("par_level")).otherwise(F.lit(0.0)),
        )
        .withColumn("alert", F.when(F.col("is_low"), "low").otherwise("normal"))
        .drop("_given_value")
    )


def alert_band(df: DataFrame) -> DataFrame:
    """Band of quantity / par; rows without a par level are NORMAL."""
    r = F.try_divide(dbl("quantity"), dbl("par_level"))
    band = None
    for name, below in BANDS:
        band = F.when(r < below, name) if band is None else band.when(r < below, name)
    band = band.when(r > HIGH_BAND, "HIGH").otherwise("NORMAL")
    return df.withColumn("ratio", r).withColumn("band", band).withColumn(
        "is_low", F.col("band").isin("LOW", "CRITICAL LOW")
    )


def clean_menu(raw: DataFrame, location_id: Column | None = None, date_forms=clean.DATE_FORMS) -> DataFrame:
    df = clean.normal_headers(raw)
    base = df.select(
        (location_id if location_id is not None else _has(df, "location_id")).alias("location_id"),
        clean.parse_date(_has(df, "date"), date_forms).alias("date"),
        clean.text_or(_has(df, "menu_item"), "Unknown").alias("menu_item"),
        clean.text_or(_has(df, "ingredient"), "").alias("ingredient"),
        number_or_zero(_has(df, "amount"), "double").alias("amount"),
        number_or_zero(_has(df, "unit_cost")).alias("unit_cost"),
        clean.text_or(_has(df, "category"), "Unknown").alias("category"),
        number_or_zero(_has(df, "item_price")).alias("item_price"),
        clean.parse_date(_has(df, "created_at"), date_forms).alias("created_at"),
        clean.parse_date(_has(df, "updated_at"), date_forms).alias("updated_at"),
        clean.parse_bool(_has(df, "is_active")).alias("is_active"),
        _has(df, "filename").alias("filename"),
        _has(df, "ingest_seq", "long").cast("long").alias("ingest_seq"),
    )
    return derive_menu(base)


def derive_menu(df: DataFrame) -> DataFrame:
    """total_cost and profit_margin percent (0 without a price)."""
    cost = F.col("amount").cast("decimal(12,3)") * F.col("unit_cost").cast(MONEY)
    margin = (dbl("item_price") - dbl("total_cost")) / dbl("item_price") * 100
    return df.withColumn("total_cost", cost).withColumn(
        "profit_margin", F.when(F.col("item_price") > 0, margin).otherwise(F.lit(0.0))
    )


def clean_labor(raw: DataFrame, location_id: Column | None = None, date_forms=clean.DATE_FORMS) -> DataFrame:
    df = clean.normal_headers(raw)
    position = clean.position_or_role(F.trim(_has(df, "position")), F.trim(_has(df, "role")))
    base = df.select(
        (location_id if location_id is not None else _has(df, "location_id")).alias("location_id"),
        clean.parse_date(_has(df, "date"), date_forms).alias("date"),
        clean.text_or(_has(df, "employee_id"), "").alias("employee_id"),
        clean.text_or(_has(df, "name"), "Unknown").alias("name"),
        position.alias("position"),
        clean.position_or_role(F.trim(_has(df, "role")), position).alias("role"),
        number_or_zero(_has(df, "hourly_rate")).alias("hourly_rate"),
        number_or_zero(_has(df, "hours_worked"), "double").alias("hours_worked"),
        F.trim(_has(df, "overtime_hours")).try_cast("double").alias("overtime_hours"),
        F.when(_has(df, "is_overtime").isNotNull(), clean.parse_bool(_has(df, "is_overtime"))).alias("is_overtime"),
        clean.parse_bool(_has(df, "is_salaried")).alias("is_salaried"),
        clean.text_or(_has(df, "department"), "Unknown").alias("department"),
        clean.parse_date(_has(df, "hire_date"), date_forms).alias("hire_date"),
        clean.parse_date(_has(df, "termination_date"), date_forms).alias("termination_date"),
        _has(df, "filename").alias("filename"),
    )
    return derive_labor(base)


def derive_labor(df: DataFrame, daily_hours: float = DAILY_HOURS) -> DataFrame:
    """Wages, overtime flag and overtime hours; supplied overtime hours stay."""
    wages = (F.col("hourly_rate").cast(MONEY) * F.col("hours_worked").cast("decimal(10,2)")).cast(MONEY)
    flag = F.coalesce("is_overtime", F.col("hours_worked") > daily_hours)
    rule = F.when(flag, F.greatest(F.lit(0.0), F.col("hours_worked") - daily_hours)).otherwise(F.lit(0.0))
    return (
        df.withColumn("total_wages", wages)
        .withColumn("overtime_hours", F.coalesce("overtime_hours", rule))
        .withColumn("is_overtime", flag)
    )


def adapt_pos_sales(pos: DataFrame) -> DataFrame:
    """POS sales rows to canonical sales.

    Wants discount, subtotal, total_amount, is_void and covers next to the sale columns.
    """
    zero = F.lit(0).cast(MONEY)
    off = F.coalesce(F.col("discount").cast(MONEY), zero)
    is_void = F.coalesce("is_void", F.lit(False))
    comped = ~is_void & (F.col("total_amount") == 0) & (F.col("subtotal") > 0)
    return (
        pos.withColumn(
            "discount_percent",
            F.when(F.col("subtotal") > 0, F.round(ratio(off, "subtotal") * 100, 2)).otherwise(F.lit(0.0)),
        )
        .withColumn("voids", F.when(is_void, F.abs("total_amount")).otherwise(zero).cast(MONEY))
        .withColumn("comps", F.when(comped, F.col("subtotal")).otherwise(zero).cast(MONEY))
        .withColumn("promos", off)
        .withColumn("covers", F.coalesce(F.nullif("covers", F.lit(0)), F.lit(1)))
        .withColumn("gross_sales", F.col("subtotal"))
        .drop("discount", "is_void")
    )


def adapt_pos_labor(staff: DataFrame, as_of: dt.date) -> DataFrame:
    """POS staff list to labor rows: no terminated staff, salary by role, assumed monthly hours."""
    present = staff.where(F.col("termination_date").isNull() | (F.col("termination_date") > F.lit(as_of)))
    salaried = F.coalesce(F.lower("role").rlike("|".join(SALARIED_WORDS)), F.lit(False))
    return present.withColumn("is_salaried", salaried).withColumn(
        "hours_worked", F.when(salaried, F.lit(SALARIED_HOURS)).otherwise(F.lit(HOURLY_HOURS))
    )


def salaried_by_position(df: DataFrame) -> DataFrame:
    """Salaried when the position names a manager or a chef."""
    return df.withColumn(
        "is_salaried",
        F.coalesce(F.col("position").ilike("%manager%") | F.col("position").ilike("%chef%"), F.lit(False)),
    )
