"""Catalog questions over the canonical tables: one function per question.

Listings carry no order; callers that page use ``usage.page``. A limit is kept where the question has one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.functions import periods
from brigade.functions.numbers import MONEY, ratio
from brigade.operators.kpi import AMOUNT_QTY, KEY
from brigade.operators.spread import attach, paged_list, running, settle, top_within

# Words that name a period, and default columns per table.
PERIOD_WORDS = (
    "last week", "past week", "this week",
    "last 15 days", "past 15 days", "last fifteen days",
    "last month", "past month", "this month",
    "last 6 months", "past 6 months", "last six months",
    "last year", "past year", "this year",
    "all time", "overall",
)
COLUMN_WORDS = {
    "sales": {
        "total amount": "total_amount", "total_amount": "total_amount", "amount": "total_amount",
        "subtotal": "subtotal", "tips": "tip", "tip": "tip", "comps": "comps", "voids": "voids",
        "promos": "promos", "discount": "discount_applied", "tax": "tax", "revenue": "total_amount",
    },
    "inventory": {
        "quantity": "quantity", "stock": "quantity", "amount": "quantity", "unit cost": "unit_cost",
        "cost": "unit_cost", "par level": "par_level", "par": "par_level",
    },
    "menu": {
        "selling price": "item_price", "price": "item_price", "unit cost": "unit_cost", "cost": "unit_cost",
        "profit margin": "profit_margin", "margin": "profit_margin",
    },
    "labor": {
        "hours worked": "hours_worked", "hours": "hours_worked", "total wages": "total_wages",
        "wages": "total_wages", "hourly rate": "hourly_rate", "rate": "hourly_rate",
        "overtime": "overtime_hours", "overtime hours": "overtime_hours",
    },
}
DEFAULT_COLUMNS = {"sales": "total_amount", "inventory": "quantity", "menu": "item_price", "labor": "hours_worked"}


def like(c: str, word: str) -> Column:
    """Contains the word, any case."""
    return F.lower(c).contains(word.lower())


def of_locations(df: DataFrame, locations: DataFrame | Sequence | None) -> DataFrame:
    """Rows of the asked locations: a list, or a frame with location_id."""
    if locations is None:
        return df
    if isinstance(locations, DataFrame):
        return df.join(locations.select("location_id").distinct(), KEY, "left_semi")
    return df.where(F.col("location_id").isin(list(locations)))


def _sum(c: str) -> Column:
    return F.sum(F.col(c).cast(MONEY))


def _mean(c: str) -> Column:
    return ratio(_sum(c), F.count(c))


# -- by store ------------------------------------------------------------------------------------

def inventory_rows(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total"))


def ingredients(inventory: DataFrame) -> DataFrame:
    return inventory.select(*KEY, "ingredient").distinct()


def tip_percentage(sales: DataFrame) -> DataFrame:
    tipped = sales.where(F.col("tip").isNotNull() & (F.col("total_amount") > 0))
    pct = ratio("tip", "total_amount") * 100
    return tipped.groupBy(*KEY).agg(
        F.avg(pct).alias("avg_tip_percentage"), F.count(F.lit(1)).alias("total_orders"), _sum("tip").alias("total_tips")
    )


def menu_by_category(menu: DataFrame) -> DataFrame:
    named = menu.where(F.col("category").isNotNull())
    pairs = settle(named.select(*KEY, "category", "menu_item").distinct(), "menu_items")
    counts = pairs.groupBy(*KEY, "category").agg(F.count("menu_item").alias("item_count"))
    return counts.join(paged_list(pairs, [*KEY, "category"], "menu_item", "items"), [*KEY, "category"])


def under_par(inventory: DataFrame) -> DataFrame:
    """Strictly below par, with the shortage and the ratio the listing is ordered by."""
    return inventory.where(F.col("quantity") < F.col("par_level")).select(
        *KEY, "ingredient", "quantity", "par_level",
        (F.col("par_level") - F.col("quantity")).alias("shortage"),
        ratio("quantity", F.nullif("par_level", F.lit(0))).alias("ratio"),
    )


def under_par_in_order(inventory: DataFrame) -> DataFrame:
    """The listing with each row's place in its location: the scarcest first, rows without a ratio last."""
    return running(under_par(inventory), KEY, [F.col("ratio").asc_nulls_last(), F.col("ingredient"), F.col("quantity"), F.col("par_level")], rank="position")


def search(df: DataFrame, column: str, word: str, *columns: str) -> DataFrame:
    return df.where(like(column, word)).select(*KEY, *columns)


def search_menu_text(menu: DataFrame, query: str, *columns: str) -> DataFrame:
    """Word anywhere in name, description and category."""
    whole = F.lower(F.concat_ws(" ", *[F.col(c) for c in columns]))
    return menu.where(whole.contains(query.lower()))


def inventory_value(inventory: DataFrame) -> DataFrame:
    value = F.col("quantity").cast(AMOUNT_QTY) * F.col("unit_cost").cast(MONEY)
    return inventory.where(F.col("unit_cost").isNotNull()).groupBy(*KEY).agg(F.sum(value).alias("total_value"))


def wasted(inventory: DataFrame) -> DataFrame:
    return inventory.where(F.col("waste") > 0).select(*KEY, "ingredient", "quantity", "waste")


def menu_listing(menu: DataFrame) -> DataFrame:
    return menu.select(*KEY, "menu_item", "ingredient", "amount", "unit_cost")


def menu_costs(menu: DataFrame) -> DataFrame:
    return menu.where(F.col("unit_cost").isNotNull()).select(*KEY, "menu_item", "unit_cost")


def sales_totals(sales: DataFrame, with_average: bool = False) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("total_sales"), _sum("total_amount").alias("total_revenue")]
    if with_average:
        aggs.append(_mean("total_amount").alias("avg_order"))
    return sales.groupBy(*KEY).agg(*aggs)


def sales_today(sales: DataFrame, as_of: dt.date) -> DataFrame:
    return sales_totals(periods.on_day(sales, as_of))


def sales_yesterday(sales: DataFrame, as_of: dt.date) -> DataFrame:
    return sales_totals(periods.on_day(sales, as_of - dt.timedelta(days=1)))


def sales_this_week(sales: DataFrame, as_of: dt.date) -> DataFrame:
    return sales_totals(sales.where(F.col("date") >= F.lit(as_of - dt.timedelta(days=7))), with_average=True)


def sales_in_range(sales: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return sales_totals(periods.between(sales, periods.clamped_range(start, end)), with_average=True)


def item_texts_sold(sales: DataFrame) -> DataFrame:
    """Items and orders per whole item text."""
    return sales.where(F.col("items_sold").isNotNull()).groupBy(*KEY, "items_sold").agg(
        F.sum("number_of_items").alias("total_sold"), F.count(F.lit(1)).alias("order_count")
    )


def sales_by(sales: DataFrame, column: str, count_name: str) -> DataFrame:
    return sales.groupBy(*KEY, column).agg(
        F.count(F.lit(1)).alias(count_name), _sum("total_amount").alias("total_revenue")
    )


def order_value(sales: DataFrame) -> DataFrame:
    return sales.groupBy(*KEY).agg(
        _mean("total_amount").alias("avg_order_value"), F.count(F.lit(1)).alias("total_orders")
    )


def employees(labor: DataFrame) -> DataFrame:
    return labor.select(*KEY, "name", "role", "hire_date")


def employee_count(labor: DataFrame) -> DataFrame:
    return labor.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total_employees"))


def employees_by_role(labor: DataFrame) -> DataFrame:
    counts = labor.groupBy(*KEY, "role").agg(F.count(F.lit(1)).alias("employees"))
    names = paged_list(
        labor.where(F.col("name").isNotNull()).select(*KEY, "role", "name", "employee_id"),
        [*KEY, "role"], "name", "employee_names",
    )
    return counts.join(names, [*KEY, "role"], "left")


def new_hires(labor: DataFrame) -> DataFrame:
    return labor.where(F.col("hire_date").isNotNull()).select(*KEY, "name", "role", "hire_date")


def rows_in_range(df: DataFrame, start: dt.date, end: dt.date, col: str, *columns: str) -> DataFrame:
    return periods.between(df, periods.clamped_range(start, end), col).select(*KEY, *columns)


# -- by restaurant -------------------------------------------------------------------------------

def per_restaurant(restaurants: DataFrame, fact: DataFrame) -> DataFrame:
    """Every restaurant with its rows, pre-aggregated facts joined to the dimension by id."""
    r = restaurants.select(F.col("id").alias("location_id"), F.col("name").alias("restaurant_name"))
    return r.join(fact, "location_id", "left").drop("location_id")


def restaurant_inventory_rows(restaurants: DataFrame, inventory: DataFrame) -> DataFrame:
    counts = inventory.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total_rows"))
    return per_restaurant(restaurants, counts).fillna(0, ["total_rows"])


def restaurant_rows(restaurants: DataFrame, fact: DataFrame, *columns: str) -> DataFrame:
    """Listing with the restaurant's name; restaurants without rows do not appear."""
    r = restaurants.select(F.col("id").alias("location_id"), F.col("name").alias("restaurant_name"))
    return fact.join(r, "location_id").select("restaurant_name", *columns)


def ingredient_totals(restaurants: DataFrame, inventory: DataFrame, word: str) -> DataFrame:
    sums = inventory.where(like("ingredient", word)).groupBy(*KEY, "ingredient").agg(
        F.sum("quantity").alias("total_quantity"), F.count(F.lit(1)).alias("entry_count")
    )
    return restaurant_rows(restaurants, sums, "ingredient", "total_quantity", "entry_count")


def best_item_texts(restaurants: DataFrame, sales: DataFrame, as_of: dt.date, limit: int = 3) -> DataFrame:
    recent = sales.where(F.col("items_sold").isNotNull() & (F.col("date") >= F.lit(as_of - dt.timedelta(days=7))))
    sums = recent.groupBy(*KEY, "items_sold").agg(
        F.count(F.lit(1)).alias("times_ordered"), F.sum("number_of_items").alias("total_quantity"),
        _sum("subtotal").alias("total_revenue"), _mean("subtotal").alias("avg_order_value"),
    )
    best = first_rows(sums, limit, F.col("total_revenue").desc(), "items_sold")
    return restaurant_rows(restaurants, best, *sums.columns[1:])


def low_alerts(restaurants: DataFrame, inventory: DataFrame, limit: int = 20) -> DataFrame:
    low = inventory.where(F.col("alert") == "low").select(*KEY, "ingredient", "quantity")
    return restaurant_rows(restaurants, first_rows(low, limit, "quantity", "ingredient"), "ingredient", "quantity")


def first_rows(df: DataFrame, limit: int, *order: str | Column) -> DataFrame:
    """The first rows of every restaurant."""
    return top_within(df, KEY, [F.col(c) if isinstance(c, str) else c for c in order], limit, rank="_place").drop("_place")


def restaurant_sales(restaurants: DataFrame, sales: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Counts and sums with zeros for restaurants without sales."""
    sums = sales.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("transaction_count"), _sum("subtotal").alias("total_subtotal"),
        _sum("total_amount").alias("total_amount"), _mean("subtotal").alias("avg_subtotal"),
        _sum("tip").alias("total_tips"),
    )
    out = per_restaurant(restaurants, sums) if keep_empty else restaurant_rows(restaurants, sums, *sums.columns[1:])
    zero = F.lit(0)
    return out.select(
        "restaurant_name", *[F.coalesce(c, zero).alias(c) for c in sums.columns[1:]]
    )


def position_role(labor: DataFrame, default: str = "No Position") -> DataFrame:
    return labor.withColumn("position_role", F.coalesce("position", "role", F.lit(default)))


def employee_rates(restaurants: DataFrame, labor: DataFrame, word: str) -> DataFrame:
    hit = labor.where(like("name", word)).withColumn("position", F.coalesce("position", "role"))
    return restaurant_rows(restaurants, hit, "name", "position", "hourly_rate").distinct()


def distinct_count(restaurants: DataFrame, fact: DataFrame, column: str, name: str) -> DataFrame:
    counts = fact.groupBy(*KEY).agg(F.count_distinct(column).alias(name))
    return per_restaurant(restaurants, counts).fillna(0, [name])


def distinct_count_by(restaurants: DataFrame, fact: DataFrame, by: str, column: str, name: str, default: str) -> DataFrame:
    counts = fact.groupBy(*KEY, F.coalesce(by, F.lit(default)).alias(by)).agg(F.count_distinct(column).alias(name))
    return per_restaurant(restaurants, counts).fillna({by: default, name: 0})


def restaurant_sales_by(restaurants: DataFrame, sales: DataFrame, by: str, count_name: str) -> DataFrame:
    sums = sales.groupBy(*KEY, F.coalesce(by, F.lit("No Data")).alias(by)).agg(
        F.count(F.lit(1)).alias(count_name), _sum("subtotal").alias("total_subtotal")
    )
    out = per_restaurant(restaurants, sums)
    return out.select(
        "restaurant_name", F.coalesce(by, F.lit("No Data")).alias(by),
        F.coalesce(count_name, F.lit(0)).alias(count_name),
        F.coalesce("total_subtotal", F.lit(0)).alias("total_subtotal"),
    )


def frequent_item_texts(restaurants: DataFrame, sales: DataFrame, limit: int = 20) -> DataFrame:
    sums = sales.where(F.col("items_sold").isNotNull()).groupBy(*KEY, "items_sold").agg(
        F.count(F.lit(1)).alias("times_ordered"), F.sum("number_of_items").alias("total_quantity")
    )
    best = first_rows(sums, limit, F.col("times_ordered").desc(), "items_sold")
    return restaurant_rows(restaurants, best, "items_sold", "times_ordered", "total_quantity")


def average_tip(restaurants: DataFrame, sales: DataFrame) -> DataFrame:
    sums = sales.where(F.col("tip") > 0).groupBy(*KEY).agg(_mean("tip").alias("avg_tip"), _sum("tip").alias("total_tips"))
    return restaurant_rows(restaurants, sums, "avg_tip", "total_tips")


# -- chosen columns and question matching --------------------------------------------------------

def column_by_date(df: DataFrame, column: str, bounds: tuple[dt.date, dt.date]) -> DataFrame:
    """One chosen column over a checked date range: (location, date, value)."""
    if column not in df.columns:
        raise ValueError(f"no such column: {column}")
    return periods.between(df, periods.checked_range(*bounds)).select(*KEY, "date", F.col(column).alias("value"))


def column_for(question: str, table: str, words: Mapping[str, str] | None = None) -> str:
    """Column named by the first known word in the question, else the table's default."""
    low = question.lower()
    known = COLUMN_WORDS[table] if words is None else words
    return next((c for w, c in known.items() if w in low), DEFAULT_COLUMNS[table])


def match_questions(
    questions: DataFrame, text: str, catalog: Sequence[tuple[str, Sequence[str], bool]],
    skip_with_period: Sequence[str] = (),
) -> DataFrame:
    """First catalog entry one of whose patterns occurs in the text, in catalog order.

    Catalog entries are (id, patterns, is_kpi). KPI entries go first when the text names a period.
    The catalog is a short parameter list, so the match is one projection without any join.
    """
    low = F.lower(F.trim(text))
    timed = F.coalesce(*[F.when(low.contains(w), True) for w in PERIOD_WORDS], F.lit(False))

    def hit(patterns: Sequence[str]) -> Column:
        test = F.lit(False)
        for p in patterns:
            test = test | low.contains(p.lower())
        return test

    kpi_first = [F.when(timed & hit(p), F.lit(name)) for name, p, is_kpi in catalog if is_kpi]
    then = [
        F.when(hit(p) & ~timed if name in skip_with_period else hit(p), F.lit(name)) for name, p, _ in catalog
    ]
    return questions.withColumn("prompt_id", F.coalesce(*kpi_first, *then, F.lit(None).cast("string")))


def kpi_catalog(names: Sequence[str]) -> list[tuple[str, Sequence[str], bool]]:
    """A catalog entry per KPI: asked for by its name in words."""
    return [(name, [name.replace("_", " ")], True) for name in names]


def answers(
    questions: DataFrame, text: str, results: DataFrame, catalog: Sequence[tuple[str, Sequence[str], bool]], result_id: str = "kpi",
) -> DataFrame:
    """The result rows each location's question asks for: the matched catalog id is the route to the operator's rows.

    ``results`` holds the rows of all operators under their id, such as bundles.all_kpis; they are computed once for
    all questions. Questions that match nothing give no rows.
    """
    asked = match_questions(questions, text, catalog).where(F.col("prompt_id").isNotNull())
    rows = settle(results.withColumnRenamed(result_id, "prompt_id"), "results")
    sizes = rows.groupBy(*KEY, "prompt_id").agg(F.count(F.lit(1)).alias("_n"))
    return attach(rows, asked.join(sizes, [*KEY, "prompt_id"]), [*KEY, "prompt_id"], "inner", weight="_n").drop("_n")
