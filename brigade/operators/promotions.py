"""Promotion suggestions from dips, dayparts, surplus stock and smart menu targets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brigade.functions.numbers import dbl, ratio
from brigade.operators.spread import attach, running, top_within

KEY = ["location_id"]

# Dip levels in percent with level and discount, dayparts by first and last hour,
# surplus bands by least quantity, and the quantity that counts as enough.
DIPS = ((40, "Critical"), (30, "High"), (20, "Moderate"))
DAYPARTS = (("breakfast", 6, 10), ("lunch", 11, 14), ("afternoon", 15, 16), ("dinner", 17, 22))
LAST_DAYPART = "late_night"
SURPLUS = (("critical_surplus", 2000), ("high_surplus", 1500), ("moderate_surplus", 1000))
ENOUGH = 500

# Offer titles per kind.
OFFERS = {
    "dip": ("Flash Sale Boost", "Combo Value Deal", "Happy Hour Extension"),
    "breakfast": ("Rise & Shine Special", "Morning Power Bundle", "Early Bird Rewards"),
    "lunch": ("Lunch Express Combo", "Office Group Special", "Midday Feast Deal"),
    "afternoon": ("Afternoon Delight Bundle", "Social Hour Specials", "Sweet Tooth Happy Hour"),
    "dinner": ("Family Feast Package", "Date Night Special", "Sunset Dinner Deal"),
    "late_night": ("Midnight Munchies Bundle", "Night Owl Special", "Late Night Bites Box"),
    "critical_surplus": ("Flash Sale Blitz", "Bulk Buy Bonanza"),
    "high_surplus": ("Combo Deal Special", "Happy Hour Feature"),
    "moderate_surplus": ("Weekend Special", "Loyalty Member Deal"),
    "premium": ("Premium Spotlight Deal", "Gourmet Bundle"),
    "popular": ("Fan Favorite Special", "Trending Item Deal"),
    "surplus_reduction": ("Chef's Special Feature", "Limited Time Creation"),
}

# Sign and urgency per dip level, texts of the dip offers in the order of their titles, and how long they run.
DIP_SIGNS = {
    "Critical": ("🚨", "Immediate action required"),
    "High": ("⚠️", "Urgent attention needed"),
    "Moderate": ("📊", "Monitor closely"),
}
DIP_DETAILS = (
    "Limited time {discount} off on all menu items.\nValid only for {day}, drive immediate sales boost.",
    "Buy any main course, get appetizer {discount} off.\nPerfect for increasing average order value.",
    "Extended happy hour with {discount} off.\nBoost traffic during traditionally slow periods.",
)
DIP_DURATION = "24 hours"

# Audience and channels per target category.
AUDIENCE = {
    "premium": ("Fine dining enthusiasts", "Special occasion diners", "Food critics"),
    "popular": ("Regular customers", "Social media followers", "Value seekers"),
    "surplus_reduction": ("Price-sensitive customers", "Bulk buyers", "Large groups"),
}
CHANNELS = {
    "premium": ("Email newsletter", "Instagram", "Direct SMS to VIP customers"),
    "popular": ("Social media", "In-app notifications", "Table displays"),
    "surplus_reduction": ("Push notifications", "Daily specials board", "Staff recommendations"),
}
ANY_AUDIENCE, ANY_CHANNEL = ("General audience",), ("All channels",)


def _pick(subject: Column, n: Column) -> Column:
    """A place from 1 to n, fixed by the subject."""
    return (F.conv(F.substring(F.md5(subject), 1, 7), 16, 10).cast("bigint") % n + 1).cast("int")


def _at(values: Column, place: Column) -> Column:
    """Element at a place; null for a null place (element_at alone takes it for a number where no element is null)."""
    return F.when(place.isNotNull(), F.element_at(values, place))


def pick_offer(kind: Column, subject: Column) -> Column:
    """An offer title of the kind, chosen by a hash of the subject: the same on every run."""
    table = F.create_map(
        *[x for k, titles in OFFERS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in titles]))]
    )
    titles = table[kind]
    return _at(titles, _pick(subject, F.size(titles)))


def sales_dips(daily: DataFrame) -> DataFrame:
    """Days far below the location's daily mean. Wants one row per location and date."""
    # rows per location are bounded by the calendar, so a window over the location is safe
    here = Window.partitionBy(*KEY)
    mean = F.try_divide(dbl(F.sum("total_amount").over(here)), F.count("total_amount").over(here))
    drop = F.try_divide(F.col("average") - dbl("total_amount"), F.col("average")) * 100
    level = discount = None
    for least, name in DIPS:
        test = F.col("drop_pct") >= least
        level = F.when(test, name) if level is None else level.when(test, name)
        discount = F.when(test, least) if discount is None else discount.when(test, least)
    return (
        daily.withColumn("average", mean)
        .withColumn("drop_pct", drop)
        .withColumn("severity", level)
        .withColumn("discount_pct", discount)
        .where(F.col("severity").isNotNull())
        .select(
            *KEY, "date", "total_amount", "average", "drop_pct", "severity", "discount_pct",
            (F.col("average") - dbl("total_amount")).alias("recoverable"),
        )
    )


def dip_suggestions(daily: DataFrame) -> DataFrame:
    """A suggestion for every dip: reason, offer, its text with discount and day, and what may be recovered.

    The offer is chosen by a hash of the day, so stores share the offer of a day. A dip without a date keeps its
    severity, urgency, impact and duration; the texts that name the day are null.
    """
    day, severity = F.col("date").cast("string"), F.col("severity")
    sign, urgency = (
        F.create_map(*[F.lit(x) for level, pair in DIP_SIGNS.items() for x in (level, pair[i])])[severity] for i in (0, 1)
    )

    def places(name: str, n: int) -> Column:
        return F.col(name).cast(f"decimal(38,{n})").cast("string")

    text = _at(F.array(*[F.lit(x) for x in DIP_DETAILS]), _pick(day, F.lit(len(DIP_DETAILS))))
    discount = F.concat(F.col("discount_pct").cast("string"), F.lit("%"))
    details = F.replace(F.replace(text, F.lit("{discount}"), discount), F.lit("{day}"), day)
    reason = F.concat(
        sign, F.lit(" Sales on "), day, F.lit(" dropped by "), places("drop_pct", 1),
        F.lit("% compared to daily average of $"), places("average", 2))
    # amounts are shown with one place where the second one is zero
    lost = F.regexp_replace(places("recoverable", 2), r"(\.\d)0$", "$1")
    return sales_dips(daily).select(
        *KEY, "date", F.concat(F.lit("All menu items (Low sales on "), day, F.lit(")")).alias("item"), "severity", reason.alias("reason"),
        pick_offer(F.lit("dip"), day).alias("suggested_offer"), details.alias("offer_details"), urgency.alias("urgency_level"),
        F.concat(F.lit("Potential to recover $"), lost, F.lit(" in lost revenue")).alias("estimated_impact"),
        F.lit(DIP_DURATION).alias("recommended_duration"), severity.alias("implementation_priority"),
    )


def daypart(hour: Column | str) -> Column:
    h = F.col(hour) if isinstance(hour, str) else hour
    out = None
    for name, first, last in DAYPARTS:
        out = F.when(h.between(first, last), name) if out is None else out.when(h.between(first, last), name)
    return out.when(h.between(0, 23), LAST_DAYPART).otherwise("other")


def weak_dayparts(item_hours: DataFrame, below: float = 0.5) -> DataFrame:
    """Hours in which an item earns less than half its hourly mean, per daypart.

    Wants (location_id, menu_item, hour, revenue): at most 24 rows per item.
    """
    item = Window.partitionBy(*KEY, "menu_item")
    mean = F.try_divide(dbl(F.sum("revenue").over(item)), F.count("revenue").over(item))
    weak = item_hours.withColumn("_mean", mean).where(dbl("revenue") < F.col("_mean") * below)
    label = F.format_string("%02d:00", "hour")
    return weak.groupBy(*KEY, "menu_item", daypart("hour").alias("segment")).agg(
        F.array_join(F.sort_array(F.collect_list(label)), ", ").alias("hours"),
        ratio(F.sum("revenue"), F.count(F.lit(1))).alias("average_revenue"),
    )


def surplus_stock(inventory: DataFrame, enough: float = ENOUGH) -> DataFrame:
    """Ingredients in surplus with their band and potential waste."""
    band = None
    for name, least in SURPLUS:
        test = F.col("quantity") >= least
        band = F.when(test, name) if band is None else band.when(test, name)
    return inventory.withColumn("segment", band).where(F.col("segment").isNotNull()).select(
        *KEY, "ingredient", "quantity", "segment",
        F.when(F.col("segment") == "critical_surplus", "High").otherwise("Medium").alias("urgency"),
        (F.col("quantity") - enough).alias("potential_waste"),
    )


def smart_targets(
    top_sellers: DataFrame, top_menu: DataFrame, profitable: DataFrame, inventory: DataFrame,
    menu: DataFrame, surplus_from: float = 1500.0, limit: int = 5,
) -> DataFrame:
    """Items worth a promotion, best first.

    Candidates come from two top lists; a flag says whether an item is among the most profitable,
    and surplus ingredients of its recipe are counted.
    """
    item = [*KEY, "menu_item"]
    both = top_sellers.select(*item, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        top_menu.select(*item, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    candidates = both.groupBy(*item).agg((F.max("a") + F.max("b")).alias("popularity"))
    flags = profitable.select(*item).distinct().withColumn("profitable", F.lit(True))
    surplus = inventory.where(F.col("quantity") >= surplus_from).select(*KEY, "ingredient").distinct()
    # recipe lines of the candidates only: a list per item stays as short as its recipe
    lines = menu.select(*item, "ingredient").distinct().join(candidates.select(*item), item, "left_semi")
    matched = attach(lines, surplus, [*KEY, "ingredient"], "left_semi").groupBy(*item).agg(
        F.sort_array(F.collect_list("ingredient")).alias("surplus_ingredients")
    )
    joined = (
        candidates.join(flags, item, "left")
        .join(matched, item, "left")
        .withColumn("profitable", F.coalesce("profitable", F.lit(False)))
        .withColumn("surplus_ingredients", F.coalesce("surplus_ingredients", F.array().cast("array<string>")))
    )
    category = (
        F.when(F.size("surplus_ingredients") > 0, "surplus_reduction")
        .when(F.col("profitable"), "premium")
        .otherwise("popular")
    )
    order = [
        F.col("profitable").desc(), F.col("popularity").desc(),
        F.size("surplus_ingredients").desc(), F.col("menu_item"),
    ]
    return top_within(joined.withColumn("category", category), KEY, order, limit)


def with_reason(targets: DataFrame) -> DataFrame:
    """Reason text, audience and channels of each target."""
    reason = F.concat_ws(
        "\n",
        F.when(F.col("profitable"), "High profit margin item with proven returns"),
        F.when(F.col("popularity") == 2, "Consistently top-performing menu item").when(
            F.col("popularity") == 1, "Growing customer favorite"
        ),
        F.when(
            F.size("surplus_ingredients") > 0,
            F.concat(F.lit("Helps reduce surplus of: "), F.array_join("surplus_ingredients", ", ")),
        ),
    )

    def lookup(table: dict, default: tuple) -> Column:
        m = F.create_map(
            *[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))]
        )
        return F.coalesce(F.try_element_at(m, F.col("category")), F.array(*[F.lit(t) for t in default]))

    return (
        targets.withColumn("reason", reason)
        .withColumn("audience", lookup(AUDIENCE, ANY_AUDIENCE))
        .withColumn("channels", lookup(CHANNELS, ANY_CHANNEL))
    )


def with_offer(df: DataFrame, kind: Column | str, subject: str) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.withColumn("offer", pick_offer(kind, F.col(subject)))


def campaign_copy(suggestions: DataFrame, templates: DataFrame) -> DataFrame:
    """Text per suggestion and channel; templates (channel, seq, text) use {item} and {offer}.

    The template is chosen by a hash of the item: its place among those of the channel is computed, the text is
    joined on (channel, place). Only channel names and counts are listed.
    """
    numbered = running(templates, ["channel"], [F.col("seq"), F.col("text")], rank="_place")
    sizes = templates.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    channels = sizes.agg(F.collect_list(F.struct("channel", "n"))).scalar()
    each = suggestions.withColumn("_c", F.explode(channels)).withColumn("channel", F.col("_c.channel"))
    placed = each.withColumn("_place", _pick(F.col("item"), F.col("_c.n")).cast("long")).drop("_c")
    uses = placed.groupBy("channel", "_place").agg(F.count(F.lit(1)).alias("_n"))
    texts = numbered.select("channel", "_place", F.col("text").alias("_text")).join(uses, ["channel", "_place"])
    filled = F.replace(F.replace(F.col("_text"), F.lit("{item}"), F.col("item")), F.lit("{offer}"), F.col("offer"))
    joined = attach(placed, texts, ["channel", "_place"], "inner", weight="_n", spread_by=["item"])
    return joined.select(*suggestions.columns, "channel", filled.alias("copy"))


def suggestions(dips: DataFrame, weak: DataFrame, surplus: DataFrame, limit: int = 5) -> DataFrame:
    """The first few of each kind per location."""
    d = top_within(
        dips.select(*KEY, F.lit("sales_dip").alias("kind"), F.col("date").cast("string").alias("subject"),
                    F.col("severity").alias("detail")),
        KEY, [F.col("subject")], limit)
    w = top_within(
        weak.select(*KEY, F.lit("daypart").alias("kind"), F.col("menu_item").alias("subject"),
                    F.col("segment").alias("detail")),
        KEY, [F.col("subject"), F.col("detail")], limit)
    s = top_within(
        surplus.select(*KEY, F.lit("surplus").alias("kind"), F.col("ingredient").alias("subject"),
                       F.col("segment").alias("detail")),
        KEY, [F.col("subject")], limit)
    return d.unionByName(w).unionByName(s)


def upcoming_events(events: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Events of today and the next days as rows: date, event, suggested_offer, campaign_prompt."""
    near = events.where(F.col("date").between(F.lit(as_of), F.lit(as_of + dt.timedelta(days=days))))
    return near.select("date", "event", "suggested_offer", "campaign_prompt")
