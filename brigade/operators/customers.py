"""Customer visits: insight counts, segments, campaign outcomes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.functions.numbers import MONEY, ratio
from brigade.functions.periods import weekend
from brigade.operators.spread import attach

# Segment labels in label order.
SEGMENTS = ("Frequent diners", "Weekend visitor", "High-valued", "Lapsed customer", "New customer")
PERSON = ["email", "customer_name", "phone"]


def _days_ago(as_of: dt.date, n: int) -> Column:
    return F.lit(as_of - dt.timedelta(days=n))


def customer_insights(
    visits: DataFrame, as_of: dt.date, visits_above: int = 5, spend_above: int = 500,
    lapsed_days: int = 30, new_days: int = 7,
) -> DataFrame:
    """Six counts over customers, from one customer-grain aggregation."""
    per = visits.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("visits"),
        F.sum(F.col("paid_amount").cast(MONEY)).alias("spent"),
        F.min("visit_date").alias("first"),
        F.max("visit_date").alias("last"),
        F.coalesce(F.bool_or(weekend("visit_date")), F.lit(False)).alias("weekend"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(F.col("visits") > visits_above).alias("frequent_customers"),
        F.count_if("weekend").alias("weekend_customers"),
        F.count_if(F.col("spent") > spend_above).alias("high_value_customers"),
        F.count_if(F.col("last") < _days_ago(as_of, lapsed_days)).alias("lapsed_customers"),
        F.count_if(F.col("first") >= _days_ago(as_of, new_days)).alias("new_customers"),
    )


def reachable(visits: DataFrame) -> DataFrame:
    return visits.where(F.col("email").isNotNull() & (F.col("email") != ""))


def person_facts(visits: DataFrame) -> DataFrame:
    """Spend, visits and last visit per (email, name, phone); weekend and first visit per email."""
    known = reachable(visits)
    per = known.groupBy(*PERSON).agg(
        F.sum(F.col("paid_amount").cast(MONEY)).alias("total_spent"),
        F.count(F.lit(1)).alias("visit_count"),
        F.max("visit_date").alias("last_visit"),
    )
    by_email = known.groupBy("email").agg(
        F.coalesce(F.bool_or(weekend("visit_date")), F.lit(False)).alias("weekend"),
        F.min("visit_date").alias("first_visit"),
        F.count(F.lit(1)).alias("_n"),
    )
    # one address may be shared by very many people
    return attach(per, by_email, ["email"], "inner", weight="_n").drop("_n")


def segment_tests(
    as_of: dt.date, visits_above: int = 5, spend_above: int = 500, lapsed_days: int = 30, new_days: int = 7
) -> dict[str, Column]:
    tests = (
        F.col("visit_count") > visits_above,
        F.col("weekend"),
        F.col("total_spent") > spend_above,
        F.col("last_visit") < _days_ago(as_of, lapsed_days),
        F.col("first_visit") >= _days_ago(as_of, new_days),
    )
    return dict(zip(SEGMENTS, tests))


def labelled_customers(visits: DataFrame, as_of: dt.date, **thresholds) -> DataFrame:
    """Every label a person carries; people without a label are left out."""
    tests = segment_tests(as_of, **thresholds)
    labels = F.filter(
        F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]), lambda x: x.isNotNull()
    )
    return (
        person_facts(visits)
        .withColumn("labels", labels)
        .where(F.size("labels") > 0)
        .select(*PERSON, "total_spent", "visit_count", "last_visit", F.array_join("labels", ", ").alias("type"))
    )


def customers_of_segment(visits: DataFrame, segment: str, as_of: dt.date, **thresholds) -> DataFrame:
    """People of one segment. For weekend visitors only the weekend visits are added up."""
    if segment not in SEGMENTS:
        raise ValueError(f"unknown segment: {segment}")
    if segment == "Weekend visitor":
        chosen = reachable(visits).where(weekend("visit_date"))
        out = chosen.groupBy(*PERSON).agg(
            F.sum(F.col("paid_amount").cast(MONEY)).alias("total_spent"),
            F.count(F.lit(1)).alias("visit_count"),
            F.max("visit_date").alias("last_visit"),
        )
    else:
        test = segment_tests(as_of, **thresholds)[segment]
        out = person_facts(visits).where(test).drop("weekend", "first_visit")
    return out.withColumn("type", F.lit(segment))


def target_list(visits: DataFrame, segment: str, as_of: dt.date, **thresholds) -> DataFrame:
    return customers_of_segment(visits, segment, as_of, **thresholds).select(*PERSON)


def delivery_outcome(log: DataFrame) -> DataFrame:
    """Sent and failed messages per campaign and the delivery rate in percent."""
    sent = F.count_if(F.col("status") == "sent")
    n = F.count(F.lit(1))
    return log.groupBy("campaign_id").agg(
        n.alias("targets"), sent.alias("sent"), (n - sent).alias("failed"),
        (ratio(sent, n, 0.0) * 100).alias("delivery_rate"),
    )


def campaigns_by_state(campaigns: DataFrame, as_of) -> DataFrame:
    """Scheduled, due, submitted or draft."""
    state = (
        F.when(F.col("submitted_at").isNotNull(), "submitted")
        .when(F.col("scheduled_at") > F.lit(as_of), "scheduled")
        .when(F.col("scheduled_at").isNotNull(), "due")
        .otherwise("draft")
    )
    return campaigns.withColumn("state", state)


def library(content: DataFrame, kind: str) -> DataFrame:
    """Library rows whose content type contains the word, any case."""
    return content.where(F.col("content_type").ilike(f"%{kind}%"))
