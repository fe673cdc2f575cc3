"""Notification rows from anomaly, risk, cause and efficiency tables. Sending them is not done here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.functions.numbers import ratio
from brigade.operators.anomaly import EMPLOYEE_KIND, NIGHT_HOURS, SUSPECT_METHODS, method_shares
from brigade.operators.spread import attach, top_within

KEY = ["location_id"]

# Score bands, best first.
SCORE_BANDS = (("Excellent", 85.0), ("Good", 70.0), ("Average", 50.0))
LOWEST_BAND = "Needs Improvement"
EXAMPLES = 5


def alerts(rows: DataFrame, rule: str | Column, level: str, example: str, keep: int = 5, *by: str) -> DataFrame:
    """One row per location (and further keys): how many rows, and the first few as examples.

    Counts are combined map-side and only ``keep`` rows per group are ever gathered.
    """
    group = [*KEY, "rule", *by]
    ruled = rows.withColumn("rule", F.lit(rule) if isinstance(rule, str) else rule)
    counts = ruled.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    first = top_within(ruled.select(*group, F.col(example).cast("string").alias("_x")), group, [F.col("_x")], keep)
    examples = first.groupBy(*group).agg(F.sort_array(F.collect_list("_x")).alias("examples"))
    return counts.join(examples, group).withColumn("level", F.lit(level))


def anomaly_notices(anomalies: DataFrame, employee_at_least: int = 5) -> DataFrame:
    """A row per anomaly rule and severity; an employee only with several patterns."""
    parts = [
        alerts(anomalies.where(F.col("category") != EMPLOYEE_KIND), F.col("category"), "warning", "sale_id", 5, "severity")
        .withColumn("subject", F.lit(None).cast("string"))
        .withColumn("level", F.when((F.col("rule") == "high_value_transactions") & (F.col("severity") == "high"), "alert").otherwise("warning")),
    ]
    own = anomalies.where((F.col("category") == EMPLOYEE_KIND) & F.col("employee_id").isNotNull())
    per_employee = alerts(own, EMPLOYEE_KIND, "alert", "sale_id", 3, "employee_id")
    parts.append(
        per_employee.where(F.col("n") >= employee_at_least)
        .withColumn("subject", F.col("employee_id").cast("string"))
        .withColumn("severity", F.lit("high"))
    )
    columns = [*KEY, "rule", "level", "severity", "subject", "n", "examples"]
    return parts[0].select(*columns).unionByName(parts[1].select(*columns))


def off_hours_by_hour(anomalies: DataFrame) -> DataFrame:
    hit = anomalies.where(F.col("category") == "unusual_time_transactions")
    return hit.groupBy(*KEY, "hour").agg(F.count(F.lit(1)).alias("n"))


def payments_by_method(sales: DataFrame, below: float = 0.10) -> DataFrame:
    """Unusual payment methods with their number of sales, from the shares alone."""
    odd = (F.col("method_share") < below) | F.col("payment_method").isin(*SUSPECT_METHODS)
    return method_shares(sales).where(odd).select(*KEY, "payment_method", "n")


def risk_notices(risky: DataFrame, risky_employees: DataFrame) -> DataFrame:
    high = F.col("severity") == "high"
    return alerts(risky.where(high), "high_risk_transactions", "alert", "sale_id").unionByName(
        alerts(risky_employees.where(high), "high_risk_employees", "alert", "employee_id")
    )


def cause_notices(transaction_causes: DataFrame, employee_causes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Counts of explained transactions and employees per cause, and of time clusters."""
    def per_cause(df: DataFrame, rule: str) -> DataFrame:
        return df.select(*KEY, F.explode("causes").alias("cause")).groupBy(*KEY, "cause").agg(
            F.count(F.lit(1)).alias("n")
        ).select(*KEY, F.lit(rule).alias("rule"), F.lit("info").alias("level"), "cause", "n")

    timed = clusters.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).select(
        *KEY, F.lit("time_clusters").alias("rule"), F.lit("warning").alias("level"),
        F.lit(None).cast("string").alias("cause"), "n",
    )
    return (
        per_cause(transaction_causes, "transaction_causes")
        .unionByName(per_cause(employee_causes, "employee_causes"))
        .unionByName(timed)
    )


def slow_hours(velocity: DataFrame, below: int = 5) -> DataFrame:
    """Hours of the day with few transactions on some dates, nights left out."""
    low = velocity.where((F.col("transaction_count") < below) & ~F.col("hour").isin(*NIGHT_HOURS))
    n = F.count(F.lit(1))
    return low.groupBy(*KEY, "hour").agg(
        n.alias("slots"),
        ratio(F.sum("transaction_count"), n).alias("average_transactions"),
        ratio(F.sum("revenue"), n).alias("average_revenue"),
    )


def low_rates(rates: DataFrame, key: str, items_below: float = 1.5, revenue_below: float = 10.0) -> DataFrame:
    low = (F.col("items_per_transaction") < items_below) | (F.col("revenue_per_transaction") < revenue_below)
    return rates.where(low).select(*KEY, F.col(key).cast("string").alias("subject"))


def score_band(score: DataFrame) -> DataFrame:
    band = None
    for name, above in SCORE_BANDS:
        test = F.col("efficiency_score") > above
        band = F.when(test, name) if band is None else band.when(test, name)
    return score.where(F.col("efficiency_score") > 0).withColumn("band", band.otherwise(LOWEST_BAND))


def efficiency_notices(
    velocity: DataFrame, peaks: DataFrame, employees: DataFrame, turnover: DataFrame, order_types: DataFrame,
    peak_above: float = 80.0, turnover_below: float = 0.1, slow_below: int = 5,
) -> DataFrame:
    """A row per rule and location: how many subjects it concerns, and the first few of them by name."""
    def counted(df: DataFrame, rule: str, subject: str) -> DataFrame:
        named = df.select(*KEY, F.col(subject).cast("string").alias("_subject"))
        counts = named.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        first = top_within(named.distinct(), KEY, [F.col("_subject")], EXAMPLES, rank="_place").groupBy(*KEY).agg(
            F.array_join(F.sort_array(F.collect_list("_subject")), ", ").alias("examples"))
        return counts.join(first, KEY, "left").withColumn("rule", F.lit(rule))

    slow = velocity.where((F.col("transaction_count") < slow_below) & ~F.col("hour").isin(*NIGHT_HOURS))
    concentrated = peaks.where(F.col("peak_revenue_pct") > peak_above).withColumn("peak_hours", F.array_join("peak_hours", "|"))
    parts = [
        counted(slow, "low_sales_activity", "hour"),
        counted(concentrated, "peak_concentration", "peak_hours"),
        counted(low_rates(employees, "employee_id"), "employee_efficiency", "subject"),
        counted(turnover.where(F.col("turnover_ratio") < turnover_below), "low_turnover", "ingredient"),
        counted(low_rates(order_types, "order_type"), "order_type_efficiency", "subject"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def wanted(notices: DataFrame, settings: DataFrame) -> DataFrame:
    """Notices whose category the user has switched on; categories without a setting always pass.

    Wants user_id and category in both frames, and enabled in the settings.
    """
    off = settings.where(~F.col("enabled")).select("user_id", "category").distinct()
    sizes = notices.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("_n"))
    return attach(notices, off.join(sizes, ["user_id", "category"]), ["user_id", "category"], "left_anti", weight="_n")


def anomaly_breakdown(anomalies: DataFrame) -> DataFrame:
    """Counts by category, by severity and by hour, stacked."""
    def by(c: str) -> DataFrame:
        return anomalies.where(F.col(c).isNotNull()).groupBy(*KEY, F.col(c).cast("string").alias("value")).agg(
            F.count(F.lit(1)).alias("n")
        ).withColumn("breakdown", F.lit(c))

    return by("category").unionByName(by("severity")).unionByName(by("hour"))


def fraud_indicators(risky: DataFrame, patterns: DataFrame, employees: DataFrame) -> DataFrame:
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).withColumn("indicator", F.lit(name))

    return (
        counted(risky, "high_risk_transactions")
        .unionByName(counted(patterns, "suspicious_patterns"))
        .unionByName(counted(employees, "employee_risk_scores"))
        .unionByName(counted(employees.where(F.col("severity") == "high"), "high_risk_employees"))
    )


def insight_summary(anomalies: DataFrame, risky: DataFrame, score: DataFrame) -> DataFrame:
    """Headline counts and the efficiency score per location."""
    a = anomalies.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total_anomalies"))
    r = risky.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("risk_alerts"), F.count_if(F.col("severity") == "high").alias("high_risk_alerts")
    )
    return score.join(a, KEY, "left").join(r, KEY, "left").fillna(
        0, ["total_anomalies", "risk_alerts", "high_risk_alerts"]
    )
