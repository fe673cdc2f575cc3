"""Subscriptions and metered usage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brigade.functions.numbers import ratio
from brigade.operators.spread import attach, running

# Metering settings.
TOKENS_PER_ENGAGEMENT = 600
ALERT_SHARE = 0.9
TOKEN_COST_PER_1K = 0.002
DEFAULT_LIMIT = 10_000
LIMITED = ("ai_engagements", "restaurants", "integrations")


def people(managers: DataFrame, users: DataFrame) -> DataFrame:
    """Managers and users as one list without repeats."""
    columns = ["id", "email", "full_name"]
    return managers.select(*columns).union(users.select(*columns)).distinct()


def with_weighted(rows: DataFrame, known: DataFrame, key: str, how: str) -> DataFrame:
    """Rows with what is known of their key; a plan, subscription or user with very many rows is fanned out."""
    uses = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return attach(rows, known.join(uses, key), [key], how, weight="_n").drop("_n")


def usage_detail(
    usage: DataFrame, subscriptions: DataFrame, plans: DataFrame, managers: DataFrame, users: DataFrame
) -> DataFrame:
    """Usage rows of active subscriptions with plan, limit, name and e-mail."""
    active = subscriptions.where("is_active").select(
        F.col("id").alias("subscription_id"), "plan_id", "is_trial", "max_engagements_override"
    )
    plan = plans.select(F.col("id").alias("plan_id"), F.col("name").alias("plan_name"), "max_ai_engagements")
    m = managers.select(F.col("id").alias("user_id"), F.col("email").alias("m_email"), F.col("full_name").alias("m_name"))
    u = users.select(F.col("id").alias("user_id"), F.col("email").alias("u_email"), F.col("full_name").alias("u_name"))
    with_plan = with_weighted(usage, with_weighted(active, plan, "plan_id", "inner"), "subscription_id", "inner")
    return (
        with_weighted(with_plan, m.join(u, "user_id", "full"), "user_id", "left")
        .select(
            "user_id", "subscription_id", "plan_name", "tokens_used", "engagements_used",
            F.coalesce("max_engagements_override", "max_ai_engagements").alias("max_engagements"),
            "is_trial", "cycle_start", "cycle_end",
            F.coalesce("m_email", "u_email").alias("email"),
            F.coalesce("m_name", "u_name").alias("full_name"),
        )
    )


def usage_by_plan(detail: DataFrame, cost_per_1k: float = TOKEN_COST_PER_1K) -> DataFrame:
    """Users, tokens, engagements and cost per plan; the row without a plan is the total."""
    per_user = detail.groupBy("plan_name", "user_id").agg(
        F.sum("tokens_used").alias("tokens"), F.sum("engagements_used").alias("engagements")
    )
    per_plan = per_user.groupBy("plan_name").agg(
        F.count(F.lit(1)).alias("users"), F.sum("tokens").alias("tokens"), F.sum("engagements").alias("engagements")
    )
    both = per_plan.rollup("plan_name").agg(
        F.sum("users").alias("users"), F.sum("tokens").alias("tokens"), F.sum("engagements").alias("engagements")
    )
    return both.withColumn("cost", F.col("tokens") / F.lit(1000.0) * F.lit(cost_per_1k))


def usage_between(usage: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return usage.where((F.col("cycle_start") >= F.lit(start)) & (F.col("cycle_end") <= F.lit(end)))


def current_usage(usage: DataFrame, subscriptions: DataFrame, plans: DataFrame, as_of: dt.date) -> DataFrame:
    """Share of the limit used in the cycle that holds as_of."""
    now = usage.where(F.lit(as_of).between(F.col("cycle_start"), F.col("cycle_end")))
    s = subscriptions.select(F.col("id").alias("subscription_id"), "plan_id", "max_engagements_override")
    p = plans.select(F.col("id").alias("plan_id"), "max_ai_engagements")
    limit = F.coalesce("max_engagements_override", "max_ai_engagements", F.lit(DEFAULT_LIMIT))
    with_plan = with_weighted(now, with_weighted(s, p, "plan_id", "left"), "subscription_id", "inner")
    return with_plan.select(
        "user_id", "subscription_id", "tokens_used", "engagements_used", limit.alias("max_engagements"),
        ratio("engagements_used", limit, 0.0).alias("share_used"),
    )


def engagement_history(log: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    day = F.to_date("ts")
    return log.where(day.between(F.lit(start), F.lit(end))).groupBy(day.alias("day"), "type").agg(
        F.count(F.lit(1)).alias("engagements"), F.sum("tokens").alias("tokens")
    )


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page in a fixed order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def limit_checks(counts: DataFrame, subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Used against allowed for each limited kind; wants (user_id, usage_type, usage_count)."""
    limits = plans.unpivot(
        ["id"], [f"max_{k}" for k in LIMITED], "usage_type", "usage_limit"
    ).select(F.col("id").alias("plan_id"), F.regexp_replace("usage_type", "^max_", "").alias("usage_type"), "usage_limit")
    active = subscriptions.where("is_active").select("user_id", "plan_id")
    per_kind = with_weighted(active, limits, "plan_id", "inner")
    return per_kind.join(counts, ["user_id", "usage_type"], "left").select(
        "user_id", "usage_type", "usage_limit",
        F.coalesce("usage_count", F.lit(0)).alias("current_usage"),
        F.coalesce(F.col("usage_count") >= F.col("usage_limit"), F.lit(False)).alias("limit_exceeded"),
    )


def trial_states(subscriptions: DataFrame, as_of: dt.date, last_days: int = 1, reminder_days: int = 3) -> DataFrame:
    """Trials that are over, end within a day, or are due a reminder; with the days left."""
    left = F.date_diff(F.col("trial_end_date"), F.lit(as_of))
    state = (
        F.when(F.col("days_left") < 0, "expired")
        .when(F.col("days_left") <= last_days, "ending")
        .when(F.col("days_left") <= reminder_days, "reminder")
    )
    return (
        subscriptions.where(F.col("is_trial") & F.col("is_active"))
        .withColumn("days_left", left)
        .withColumn("state", state)
        .where(F.col("state").isNotNull())
        .select("id", "user_id", "trial_end_date", "days_left", "state")
    )


def due_renewals(subscriptions: DataFrame, plans: DataFrame, as_of: dt.date) -> DataFrame:
    """Subscriptions to renew now and their next end: 30 days, or 365 for yearly ones."""
    due = subscriptions.where(
        F.col("is_active") & ~F.col("is_trial") & F.col("auto_renew") & (F.col("end_date") <= F.lit(as_of))
    )
    p = plans.select(F.col("id").alias("plan_id"), "price")
    days = F.when(F.col("is_yearly"), 365).otherwise(30)
    return due.join(p, "plan_id").select(
        "id", "user_id", "price", "end_date", F.date_add("end_date", days).alias("next_end_date")
    )


def with_manager(rows: DataFrame, managers: DataFrame) -> DataFrame:
    """The manager's name and e-mail beside each row of a user; users who are none stay."""
    m = managers.select(F.col("id").alias("user_id"), F.col("email"), F.col("full_name"))
    return rows.join(m, "user_id", "left")


def accumulated(log: DataFrame) -> DataFrame:
    """Usage per user, subscription and kind from the event log."""
    return log.groupBy("user_id", "subscription_id", "usage_type").agg(F.sum("amount").alias("usage_count"))


def subscription_history(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    p = plans.select(F.col("id").alias("plan_id"), F.col("name").alias("plan_name"), "price")
    return subscriptions.join(p, "plan_id").select(
        "id", "user_id", "plan_name", "price", "is_active", "is_trial", "end_date"
    )


def all_subscriptions(
    subscriptions: DataFrame, plans: DataFrame, managers: DataFrame, users: DataFrame, active_only: bool = False
) -> DataFrame:
    base = subscription_history(subscriptions.where("is_active") if active_only else subscriptions, plans)
    m = managers.select(F.col("id").alias("user_id"), F.col("email").alias("m_email"), F.col("full_name").alias("m_name"))
    u = users.select(F.col("id").alias("user_id"), F.col("email").alias("u_email"), F.col("full_name").alias("u_name"))
    return base.join(m, "user_id", "left").join(u, "user_id", "left").select(
        *base.columns,
        F.coalesce("m_email", "u_email").alias("email"), F.coalesce("m_name", "u_name").alias("full_name"),
    )


def with_default_limit(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows of users with their limit; users without one have DEFAULT_LIMIT."""
    known = limits.select("user_id", "max_engagements")
    return rows.join(known, "user_id", "left").fillna(DEFAULT_LIMIT, ["max_engagements"])


def metered(
    log: DataFrame, limits: DataFrame, tokens: int = TOKENS_PER_ENGAGEMENT, alert_share: float = ALERT_SHARE
) -> DataFrame:
    """Replay of the usage counter: each engagement counts one until the limit, later ones are rejected.

    ``log``: engagement_id, user_id, cycle_start, ts. ``limits``: user_id, max_engagements. The counter
    is a distributed running count, so one busy user does not end up in one task.
    """
    numbered = running(log, ["user_id", "cycle_start"], [F.col("ts"), F.col("engagement_id")], rank="nth")
    sizes = log.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    bounded = with_default_limit(sizes, limits)
    with_limit = attach(numbered, bounded, ["user_id"], "inner", weight="_n").drop("_n")
    accepted = F.col("nth") <= F.col("max_engagements")
    share = ratio(F.least("nth", "max_engagements"), "max_engagements", 0.0)
    before = ratio(F.col("nth") - 1, "max_engagements", 0.0)
    return with_limit.select(
        "engagement_id", "user_id", "cycle_start",
        F.least(F.col("nth"), F.col("max_engagements")).cast("long").alias("engagements_used"),
        (F.least(F.col("nth"), F.col("max_engagements")) * tokens).cast("long").alias("tokens_used"),
        accepted.alias("accepted"),
        share.alias("share_used"),
        (accepted & (share >= alert_share) & (before < alert_share)).alias("alert"),
    )


def cycle_counters(log: DataFrame, limits: DataFrame, tokens: int = TOKENS_PER_ENGAGEMENT) -> DataFrame:
    """Counters per user and cycle: a new cycle starts at zero."""
    counts = log.groupBy("user_id", "cycle_start").agg(F.count(F.lit(1)).alias("_n"))
    used = F.least(F.col("_n"), F.col("max_engagements")).cast("long")
    return with_default_limit(counts, limits).select(
        "user_id", "cycle_start", used.alias("engagements_used"), (used * tokens).alias("tokens_used")
    )
