"""Customer value, activity and recency-frequency-value segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countinghouse.functions.dates import days_between, month_of
from countinghouse.functions.numbers import average, money, percent
from countinghouse.functions.selection import cuts, tile_ends, tile_of
from countinghouse.operators.measures import (
    Tables,
    reference_date,
    registered_sales,
    sale_net_revenue,
    share_of_total,
)
from countinghouse.session import stored

TOP = 20
INACTIVE_AFTER_DAYS = 180


def customer_totals(t: Tables) -> DataFrame:
    """One row per customer with a purchase."""
    registered = F.col("customer_id").isNotNull()
    sales = sale_net_revenue(t, "customer_id", "sale_day", where=registered)
    return sales.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("purchase_count"),
        F.min("sale_day").alias("first_purchase_date"),
        F.max("sale_day").alias("last_purchase_date"),
        F.sum("net_revenue").alias("spent"),
    )


def _named(t: Tables) -> DataFrame:
    return t["customers"].select(
        "customer_id", "customer_name", F.coalesce("city", F.lit("Unknown")).alias("city")
    )


def kpis(t: Tables) -> DataFrame:
    count = F.col("purchase_count")
    totals = customer_totals(t).agg(
        F.count(F.lit(1)).alias("customers_with_purchases"),
        F.count_if(count == 1).alias("one_time_customers"),
        F.count_if(count > 1).alias("repeat_customers"),
        F.sum("spent").alias("spent"),
    )
    everyone = F.col("customers_with_purchases")
    return totals.select(
        "customers_with_purchases", "one_time_customers", "repeat_customers",
        percent(F.col("repeat_customers"), everyone).alias("repeat_customer_percentage"),
        average(F.col("spent"), everyone).alias("average_customer_value"),
        money(F.col("spent")).alias("registered_customer_revenue"),
    )


def _by_spending(t: Tables, days_name: str) -> DataFrame:
    today = reference_date(t).scalar()
    return (
        customer_totals(t)
        .withColumn(days_name, days_between(today, F.col("last_purchase_date")))
        .join(_named(t), "customer_id")
    )


def top_customers(t: Tables, top: int = TOP) -> DataFrame:
    return (
        _by_spending(t, "days_since_last_purchase")
        .orderBy(F.desc("spent"), "customer_id")
        .limit(top)
        .select(
            "customer_id", "customer_name", "city", "purchase_count", "last_purchase_date",
            "days_since_last_purchase",
            money(F.col("spent")).alias("total_spent"),
            average(F.col("spent"), F.col("purchase_count")).alias("average_transaction_value"),
        )
    )


def valuable_inactive(t: Tables, top: int = TOP) -> DataFrame:
    return (
        _by_spending(t, "days_inactive")
        .filter(F.col("days_inactive") > INACTIVE_AFTER_DAYS)
        .orderBy(F.desc("spent"), "customer_id")
        .limit(top)
        .select(
            "customer_id", "customer_name", "city", "purchase_count", "last_purchase_date",
            "days_inactive", money(F.col("spent")).alias("total_spent"),
        )
    )


def frequency_groups(t: Tables) -> DataFrame:
    """Counts sales whether or not they have items."""
    count = F.col("purchase_count")
    group = (
        F.when(count == 1, "One-time Customer")
        .when(count.between(2, 5), "Occasional Customer")
        .when(count.between(6, 10), "Regular Customer")
        .otherwise("Frequent Customer")
    )
    return (
        registered_sales(t)
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("purchase_count"))
        .groupBy(group.alias("customer_group"))
        .agg(F.count(F.lit(1)).alias("customer_count"))
        .orderBy(F.desc("customer_count"))
    )


def city_revenue(t: Tables) -> DataFrame:
    totals = customer_totals(t).join(_named(t), "customer_id").groupBy("city").agg(
        F.count(F.lit(1)).alias("purchasing_customers"),
        F.sum("purchase_count").alias("transaction_count"),
        F.sum("spent").alias("spent"),
    )
    return totals.select(
        "city", "purchasing_customers", "transaction_count",
        money(F.col("spent")).alias("net_revenue"),
        average(F.col("spent"), F.col("transaction_count")).alias("average_transaction_value"),
    ).orderBy(F.desc("net_revenue"))


def new_vs_returning(t: Tables) -> DataFrame:
    """The window spans one customer's active months, which are few by nature."""
    month, first = F.col("sales_month"), F.col("first_month")
    active = (
        registered_sales(t)
        .select("customer_id", month_of(F.col("sale_date")).alias("sales_month"))
        .distinct()
        .withColumn("first_month", F.min("sales_month").over(Window.partitionBy("customer_id")))
    )
    return active.groupBy("sales_month").agg(
        F.count_if(month == first).alias("new_customers"),
        F.count_if(month > first).alias("returning_customers"),
        F.count(F.lit(1)).alias("active_customers"),
    ).orderBy("sales_month")


def _score_keys() -> dict[str, Column]:
    """What each score orders customers by, the best last, as whole numbers."""
    return {
        "recency_score": -F.col("recency_days").cast("bigint"),
        "frequency_score": F.col("frequency"),
        "monetary_score": (F.col("monetary") * 100).cast("bigint"),
    }


_SCORES = ("recency_score", "frequency_score", "monetary_score")


def rfm_scores(t: Tables, tiles: int = 5) -> DataFrame:
    """Per purchasing customer: the three measures and their quintiles, 5 the best.

    The customers that end the quintiles are found by narrowing; every other customer is
    only compared with them. Ties are broken by customer id. Scores come before any look at
    the customer table, so a customer unknown there still takes up a place.
    """
    today = reference_date(t, plus_days=1).scalar()
    measures = stored(
        customer_totals(t).select(
            "customer_id",
            days_between(today, F.col("last_purchase_date")).alias("recency_days"),
            F.col("purchase_count").alias("frequency"),
            F.col("spent").alias("monetary"),
        ),
        "customer-measures",
    )
    keys, count = _score_keys(), measures.count()
    ends = cuts(measures, keys, "customer_id", tile_ends(count, tiles), count)
    return measures.withColumns(
        {name: tile_of(key, "customer_id", ends[name]) for name, key in keys.items()}
    )


# The segments and their rules; the first rule that holds counts.
SEGMENT_RULES = [
    ("Champions", "recency_score >= 4 AND frequency_score >= 4 AND monetary_score >= 4"),
    ("At Risk", "recency_score <= 2 AND frequency_score >= 3"),
    ("New Customers", "recency_score >= 4 AND frequency = 1"),
    ("Loyal Customers", "frequency_score >= 4 AND monetary_score >= 3"),
    ("Potential Loyalists", "recency_score >= 4 AND frequency_score BETWEEN 2 AND 3"),
    ("Hibernating", "recency_score <= 2 AND frequency_score <= 2"),
]
OTHER_SEGMENT = "Needs Attention"


def segment() -> Column:
    rules = [F.when(F.expr(rule), name) for name, rule in SEGMENT_RULES]
    return F.coalesce(*rules, F.lit(OTHER_SEGMENT))


def rfm(t: Tables) -> DataFrame:
    return rfm_scores(t).join(_named(t), "customer_id").select(
        "customer_id", "customer_name", "city", "recency_days", "frequency",
        money(F.col("monetary")).alias("monetary_value"), *_SCORES,
    ).orderBy(F.desc("monetary_score"), F.desc("frequency_score"), F.desc("recency_score"), "customer_id")


def rfm_segments(t: Tables) -> DataFrame:
    groups = rfm_scores(t).groupBy(segment().alias("customer_segment")).agg(
        F.count(F.lit(1)).alias("customer_count"), F.sum("monetary").alias("spent")
    )
    return share_of_total(groups, "customer_count", "customer_percentage").select(
        "customer_segment", "customer_count", "customer_percentage",
        money(F.col("spent")).alias("segment_revenue"),
        average(F.col("spent"), F.col("customer_count")).alias("average_customer_value"),
    ).orderBy(F.desc("segment_revenue"))


def customer_segments(t: Tables) -> DataFrame:
    return rfm_scores(t).join(_named(t), "customer_id").select(
        "customer_id", "customer_name", "city", "recency_days", "frequency",
        money(F.col("monetary")).alias("monetary_value"), *_SCORES,
        segment().alias("customer_segment"),
    )
