"""Revenue, profit and discount reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countinghouse.functions.dates import month_of, weekday_name, weekday_number
from countinghouse.functions.numbers import average, money
from countinghouse.operators.measures import (
    Tables,
    category_allocation,
    change_percent,
    discount_allocation,
    sale_net_revenue,
    sale_source,
    transaction_totals,
    with_previous,
)

TOP = 20


def _sum(column: str, name: str | None = None) -> Column:
    return money(F.sum(column)).alias(name or column)


def _count(name: str = "transaction_count") -> Column:
    return F.count(F.lit(1)).alias(name)


ATV = "average_transaction_value"


def _mean_value() -> Column:
    return average(F.sum("net_revenue"), F.count("net_revenue")).alias(ATV)


def kpis(t: Tables) -> DataFrame:
    return transaction_totals(t).agg(
        _count("total_transactions"),
        F.sum("units_sold").alias("total_units_sold"),
        _sum("gross_revenue"),
        _sum("discount_amount", "total_discounts"),
        _sum("net_revenue"),
        _mean_value(),
        _sum("estimated_net_profit"),
    )


def monthly(t: Tables) -> DataFrame:
    return transaction_totals(t, "sales_month").groupBy("sales_month").agg(
        _count(),
        F.sum("units_sold").alias("units_sold"),
        _sum("gross_revenue"),
        _sum("discount_amount", "total_discounts"),
        _sum("net_revenue"),
        _sum("estimated_net_profit"),
    ).orderBy("sales_month")


def monthly_revenue(t: Tables) -> DataFrame:
    """Exact net revenue per month with sales."""
    return sale_net_revenue(t, "sales_month").groupBy("sales_month").agg(
        F.sum("net_revenue").alias("net_revenue")
    )


def month_growth(t: Tables) -> DataFrame:
    months = with_previous(
        monthly_revenue(t), "net_revenue", "previous_month_revenue", "sales_month"
    )
    return months.select(
        "sales_month",
        money(F.col("net_revenue")).alias("net_revenue"),
        money(F.col("previous_month_revenue")).alias("previous_month_revenue"),
        change_percent("net_revenue", "previous_month_revenue").alias("monthly_growth_percentage"),
    ).orderBy("sales_month")


def _after_discount() -> list[Column]:
    """A line without an allocation counts in gross revenue only."""
    share = F.col("allocated_discount")
    return [
        F.sum("quantity").alias("units_sold"),
        _sum("line_revenue", "gross_revenue"),
        money(F.round(F.sum(share), 2)).alias("allocated_discounts"),
        money(F.round(F.sum(F.col("line_revenue") - share), 2)).alias("net_revenue"),
        money(F.round(F.sum(F.col("line_profit") - share), 2)).alias("estimated_net_profit"),
    ]


def by_category(t: Tables) -> DataFrame:
    return category_allocation(t).groupBy("category").agg(_count(), *_after_discount()).orderBy(
        F.desc("net_revenue")
    )


def top_products(t: Tables, top: int = TOP) -> DataFrame:
    """Names are looked up for the chosen products only."""
    best = (
        discount_allocation(t)
        .groupBy("product_id")
        .agg(_count(), *_after_discount())
        .drop("gross_revenue", "allocated_discounts")
        .orderBy(F.desc_nulls_first("net_revenue"), "product_id")
        .limit(top)
    )
    names = t["products"].select("product_id", "product_name", "category")
    return names.join(best, "product_id").orderBy(
        F.desc_nulls_first("net_revenue"), "product_id"
    )


def by_payment(t: Tables) -> DataFrame:
    return transaction_totals(t, "payment_method").groupBy("payment_method").agg(
        _count(),
        F.sum("units_sold").alias("units_sold"),
        _sum("gross_revenue"),
        _sum("discount_amount", "total_discounts"),
        _sum("net_revenue"),
        _mean_value(),
        _sum("estimated_net_profit"),
    ).orderBy(F.desc("net_revenue"))


def by_weekday(t: Tables) -> DataFrame:
    day = weekday_number(F.col("sale_date"))
    totals = sale_net_revenue(t, "sale_date").groupBy(day.alias("day_number")).agg(
        _count(), _sum("net_revenue"), _mean_value()
    )
    return totals.withColumn("day_name", weekday_name(F.col("day_number"))).orderBy("day_number")


def discounted_vs_not(t: Tables) -> DataFrame:
    status = F.when(F.col("discount_amount") > 0, "Discounted").otherwise("No Discount")
    return sale_net_revenue(t).groupBy(status.alias("discount_status")).agg(
        _count(),
        _sum("gross_revenue"),
        _sum("discount_amount", "total_discounts"),
        _sum("net_revenue"),
        _mean_value(),
    ).orderBy(F.desc("net_revenue"))


def sales_in_range(t: Tables, first: str, until: str) -> DataFrame:
    """Gross revenue of each sale in the half-open interval ``[first, until)``."""
    moment = F.col("sale_date")
    start, end = F.lit(first).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")
    where = (moment >= start) & (moment < end)
    months = F.col("sales_month").between(month_of(start), month_of(end))
    if "sales_month" in sale_source(t).columns:  # stored by month: read only those that overlap
        where &= months
    return sale_net_revenue(t, "sale_date", "branch_id", where=where, months=months).select(
        "sale_id", "sale_date", "branch_id", money(F.col("gross_revenue")).alias("gross_revenue")
    )
