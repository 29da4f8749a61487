"""Trends, ranks and contribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countinghouse.functions.dates import month_of
from countinghouse.functions.numbers import average, money, percent, percent_change, revenue
from countinghouse.functions.ordering import with_rank, with_running_total
from countinghouse.operators.measures import Tables, with_previous
from countinghouse.plans.sales import monthly_revenue
from countinghouse.session import stored

PARETO_PERCENT = 80


def cumulative_rolling(t: Tables) -> DataFrame:
    """The windows run over months, of which there are few."""
    by_month = Window.orderBy("sales_month")
    so_far = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last_three = by_month.rowsBetween(-2, Window.currentRow)
    net = F.sum("net_revenue")
    months = monthly_revenue(t).select(
        "sales_month", "net_revenue",
        net.over(so_far).alias("so_far"),
        net.over(last_three).alias("recent"),
        F.count("net_revenue").over(last_three).alias("recent_months"),
    )
    return months.select(
        "sales_month",
        money(F.col("net_revenue")).alias("monthly_net_revenue"),
        money(F.col("so_far")).alias("cumulative_net_revenue"),
        average(F.col("recent"), F.col("recent_months")).alias("three_month_rolling_average"),
    ).orderBy("sales_month")


def product_revenue(t: Tables) -> DataFrame:
    sold = t["sale_items"].groupBy("product_id").agg(
        F.sum("quantity").alias("units_sold"), F.sum(revenue()).alias("gross")
    )
    return t["products"].select("product_id", "product_name", "category").join(sold, "product_id")


def product_rank(t: Tables) -> DataFrame:
    products = stored(product_revenue(t), "product-revenue")
    totals = products.groupBy("category").agg(F.sum("gross").alias("category_gross"))
    ranked = with_rank(
        products, "gross", "revenue_rank_within_category", by=["category"], dense=True
    )
    return ranked.join(totals, "category").select(
        "product_id", "product_name", "category", "units_sold",
        money(F.col("gross")).alias("gross_revenue"), "revenue_rank_within_category",
        percent(F.col("gross"), F.col("category_gross")).alias("category_revenue_percentage"),
    ).orderBy("category", "revenue_rank_within_category", "product_id")


def pareto(t: Tables) -> DataFrame:
    order = [F.desc("gross"), F.asc("product_id")]
    running = with_running_total(product_revenue(t), order, "gross", "cumulative")
    total, upto = F.col("cumulative_all"), F.col("cumulative")
    within = upto * 100 <= total * PARETO_PERCENT
    return running.select(
        "product_id", "product_name", "category",
        money(F.col("gross")).alias("gross_revenue"),
        percent(F.col("gross"), total).alias("revenue_contribution_percentage"),
        percent(upto, total).alias("cumulative_revenue_percentage"),
        F.when((total != 0) & within, "Top Revenue Contributors")
        .otherwise("Remaining Products")
        .alias("pareto_group"),
    ).orderBy(F.desc("gross_revenue"), "product_id")


def gold_vs_sales(t: Tables, kind: str = "24K") -> DataFrame:
    """Months present in both series, each compared with the one before it."""
    chosen = t["gold_types"].filter(F.col("gold_type_name") == kind).select("gold_type_id")
    prices = (
        t["gold_prices"].join(chosen, "gold_type_id")
        .groupBy(month_of(F.col("price_date")).alias("sales_month"))
        .agg(F.sum("price_per_gram").alias("price_sum"), F.count("price_per_gram").alias("days"))
    )
    months = monthly_revenue(t).join(prices, "sales_month")
    for column in ("net_revenue", "price_sum", "days"):
        months = with_previous(months, column, f"previous_{column}", "sales_month")
    # change of the mean price, kept as one quotient of exact sums
    now = F.col("price_sum") * F.col("previous_days")
    before = F.col("previous_price_sum") * F.col("days")
    return months.select(
        "sales_month",
        average(F.col("price_sum"), F.col("days")).alias("average_24k_price_per_gram"),
        money(F.col("net_revenue")).alias("net_revenue"),
        percent_change(now, before).alias("gold_price_change_percentage"),
        percent_change(F.col("net_revenue"), F.col("previous_net_revenue")).alias(
            "revenue_change_percentage"
        ),
    ).orderBy("sales_month")
