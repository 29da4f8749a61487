"""Branches and employees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countinghouse.functions.numbers import average, money, or_zero, percent
from countinghouse.functions.ordering import with_rank
from countinghouse.operators.measures import (
    Tables,
    change_percent,
    employee_net,
    sale_net_revenue,
    transaction_totals,
    with_previous,
)
from countinghouse.session import stored


def _branch_totals(t: Tables) -> DataFrame:
    return transaction_totals(t, "branch_id", "customer_id").groupBy("branch_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("customer_id").alias("customers"),
        F.sum("units_sold").alias("units"),
        F.sum("gross_revenue").alias("gross"),
        F.sum("discount_amount").alias("discounts"),
        F.sum("net_revenue").alias("net"),
        F.sum("estimated_net_profit").alias("profit"),
    )


def _branch_names(t: Tables) -> DataFrame:
    return t["branches"].select("branch_id", "branch_name", "city")


def branch_performance_detail(t: Tables) -> DataFrame:
    """Branches without sales keep NULL amounts."""
    return _branch_names(t).join(_branch_totals(t), "branch_id", "left").select(
        "branch_id", "branch_name", "city",
        or_zero(F.col("n")).alias("transaction_count"),
        or_zero(F.col("customers")).alias("registered_customers"),
        F.col("units").alias("units_sold"),
        money(F.col("gross")).alias("gross_revenue"),
        money(F.col("discounts")).alias("total_discounts"),
        money(F.col("net")).alias("net_revenue"),
        average(F.col("net"), F.col("n")).alias("average_transaction_value"),
        money(F.col("profit")).alias("estimated_net_profit"),
    ).orderBy(F.desc_nulls_last("net_revenue"))


def branch_performance(t: Tables) -> DataFrame:
    """Branches without sales show zeros."""
    return _branch_names(t).join(_branch_totals(t), "branch_id", "left").select(
        "branch_id", "branch_name", "city",
        or_zero(F.col("n")).alias("transaction_count"),
        or_zero(F.col("customers")).alias("registered_customers"),
        or_zero(F.col("units")).alias("units_sold"),
        money(or_zero(F.col("net"))).alias("net_revenue"),
        or_zero(average(F.col("net"), F.col("n"))).alias("average_transaction_value"),
        money(or_zero(F.col("profit"))).alias("estimated_net_profit"),
    )


def branch_rankings(t: Tables) -> DataFrame:
    """The windows run over one row per branch."""
    totals = sale_net_revenue(t, "branch_id").groupBy("branch_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("net_revenue").alias("net")
    )
    branches = _branch_names(t).join(totals, "branch_id", "left").select(
        "branch_id", "branch_name", "city",
        or_zero(F.col("n")).alias("transaction_count"), or_zero(F.col("net")).alias("net"),
    )
    return branches.select(
        "branch_id", "branch_name", "city", "transaction_count",
        money(F.col("net")).alias("net_revenue"),
        F.rank().over(Window.orderBy(F.desc("net"))).alias("revenue_rank"),
        F.rank().over(Window.orderBy(F.desc("transaction_count"))).alias("transaction_rank"),
    ).orderBy("revenue_rank")


def _employees(t: Tables, *columns: str) -> DataFrame:
    branches = t["branches"].select("branch_id", "branch_name")
    chosen = t["employees"].select("employee_id", "employee_name", "branch_id", *columns)
    return chosen.join(branches, "branch_id")


def employee_performance(t: Tables) -> DataFrame:
    totals = employee_net(t).groupBy("employee_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("units_sold").alias("units"),
        F.sum("net_revenue").alias("net"),
        F.sum("estimated_net_profit").alias("profit"),
    )
    return _employees(t, "job_title", "monthly_target").join(totals, "employee_id", "left").select(
        "employee_id", "employee_name", "job_title", "branch_id", "branch_name",
        money(F.col("monthly_target")).alias("monthly_target"),
        or_zero(F.col("n")).alias("transaction_count"),
        or_zero(F.col("units")).alias("units_sold"),
        money(or_zero(F.col("net"))).alias("net_revenue"),
        or_zero(average(F.col("net"), F.col("n"))).alias("average_transaction_value"),
        money(or_zero(F.col("profit"))).alias("estimated_net_profit"),
    )


def employee_performance_detail(t: Tables) -> DataFrame:
    return (
        employee_performance(t).drop("branch_id", "monthly_target").orderBy(
            F.desc("net_revenue"), "employee_id"
        )
    )


def employee_rankings(t: Tables) -> DataFrame:
    totals = sale_net_revenue(t, "employee_id").groupBy("employee_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("net_revenue").alias("net")
    )
    people = _employees(t, "job_title").join(totals, "employee_id", "left").select(
        "employee_id", "employee_name", "job_title", "branch_id", "branch_name",
        or_zero(F.col("n")).alias("transaction_count"), or_zero(F.col("net")).alias("net"),
    )
    people = stored(people, "employee-totals")
    ranked = with_rank(people, "net", "rank_within_branch", by=["branch_id"])
    ranked = with_rank(ranked, "net", "overall_rank")
    return ranked.select(
        "employee_id", "employee_name", "job_title", "branch_name", "transaction_count",
        money(F.col("net")).alias("net_revenue"), "rank_within_branch", "overall_rank",
    ).orderBy("overall_rank", "employee_id")


def _employee_months(t: Tables) -> DataFrame:
    months = sale_net_revenue(t, "employee_id", "sales_month").groupBy(
        "employee_id", "sales_month"
    ).agg(F.count(F.lit(1)).alias("transaction_count"), F.sum("net_revenue").alias("net"))
    return _employees(t, "monthly_target").join(months, "employee_id")


def employee_monthly_target(t: Tables) -> DataFrame:
    net, target = F.col("net"), F.col("monthly_target")
    status = F.when(net >= target, "Target Achieved").otherwise("Below Target")
    return _employee_months(t).select(
        "employee_id", "employee_name", "branch_name", "sales_month", "transaction_count",
        money(target).alias("monthly_target"),
        money(net).alias("monthly_net_revenue"),
        percent(net, target).alias("target_achievement_percentage"),
        status.alias("target_status"),
    ).orderBy("sales_month", F.desc_nulls_first("target_achievement_percentage"), "employee_id")


def employee_target_summary(t: Tables) -> DataFrame:
    """The achievement is the mean of the monthly percentages, unrounded until the end."""
    net, target = F.col("net"), F.col("monthly_target")
    achieved = net.cast("decimal(20,2)") / F.nullif(target, F.lit(0).cast("decimal(12,2)"))
    months, met = F.col("active_sales_months"), F.col("months_target_achieved")
    return (
        _employee_months(t)
        .withColumn("achieved", (achieved * 100).cast("decimal(28,12)"))
        .groupBy("employee_id", "employee_name", "branch_name")
        .agg(
            F.count(F.lit(1)).alias("active_sales_months"),
            F.count_if(net >= target).alias("months_target_achieved"),
            F.round(F.avg("achieved"), 2).cast("double").alias(
                "average_target_achievement_percentage"
            ),
        )
        .withColumn("target_success_rate_percentage", percent(met, months))
        .orderBy(F.desc("target_success_rate_percentage"), "employee_id")
    )


def branch_months(t: Tables) -> DataFrame:
    return sale_net_revenue(t, "branch_id", "sales_month").groupBy("branch_id", "sales_month").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.sum("net_revenue").alias("net")
    )


def branch_monthly_growth(t: Tables) -> DataFrame:
    months = with_previous(branch_months(t), "net", "before", "sales_month", "branch_id")
    names = t["branches"].select("branch_id", "branch_name")
    return months.join(names, "branch_id").select(
        "branch_name", "sales_month", "transaction_count",
        money(F.col("net")).alias("net_revenue"),
        money(F.col("before")).alias("previous_month_revenue"),
        change_percent("net", "before").alias("monthly_growth_percentage"),
    ).orderBy("branch_name", "sales_month")


def monthly_branch_share(t: Tables) -> DataFrame:
    """The windows span one month's branches."""
    net = F.col("net")
    month = Window.partitionBy("sales_month")
    names = t["branches"].select("branch_id", "branch_name")
    shares = branch_months(t).join(names, "branch_id").select(
        "sales_month", "branch_name", "transaction_count", "net",
        F.sum("net").over(month).alias("month_net"),
        F.rank().over(month.orderBy(F.desc("net"))).alias("monthly_branch_rank"),
    )
    return shares.select(
        "sales_month", "branch_name", "transaction_count",
        money(net).alias("net_revenue"),
        percent(net, F.col("month_net")).alias("monthly_revenue_share_percentage"),
        "monthly_branch_rank",
    ).orderBy("sales_month", "monthly_branch_rank")
