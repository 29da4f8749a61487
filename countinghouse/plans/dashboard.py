"""Tables behind the dashboard pages.

Filtering, grouping and top-k stay in Spark; only the small result is shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countinghouse.functions.numbers import as_numbers, first_present
from countinghouse.operators.measures import Tables, share_of_total
from countinghouse.plans import views
from countinghouse.plans.customers import customer_segments
from countinghouse.plans.inventory import inventory_risk, product_performance
from countinghouse.plans.people import branch_performance, employee_performance

ALL_BRANCHES = "All Branches"
TOP = 10
SEGMENT_COLUMNS = ["customer_segment", "segment", "segment_name"]


def kpis(t: Tables) -> DataFrame:
    """Amounts in billions, the average transaction in millions."""
    return views.executive_summary(t).select(
        F.round(F.col("net_revenue") / 1e9, 2).alias("net_revenue_billions"),
        "total_transactions",
        F.round(F.col("estimated_net_profit") / 1e9, 2).alias("estimated_profit_billions"),
        F.round(F.col("average_transaction_value") / 1e6, 2).alias("average_transaction_millions"),
        "total_units_sold",
        "registered_customers",
    )


def monthly_trend(t: Tables) -> DataFrame:
    return views.monthly_sales_summary(t).select(
        F.col("sales_month").cast("timestamp_ntz").alias("sales_month"),
        "net_revenue", "estimated_net_profit", "transaction_count",
    ).orderBy("sales_month")


def branch_revenue(t: Tables) -> DataFrame:
    return branch_performance(t).select("branch_id", "branch_name", "net_revenue").orderBy(
        F.desc("net_revenue"), "branch_id"
    )


def _top(df: DataFrame, by: str, tie: str, top: int) -> DataFrame:
    """The ``top`` rows, smallest first for a horizontal bar chart."""
    return df.orderBy(F.desc(by), tie).limit(top).orderBy(by, F.desc(tie))


def top_customers(t: Tables, top: int = TOP) -> DataFrame:
    chosen = views.customer_summary(t).select("customer_id", "customer_name", "total_spent")
    return _top(chosen, "total_spent", "customer_id", top)


def _counts(df: DataFrame, by: str, rows: str) -> DataFrame:
    counted = df.groupBy(by).agg(F.count(F.lit(1)).alias(rows))
    return share_of_total(counted, rows, "percentage").orderBy(F.desc(rows), by)


def segment_counts(t: Tables) -> DataFrame:
    return _counts(customer_segments(t), "customer_segment", "customer_count")


def customer_table(t: Tables) -> DataFrame:
    return views.customer_summary(t).orderBy(F.desc("total_spent"), "customer_id").select(
        "customer_name", "city", "purchase_count", "total_spent", "average_transaction_value"
    )


def top_products(t: Tables, top: int = TOP) -> DataFrame:
    chosen = product_performance(t).select("product_id", "product_name", "gross_revenue")
    return _top(chosen, "gross_revenue", "product_id", top)


def category_revenue(t: Tables) -> DataFrame:
    """Summed as exact amounts, so the order of addition does not matter."""
    gross = F.col("gross_revenue").cast("decimal(38,2)")
    totals = product_performance(t).groupBy("category").agg(F.sum(gross).alias("gross"))
    shared = share_of_total(totals, "gross", "percentage")
    return shared.select(
        "category", F.col("gross").cast("double").alias("gross_revenue"), "percentage"
    ).orderBy(F.desc("gross_revenue"), "category")


def inventory_counts(t: Tables) -> DataFrame:
    return _counts(inventory_risk(t), "inventory_status", "inventory_record_count")


def inventory_table(t: Tables) -> DataFrame:
    ordered = inventory_risk(t).orderBy(
        "stock_quantity", "branch_name", "product_name", "inventory_id"
    )
    return ordered.select(
        "branch_name", "product_name", "category", "stock_quantity", "reorder_level",
        "inventory_status",
    )


def branch_options(t: Tables) -> DataFrame:
    """The choice of all branches, then the names in order."""
    spark = SparkSession.active()
    names = employee_performance(t).select("branch_name").dropna().distinct()
    everything = spark.range(1).select(
        F.lit(0).alias("position"), F.lit(ALL_BRANCHES).alias("branch_name")
    )
    return (
        names.select(F.lit(1).alias("position"), "branch_name")
        .unionByName(everything)
        .orderBy("position", "branch_name")
        .drop("position")
    )


def employees(t: Tables, branch: str = ALL_BRANCHES) -> DataFrame:
    rows = employee_performance(t)
    return rows if branch == ALL_BRANCHES else rows.filter(F.col("branch_name") == branch)


def top_employees(t: Tables, branch: str = ALL_BRANCHES, top: int = TOP) -> DataFrame:
    chosen = employees(t, branch).select("employee_id", "employee_name", "net_revenue")
    return _top(chosen, "net_revenue", "employee_id", top)


def employee_table(t: Tables, branch: str = ALL_BRANCHES) -> DataFrame:
    return employees(t, branch).select(
        "employee_name", "job_title", "branch_name", "transaction_count", "units_sold",
        "net_revenue", "estimated_net_profit",
    )


def make_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return as_numbers(df, columns)


def counts_by_first_present(df: DataFrame, candidates: list[str], rows: str) -> DataFrame:
    """Counts by the first of the candidate columns that ``df`` has."""
    column = first_present(df, candidates)
    if column is None:
        raise ValueError(f"none of {candidates} in {df.columns}")
    return _counts(df, column, rows)
