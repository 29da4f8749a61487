"""The eight reusable views of the analytics layer."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from countinghouse.functions.numbers import average, money
from countinghouse.operators.measures import Tables, transaction_totals
from countinghouse.plans import customers, inventory, people


def monthly_sales_summary(t: Tables) -> DataFrame:
    totals = transaction_totals(t, "sales_month", "customer_id").groupBy("sales_month").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.count_distinct("customer_id").alias("registered_customers"),
        F.sum("units_sold").alias("units_sold"),
        F.sum("gross_revenue").alias("gross"),
        F.sum("discount_amount").alias("discounts"),
        F.sum("net_revenue").alias("net"),
        F.sum("estimated_net_profit").alias("profit"),
    )
    return totals.select(
        "sales_month", "transaction_count", "registered_customers", "units_sold",
        money(F.col("gross")).alias("gross_revenue"),
        money(F.col("discounts")).alias("total_discounts"),
        money(F.col("net")).alias("net_revenue"),
        money(F.col("profit")).alias("estimated_net_profit"),
        average(F.col("net"), F.col("transaction_count")).alias("average_transaction_value"),
    ).orderBy("sales_month")


def customer_summary(t: Tables) -> DataFrame:
    """Every customer, also those without a purchase."""
    people_ = t["customers"].select(
        "customer_id", "customer_name", F.coalesce("city", F.lit("Unknown")).alias("city")
    )
    spent, count = F.coalesce("spent", F.lit(0)), F.col("purchase_count")
    return people_.join(customers.customer_totals(t), "customer_id", "left").select(
        "customer_id", "customer_name", "city",
        F.coalesce(count, F.lit(0)).alias("purchase_count"),
        "first_purchase_date", "last_purchase_date",
        money(spent).alias("total_spent"),
        F.coalesce(average(F.col("spent"), count), F.lit(0.0)).alias("average_transaction_value"),
    )


def executive_summary(t: Tables) -> DataFrame:
    """Summed by branch and customer first, so the distinct counts see few rows."""
    sums = {
        "total_units_sold": "units_sold",
        "gross": "gross_revenue",
        "discounts": "discount_amount",
        "net": "net_revenue",
        "profit": "estimated_net_profit",
    }
    pairs = transaction_totals(t, "customer_id", "branch_id").groupBy(
        "customer_id", "branch_id"
    ).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        *(F.sum(column).alias(name) for name, column in sums.items()),
    )
    totals = pairs.agg(
        F.coalesce(F.sum("total_transactions"), F.lit(0)).alias("total_transactions"),
        F.count_distinct("customer_id").alias("registered_customers"),
        F.count_distinct("branch_id").alias("active_branches"),
        *(F.sum(name).alias(name) for name in sums),
    )
    return totals.select(
        "total_transactions", "registered_customers", "active_branches", "total_units_sold",
        money(F.col("gross")).alias("gross_revenue"),
        money(F.col("discounts")).alias("total_discounts"),
        money(F.col("net")).alias("net_revenue"),
        average(F.col("net"), F.col("total_transactions")).alias("average_transaction_value"),
        money(F.col("profit")).alias("estimated_net_profit"),
    )


VIEWS = {
    "monthly_sales_summary": monthly_sales_summary,
    "branch_performance": people.branch_performance,
    "product_performance": inventory.product_performance,
    "customer_summary": customer_summary,
    "inventory_risk": inventory.inventory_risk,
    "employee_performance": people.employee_performance,
    "customer_segments": customers.customer_segments,
    "executive_summary": executive_summary,
}


#: Views whose frame stores intermediate data while it is built. They are built anew
#: for each query that reads them, so that no reader sees an earlier load.
BUILT_PER_QUERY = {"customer_segments"}


def register_views(t: Tables, prefix: str = "") -> list[str]:
    """Create the lazy views in the session and return their names; runs no job.

    Spark lists the files of a table when it is loaded: pass tables loaded anew, here or
    to ``query``, to see what has been written since.
    """
    names = []
    for name, build in VIEWS.items():
        if name not in BUILT_PER_QUERY:
            build(t).createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
    return names


def query(spark: SparkSession, text: str, t: Tables | None = None, prefix: str = "") -> DataFrame:
    """SQL over the views. Given the tables, the views that ``text`` names, in whatever case,
    are created first, as they are now; nothing is fetched until asked for."""
    for name, build in VIEWS.items() if t is not None else ():
        if re.search(rf"\b{re.escape(prefix + name)}\b", text, re.IGNORECASE):
            build(t).createOrReplaceTempView(prefix + name)
    return spark.sql(text)


def fetch(df: DataFrame, most: int) -> list[Row]:
    """The rows of ``df`` on the driver; fails if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows
