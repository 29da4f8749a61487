"""First-look reports over the cleaned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countinghouse.functions.dates import day_of, days_between, month_of
from countinghouse.functions.numbers import average, money
from countinghouse.operators.measures import Tables, inventory_status, share_of_total


def _rows(name: str):
    return F.count(F.lit(1)).alias(name)


def overview(t: Tables) -> DataFrame:
    return t["sales"].agg(
        _rows("total_transactions"),
        F.count_distinct("customer_id").alias("registered_customers"),
        F.count_distinct("employee_id").alias("active_employees"),
        F.count_distinct("branch_id").alias("active_branches"),
    )


def date_range(t: Tables) -> DataFrame:
    first, last = F.col("first_sale_date"), F.col("latest_sale_date")
    return t["sales"].agg(
        F.min("sale_date").alias("first_sale_date"), F.max("sale_date").alias("latest_sale_date")
    ).withColumn("total_days", days_between(day_of(last), day_of(first)))


def _mean(column: str):
    return average(F.sum(column), F.count(column))


def category_overview(t: Tables) -> DataFrame:
    return t["products"].groupBy("category").agg(
        _rows("product_count"),
        _mean("weight_grams").alias("average_weight_grams"),
        _mean("selling_price").alias("average_selling_price"),
    ).orderBy(F.desc("product_count"))


def _mix(df: DataFrame, by, rows: str, share: str) -> DataFrame:
    counted = df.groupBy(by).agg(_rows(rows))
    return share_of_total(counted, rows, share).orderBy(F.desc(rows))


def payment_mix(t: Tables) -> DataFrame:
    return _mix(t["sales"], F.col("payment_method"), "transaction_count", "transaction_percentage")


def customer_type(t: Tables) -> DataFrame:
    kind = F.when(F.col("customer_id").isNull(), "Walk-in Customer").otherwise(
        "Registered Customer"
    )
    return _mix(
        t["sales"], kind.alias("customer_type"), "transaction_count", "transaction_percentage"
    )


def customer_city(t: Tables) -> DataFrame:
    city = F.coalesce("city", F.lit("Unknown")).alias("city")
    return _mix(t["customers"], city, "customer_count", "customer_percentage")


def branch_overview(t: Tables) -> DataFrame:
    activity = t["sales"].groupBy("branch_id").agg(
        F.count("sale_id").alias("transaction_count"),
        F.count_distinct("customer_id").alias("registered_customers"),
    )
    return (
        t["branches"].select("branch_id", "branch_name", "city")
        .join(activity, "branch_id", "left")
        .fillna(0, ["transaction_count", "registered_customers"])
        .orderBy(F.desc("transaction_count"))
    )


def quantity_overview(t: Tables) -> DataFrame:
    return t["sale_items"].agg(
        _rows("total_sale_items"),
        F.sum("quantity").alias("total_units_sold"),
        _mean("quantity").alias("average_quantity_per_item"),
        F.min("quantity").alias("minimum_quantity"),
        F.max("quantity").alias("maximum_quantity"),
    )


def margins(t: Tables) -> DataFrame:
    """The margin is the mean of the products' margins, not a ratio of sums."""
    profit = F.col("selling_price") - F.col("cost_price")
    margin = profit / F.nullif("selling_price", F.lit(0).cast("decimal(14,2)")) * 100
    return (
        t["products"]
        .select("category", "cost_price", "selling_price", profit.alias("profit"),
                margin.cast("decimal(28,12)").alias("margin"))
        .groupBy("category")
        .agg(
            _rows("product_count"),
            _mean("cost_price").alias("average_cost_price"),
            _mean("selling_price").alias("average_selling_price"),
            _mean("profit").alias("average_estimated_profit"),
            F.round(F.avg("margin"), 2).cast("double").alias("average_profit_margin_percentage"),
        )
        .orderBy(F.desc("average_estimated_profit"))
    )


def inventory_overview(t: Tables) -> DataFrame:
    status = inventory_status(F.col("stock_quantity"), F.col("reorder_level"))
    return t["inventory"].groupBy(status.alias("inventory_status")).agg(
        _rows("inventory_record_count"), F.sum("stock_quantity").alias("total_units")
    ).orderBy(F.desc("inventory_record_count"))


def gold_prices(t: Tables) -> DataFrame:
    prices = t["gold_prices"].groupBy("gold_type_id").agg(
        money(F.min("price_per_gram")).alias("minimum_price_per_gram"),
        money(F.max("price_per_gram")).alias("maximum_price_per_gram"),
        _mean("price_per_gram").alias("average_price_per_gram"),
    )
    return prices.join(t["gold_types"], "gold_type_id").orderBy("gold_type_id").select(
        "gold_type_name", "minimum_price_per_gram", "maximum_price_per_gram",
        "average_price_per_gram",
    )


def monthly_trend(t: Tables) -> DataFrame:
    return t["sales"].groupBy(month_of(F.col("sale_date")).alias("sales_month")).agg(
        _rows("transaction_count"), F.count_distinct("customer_id").alias("registered_customers")
    ).orderBy("sales_month")


def category_units(t: Tables) -> DataFrame:
    products = t["products"].select("product_id", "category")
    return t["sale_items"].join(products, "product_id").groupBy("category").agg(
        F.count_distinct("sale_id").alias("transactions"), F.sum("quantity").alias("units_sold")
    ).orderBy(F.desc("units_sold"))


def supplier_products(t: Tables) -> DataFrame:
    supplied = t["products"].groupBy("supplier_id").agg(_rows("products_supplied"))
    return (
        t["suppliers"].select("supplier_id", "supplier_name")
        .join(supplied, "supplier_id", "left")
        .fillna(0, ["products_supplied"])
        .orderBy(F.desc("products_supplied"), "supplier_id")
    )
