"""Products, stock and suppliers.

Sales and stock are summed per product before products are joined, so no join
multiplies rows unless the report asks for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countinghouse.functions.dates import day_of, days_between
from countinghouse.functions.numbers import average, money, or_zero, ratio, revenue
from countinghouse.operators.measures import Tables, inventory_status, reference_date

TOP = 20
SLOW_AFTER_DAYS = 180
RECENT_DAYS = 90


def product_sales(t: Tables) -> DataFrame:
    """Units, gross revenue and number of sales per product sold."""
    return t["sale_items"].groupBy("product_id").agg(
        F.count_distinct("sale_id").alias("transaction_count"),
        F.sum("quantity").alias("units_sold"),
        F.sum(revenue()).alias("gross"),
    )


def product_stock(t: Tables) -> DataFrame:
    return t["inventory"].groupBy("product_id").agg(
        F.sum("stock_quantity").alias("total_stock_quantity")
    )


def _profit() -> Column:
    return F.col("gross") - F.col("units_sold") * F.col("cost_price")


def kpis(t: Tables) -> DataFrame:
    """Stock is folded to one row per product first, which makes the products distinct."""
    stock, reorder = F.col("stock_quantity"), F.col("reorder_level")
    per_product = t["inventory"].groupBy("product_id").agg(
        F.sum(stock).alias("units"),
        F.count_if(stock == 0).alias("none"),
        F.count_if((stock > 0) & (stock <= reorder)).alias("low"),
    )
    products = t["products"].select("product_id", "category", "cost_price", "selling_price")
    return products.join(per_product, "product_id").agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_distinct("category").alias("total_categories"),
        F.sum("units").alias("total_stock_units"),
        F.sum("none").alias("out_of_stock_records"),
        F.sum("low").alias("low_stock_records"),
        money(F.sum(F.col("units") * F.col("cost_price"))).alias("estimated_inventory_cost_value"),
        money(F.sum(F.col("units") * F.col("selling_price"))).alias(
            "estimated_inventory_retail_value"
        ),
    )


def by_category(t: Tables) -> DataFrame:
    """The average price counts a product once per line sold, or once if unsold."""
    products = t["products"].select("product_id", "category", "cost_price", "selling_price")
    lines = t["sale_items"].groupBy("product_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("quantity").alias("units_sold"),
        F.sum(revenue()).alias("gross"),
    )
    weight = F.coalesce("lines", F.lit(1))
    totals = products.join(lines, "product_id", "left").groupBy("category").agg(
        F.count(F.lit(1)).alias("product_count"),
        F.sum("units_sold").alias("units_sold"),
        money(F.sum("gross")).alias("gross_revenue"),
        money(F.sum(_profit())).alias("estimated_profit_before_discount"),
        average(F.sum(F.col("selling_price") * weight), F.sum(weight)).alias(
            "average_product_price"
        ),
    )
    sales = (
        t["sale_items"]
        .join(products.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(F.count_distinct("sale_id").alias("transaction_count"))
    )
    return (
        totals.join(sales, "category", "left")
        .fillna(0, ["transaction_count"])
        .orderBy(F.desc_nulls_last("gross_revenue"))
    )


def low_stock(t: Tables) -> DataFrame:
    stock = F.col("stock_quantity")
    short = t["inventory"].filter(stock <= F.col("reorder_level"))
    return (
        short.join(t["branches"].select("branch_id", "branch_name"), "branch_id")
        .join(t["products"].select("product_id", "product_name", "category"), "product_id")
        .select(
            "branch_name", "product_id", "product_name", "category", "stock_quantity",
            "reorder_level",
            F.when(stock == 0, "Out of Stock").otherwise("Low Stock").alias("stock_status"),
        )
        .orderBy(
            F.when(stock == 0, 1).otherwise(2), "branch_name", "stock_quantity", "product_id"
        )
    )


def value_by_branch(t: Tables) -> DataFrame:
    units = F.col("stock_quantity")
    prices = t["products"].select("product_id", "cost_price", "selling_price")
    value = t["inventory"].join(prices, "product_id").groupBy("branch_id").agg(
        F.sum(units).alias("total_stock_units"),
        F.sum(units * F.col("cost_price")).alias("cost"),
        F.sum(units * F.col("selling_price")).alias("retail"),
    )
    return value.join(t["branches"], "branch_id").select(
        "branch_id", "branch_name", "city", "total_stock_units",
        money(F.col("cost")).alias("inventory_cost_value"),
        money(F.col("retail")).alias("inventory_retail_value"),
        money(F.col("retail") - F.col("cost")).alias("potential_inventory_profit"),
    ).orderBy(F.desc("inventory_retail_value"))


def slow_moving(t: Tables) -> DataFrame:
    today = reference_date(t).scalar()
    days = t["sales"].select("sale_id", day_of(F.col("sale_date")).alias("sale_day"))
    sold = t["sale_items"].join(days, "sale_id", "left").groupBy("product_id").agg(
        F.sum("quantity").alias("units"), F.max("sale_day").alias("last_sale_date")
    )
    idle = F.col("days_since_last_sale")
    return (
        t["products"].select("product_id", "product_name", "category")
        .join(product_stock(t), "product_id")
        .join(sold, "product_id", "left")
        .withColumn("days_since_last_sale", days_between(today, F.col("last_sale_date")))
        .filter(idle.isNull() | (idle > SLOW_AFTER_DAYS))
        .select(
            "product_id", "product_name", "category",
            or_zero(F.col("units")).alias("total_units_sold"),
            "last_sale_date", "days_since_last_sale", "total_stock_quantity",
            F.when(idle.isNull(), "Never Sold").otherwise("Slow Moving").alias("product_status"),
        )
        .orderBy(
            F.asc_nulls_first("last_sale_date"), F.desc("total_stock_quantity"), "product_id"
        )
    )


def _sold_products(t: Tables, how: str) -> DataFrame:
    products = t["products"].select(
        "product_id", "product_name", "category", "gold_type_id", "cost_price"
    )
    return products.join(product_sales(t), "product_id", how).join(
        t["gold_types"], "gold_type_id"
    )


def top_products(t: Tables, top: int = TOP) -> DataFrame:
    return (
        _sold_products(t, "inner")
        .orderBy(F.desc("gross"), "product_id")
        .limit(top)
        .select(
            "product_id", "product_name", "category", "gold_type_name", "transaction_count",
            "units_sold", money(F.col("gross")).alias("gross_revenue"),
            money(_profit()).alias("estimated_profit_before_discount"),
        )
    )


def product_performance(t: Tables) -> DataFrame:
    return _sold_products(t, "left").select(
        "product_id", "product_name", "category", "gold_type_name",
        or_zero(F.col("transaction_count")).alias("transaction_count"),
        or_zero(F.col("units_sold")).alias("units_sold"),
        money(or_zero(F.col("gross"))).alias("gross_revenue"),
        money(or_zero(_profit())).alias("estimated_profit_before_discount"),
    )


def overstock(t: Tables) -> DataFrame:
    """The recent sales are chosen first; only their items are summed."""
    start = F.date_sub(reference_date(t).scalar(), RECENT_DAYS)
    recent = t["sales"].filter(day_of(F.col("sale_date")) > start).select("sale_id")
    sold = t["sale_items"].join(recent, "sale_id").groupBy("product_id").agg(
        F.sum("quantity").alias("recent_units")
    )
    stock, units = F.col("total_stock_quantity"), or_zero(F.col("recent_units"))
    return (
        t["products"].select("product_id", "product_name", "category")
        .join(product_stock(t), "product_id")
        .join(sold, "product_id", "left")
        .filter((units == 0) | (stock > units * 2))
        .select(
            "product_id", "product_name", "category", "total_stock_quantity",
            units.alias("units_sold_last_90_days"),
            ratio(stock, F.col("recent_units")).alias("stock_to_recent_sales_ratio"),
            F.when((units == 0) & (stock > 0), "No Recent Sales")
            .when(stock > F.col("recent_units") * 2, "Potential Overstock")
            .otherwise("Normal Stock")
            .alias("inventory_risk"),
        )
        .orderBy("units_sold_last_90_days", F.desc("total_stock_quantity"), "product_id")
    )


def supplier_performance(t: Tables) -> DataFrame:
    sold = t["sale_items"].groupBy("product_id").agg(
        F.sum("quantity").alias("units"), F.sum(revenue()).alias("gross")
    )
    stock = F.col("total_stock_quantity")
    supplied = (
        t["products"].select("product_id", "supplier_id", "cost_price")
        .join(sold, "product_id", "left")
        .join(product_stock(t), "product_id", "left")
        .groupBy("supplier_id")
        .agg(
            F.count(F.lit(1)).alias("products"),
            F.sum("units").alias("units"),
            F.sum("gross").alias("gross"),
            F.sum(stock).alias("stock"),
            F.sum(stock * F.col("cost_price")).alias("cost"),
        )
    )
    return (
        t["suppliers"].select("supplier_id", "supplier_name")
        .join(supplied, "supplier_id", "left")
        .select(
            "supplier_id", "supplier_name",
            or_zero(F.col("products")).alias("products_supplied"),
            or_zero(F.col("units")).alias("units_sold"),
            money(or_zero(F.col("gross"))).alias("gross_revenue"),
            or_zero(F.col("stock")).alias("current_stock_units"),
            money(or_zero(F.col("cost"))).alias("inventory_cost_value"),
        )
        .orderBy(F.desc("gross_revenue"), "supplier_id")
    )


def inventory_risk(t: Tables) -> DataFrame:
    units = F.col("stock_quantity")
    return (
        t["inventory"]
        .join(t["branches"].select("branch_id", "branch_name"), "branch_id")
        .join(
            t["products"].select(
                "product_id", "product_name", "category", "cost_price", "selling_price"
            ),
            "product_id",
        )
        .select(
            "inventory_id", "branch_id", "branch_name", "product_id", "product_name", "category",
            "stock_quantity", "reorder_level", "last_updated",
            inventory_status(units, F.col("reorder_level")).alias("inventory_status"),
            money(units * F.col("cost_price")).alias("inventory_cost_value"),
            money(units * F.col("selling_price")).alias("inventory_retail_value"),
        )
    )
