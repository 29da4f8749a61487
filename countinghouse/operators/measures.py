"""Sale-level measures that most reports start from.

Lines are summed per sale before the sale header is joined, so what crosses
the network is one row per sale and task, a sale with very many lines is
combined on the map side, and the header discount is counted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countinghouse.functions.dates import day_of, month_of
from countinghouse.functions.numbers import percent, percent_change, revenue

Tables = dict[str, DataFrame]

DERIVED = {
    "sales_month": lambda: month_of(F.col("sale_date")),
    "sale_day": lambda: day_of(F.col("sale_date")),
}


SALE_FACTS = "sale_facts"


def _headers(sales: DataFrame, columns: tuple[str, ...], *more: str) -> DataFrame:
    made = [
        DERIVED[c]().alias(c) if c in DERIVED and c not in sales.columns else F.col(c)
        for c in columns
    ]
    return sales.select("sale_id", "discount_amount", *made, *more)


def priced_lines(tables: Tables, *product_columns: str) -> DataFrame:
    """Lines with their revenue and profit before discount.

    The product side is broadcast only when Spark has measured it to be small
    enough; otherwise it is a sort-merge join whose hot products are split.
    """
    products = tables["products"].select("product_id", "cost_price", *product_columns)
    lines = tables["sale_items"].select(
        "sale_id", "product_id", "quantity", "unit_price", revenue().alias("line_revenue")
    )
    margin = F.col("quantity") * (F.col("unit_price") - F.col("cost_price"))
    return lines.join(products, "product_id").select(
        "sale_id", "product_id", "quantity", "line_revenue",
        margin.alias("line_profit"), *product_columns,
    )


def transaction_totals(tables: Tables, *header: str) -> DataFrame:
    """One row per sale with units, gross revenue and profit before discount."""
    if SALE_FACTS in tables:
        priced = tables[SALE_FACTS].filter(F.col("units_sold").isNotNull())
        priced = priced.withColumn("gross_revenue", F.col("priced_revenue"))
        totals = _headers(
            priced, header, "units_sold", "gross_revenue", "profit_before_discount"
        )
    else:
        per_sale = priced_lines(tables).groupBy("sale_id").agg(
            F.sum("quantity").alias("units_sold"),
            F.sum("line_revenue").alias("gross_revenue"),
            F.sum("line_profit").alias("profit_before_discount"),
        )
        totals = per_sale.join(_headers(tables["sales"], header), "sale_id")
    net = F.col("gross_revenue") - F.col("discount_amount")
    profit = F.col("profit_before_discount") - F.col("discount_amount")
    return totals.withColumns({"net_revenue": net, "estimated_net_profit": profit})


def sale_lines(tables: Tables) -> DataFrame:
    """The lines with what their sale's header says of customer, branch, employee and time."""
    headers = tables["sales"].select(
        "sale_id", "customer_id", "branch_id", "employee_id", "sale_date"
    )
    return tables["sale_items"].join(headers, "sale_id")


def sale_source(tables: Tables) -> DataFrame:
    """The frame with one row per sale that a condition on sales applies to."""
    return tables.get(SALE_FACTS, tables["sales"])


def sale_net_revenue(
    tables: Tables, *header: str, where: Column | None = None, months: Column | None = None
) -> DataFrame:
    """One row per sale with gross and net revenue; products are not consulted.

    ``where`` chooses sales; then only their lines are summed. ``months`` narrows
    lines that are stored by month.
    """
    chosen = sale_source(tables)
    if where is not None:
        chosen = chosen.filter(where)
    if SALE_FACTS in tables:
        totals = _headers(chosen, header, "gross_revenue")
    else:
        lines = tables["sale_items"]
        if months is not None and "sales_month" in lines.columns:
            lines = lines.filter(months)
        if where is not None:
            lines = lines.join(chosen.select("sale_id"), "sale_id", "left_semi")
        per_sale = lines.groupBy("sale_id").agg(F.sum(revenue()).alias("gross_revenue"))
        totals = per_sale.join(_headers(chosen, header), "sale_id")
    return totals.withColumn("net_revenue", F.col("gross_revenue") - F.col("discount_amount"))


def sale_facts(tables: Tables) -> DataFrame:
    """One row per sale with items: its header, month and all its measures.

    Stored once and put under ``sale_facts`` in the tables, it serves every
    report on sales without another look at the lines. Lines of an unknown
    product count in ``gross_revenue`` only, as reports without profit do.
    """
    products = tables["products"].select("product_id", "cost_price")
    products = products.withColumn("known", F.lit(True))
    quantity, known = F.col("quantity"), F.col("known")
    margin = quantity * (F.col("unit_price") - F.col("cost_price"))
    per_sale = (
        tables["sale_items"]
        .join(products, "product_id", "left")
        .groupBy("sale_id")
        .agg(
            F.sum(revenue()).alias("gross_revenue"),
            F.sum(F.when(known, quantity)).alias("units_sold"),
            F.sum(F.when(known, revenue())).alias("priced_revenue"),
            F.sum(F.when(known, margin)).alias("profit_before_discount"),
        )
    )
    sales = tables["sales"].withColumn("sales_month", month_of(F.col("sale_date")))
    return per_sale.join(sales, "sale_id")


def registered_sales(tables: Tables) -> DataFrame:
    return tables["sales"].filter(F.col("customer_id").isNotNull())


def employee_net(tables: Tables) -> DataFrame:
    return transaction_totals(tables, "employee_id").select(
        "sale_id", "employee_id", "units_sold", "net_revenue", "estimated_net_profit"
    )


def _share(discount: Column, revenue_: Column, gross: Column) -> Column:
    """Part of the discount in proportion to revenue; NULL if there is no revenue."""
    part = discount.cast("double") * revenue_.cast("double")
    return (part / F.nullif(gross.cast("double"), F.lit(0.0))).cast("decimal(30,12)")


def sale_products(tables: Tables, *product_columns: str) -> DataFrame:
    """Per sale and product: units, revenue and profit before discount.

    Summed on the map side, so a sale has no more rows than there are products,
    however many lines it has.
    """
    return priced_lines(tables, *product_columns).groupBy(
        "sale_id", "product_id", *product_columns
    ).agg(
        F.sum("quantity").alias("quantity"),
        F.sum("line_revenue").alias("line_revenue"),
        F.sum("line_profit").alias("line_profit"),
    )


def _with_discount(parts: DataFrame, tables: Tables) -> DataFrame:
    """Parts of sales with their share of the header discount.

    The sales' totals are joined back by a plain join, whose skewed sales Spark
    splits at run time; no window gathers a sale.
    """
    whole = parts.groupBy("sale_id").agg(F.sum("line_revenue").alias("sale_gross"))
    totals = whole.join(_headers(tables["sales"], ()), "sale_id")
    share = _share(F.col("discount_amount"), F.col("line_revenue"), F.col("sale_gross"))
    return parts.join(totals, "sale_id").withColumn("allocated_discount", share)


def discount_allocation(tables: Tables) -> DataFrame:
    """Per sale and product, with the share of the header discount."""
    return _with_discount(sale_products(tables), tables).select(
        "sale_id", "product_id", "quantity", "line_revenue", "line_profit", "allocated_discount"
    )


def category_allocation(tables: Tables) -> DataFrame:
    """Per sale and category: units, revenue, profit and share of the discount."""
    parts = priced_lines(tables, "category").groupBy("sale_id", "category").agg(
        F.sum("quantity").alias("quantity"),
        F.sum("line_revenue").alias("line_revenue"),
        F.sum("line_profit").alias("line_profit"),
    )
    return _with_discount(parts, tables)


def reference_date(tables: Tables, plus_days: int = 0) -> DataFrame:
    """One row: the day of the latest sale, walk-in sales included."""
    latest = day_of(F.max("sale_date"))
    return tables["sales"].agg(F.date_add(latest, plus_days).alias("analysis_date"))


def inventory_status(stock: Column, reorder: Column) -> Column:
    return (
        F.when(stock == 0, "Out of Stock")
        .when(stock <= reorder, "Low Stock")
        .otherwise("Healthy Stock")
    )


def with_previous(
    df: DataFrame, value: str, name: str, order: str, *by: str
) -> DataFrame:
    """Add the value of the previous present period.

    Periods are months, so a group has few rows by nature.
    """
    window = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(name, F.lag(value).over(window))


def change_percent(value: str, previous: str) -> Column:
    return percent_change(F.col(value), F.col(previous))


def share_of_total(df: DataFrame, count: str, name: str) -> DataFrame:
    """Add each row's percent of the sum, which is one row looked up by all."""
    whole = df.agg(F.sum(count)).scalar()
    return df.withColumn(name, percent(F.col(count), whole))
