"""Every registered report as a function of the session and a data folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixed import (
    AS_OF,
    BATCH_UNTIL,
    RANGE_FROM,
    RANGE_UNTIL,
    SELECTED_BRANCH,
    VIEW_TOTALS,
    WANTED,
)
from countinghouse.functions.numbers import presentable
from countinghouse.operators import appended, cleaning, constraints, measures, quality
from countinghouse.plans import (
    advanced,
    customers,
    dashboard,
    explore,
    generate,
    inventory,
    marts,
    people,
    sales,
    views,
)
from countinghouse.schemas import TABLES
from countinghouse.session import fresh_path, stored
from countinghouse.sources import clustered, files, star, versioned

Tables = dict[str, DataFrame]
Query = Callable[[SparkSession, str], DataFrame]

_BUILDERS = {
    "raw": star.raw_tables,
    "bad": star.violating_tables,
    "clean": lambda given: cleaning.clean_all(star.raw_tables(given)),
}
#: One layout for the three ways of looking up lines.
CLUSTER_KEYS, CLUSTER_FILES = ("customer_id", "branch_id", "product_id"), 512
_CACHE: dict[tuple[str, str, str], Tables] = {}


def tables(spark: SparkSession, folder: str, layer: str) -> Tables:
    """The lazy frames of a layer; building them again for each query is wasted work."""
    key = (spark.sparkContext.applicationId, folder, layer)
    if key not in _CACHE:
        _CACHE[key] = _BUILDERS[layer](star.read_given(spark, folder))
    return _CACHE[key]


def _on(layer: str, report: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, folder: presentable(report(tables(spark, folder, layer)))


def _transaction_totals(t: Tables) -> DataFrame:
    return measures.transaction_totals(t).select(
        "sale_id", "units_sold", "gross_revenue", "profit_before_discount"
    )


def _discount_allocation(t: Tables) -> DataFrame:
    """Summed per sale and product, since a product may occur twice in a sale."""
    return measures.discount_allocation(t).groupBy("sale_id", "product_id").agg(
        F.sum("quantity").alias("quantity"),
        F.sum("line_revenue").alias("line_revenue"),
        F.round(F.sum("allocated_discount"), 2).alias("allocated_discount"),
    )


def _reference_date(t: Tables) -> DataFrame:
    return measures.reference_date(t).withColumn("day_after", F.date_add("analysis_date", 1))


def _inventory_status(t: Tables) -> DataFrame:
    status = measures.inventory_status(F.col("stock_quantity"), F.col("reorder_level"))
    return t["inventory"].select("inventory_id", status.alias("inventory_status"))


def _pct_change(t: Tables) -> DataFrame:
    months = measures.with_previous(
        sales.monthly_revenue(t), "net_revenue", "before", "sales_month"
    )
    return months.select(
        "sales_month", measures.change_percent("net_revenue", "before").alias("change_percentage")
    )


def _share_of_total(t: Tables) -> DataFrame:
    counted = t["sale_items"].groupBy("quantity").agg(F.count(F.lit(1)).alias("line_count"))
    return measures.share_of_total(counted, "line_count", "line_percentage")


def _csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "suppliers-csv")
    files.write_csv(tables(spark, folder, "raw")["suppliers"], path)
    return files.read_csv(spark, path, "suppliers")


def _csv_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "products-csv")
    files.write_csv(tables(spark, folder, "clean")["products"], path)
    return presentable(files.read_csv(spark, path, "products"))


def _csv_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of the lines of a CSV of which some are broken: their number by reason,
    and the units of the accepted ones."""
    path, sale = fresh_path(spark, "sale-items-csv"), F.col("sale_id")
    items = tables(spark, folder, "raw")["sale_items"]
    fields = [F.col(name).cast("string") for name in items.columns]
    fields[3] = F.when(sale % 70 == 3, F.lit("many")).otherwise(fields[3])
    line = F.concat_ws(",", *fields)
    short = F.concat_ws(",", *fields[:-1])
    line = F.when(sale % 70 == 4, short).when(sale % 70 == 5, F.concat(line, F.lit(",9"))).otherwise(line)
    # One column that holds whole lines, under a header line in each file.
    whole = items.select(line.alias(",".join(items.columns)))
    whole.write.options(header="true", sep="\u0001", quote="").csv(path)
    typed, rejects = files.load_csv(spark, path, "sale_items", fresh_path(spark, "loaded"))
    accepted = typed.agg(
        F.lit("accepted").alias("reason"),
        F.count(F.lit(1)).alias("lines"),
        F.sum("quantity").alias("units"),
    )
    refused = rejects.groupBy(F.col(files.REASON).alias("reason")).agg(
        F.count(F.lit(1)).alias("lines"), F.lit(0).cast("bigint").alias("units")
    )
    return accepted.unionByName(refused)


def _insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    branches = tables(spark, folder, "raw")["branches"]
    stored = versioned.VersionedTable(spark, fresh_path(spark, "branches"), branches.schema)
    versioned.insert_ignore(stored, branches.filter("branch_id % 2 = 0"), "branch_id")
    shouted = branches.withColumn("branch_name", F.upper("branch_name"))
    versioned.insert_ignore(stored, shouted.unionByName(branches), "branch_id")
    return presentable(stored.read())


def _create_layers(spark: SparkSession, folder: str) -> DataFrame:
    """One table saved in each layer, and their rows read through the catalog."""
    root = fresh_path(spark, "layers")
    prefix = f"countinghouse_{root[-8:]}_"
    frames = {
        "raw": tables(spark, folder, "raw")["branches"],
        "cleaned": tables(spark, folder, "clean")["branches"],
        "analytics": people.branch_performance(tables(spark, folder, "clean")),
    }
    parts = []
    for layer, database in zip(files.LAYERS, files.create_layers(spark, root, prefix)):
        frames[layer].write.mode("overwrite").saveAsTable(f"{database}.branch_table")
        rows = spark.table(f"{database}.branch_table")
        parts.append(rows.select(F.lit(layer).alias("layer"), "branch_id", "branch_name", "city"))
    return reduce(DataFrame.unionByName, parts)


def _full_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """The customers of a layer that was refreshed twice."""
    raw, root = tables(spark, folder, "raw"), fresh_path(spark, "cleaned")
    files.full_refresh({**raw, "customers": raw["customers"].filter("customer_id < 5")}, root)
    files.full_refresh(raw, root)
    return presentable(files.current_layer(spark, root)["customers"])


def _views(spark: SparkSession, folder: str) -> DataFrame:
    """A value of every view, read by SQL."""
    clean, prefix = tables(spark, folder, "clean"), "countinghouse_"
    text = " union all ".join(
        f"select '{name}' as view_name, count(*) as row_count,"
        f" cast(sum(cast({column} as decimal(38,2))) as double) as total from {prefix}{name}"
        for name, column in VIEW_TOTALS.items()
    )
    return views.query(spark, text, clean, prefix)


def _query_to_frame(spark: SparkSession, folder: str) -> DataFrame:
    """SQL over a view; the result stays a frame, so its rows need not fit anywhere."""
    return views.query(
        spark,
        "select city, count(*) as branches,"
        " cast(sum(cast(net_revenue as decimal(38,2))) as double) as net_revenue"
        " from CountingHouse_Branch_Performance group by city",
        tables(spark, folder, "clean"),
        "countinghouse_",
    )


def _cached_mart(spark: SparkSession, folder: str) -> DataFrame:
    """The second reader gets what the first one stored."""
    path = fresh_path(spark, "mart")
    clean = tables(spark, folder, "clean")
    files.cached_mart(spark, lambda: views.monthly_sales_summary(clean), path)
    return files.cached_mart(spark, lambda: spark.range(0), path)


def _batches(t: Tables) -> list[Tables]:
    """All sales in three batches; the last one brings late sales of most months."""
    early, late = F.col("sale_date") < BATCH_UNTIL, F.col("sale_id") % 5 == 0
    chosen = [
        t["sales"].filter(early & ~late), t["sales"].filter(~early & ~late), t["sales"].filter(late)
    ]
    return [
        {**t, "sales": sales, "sale_items": t["sale_items"].join(sales, "sale_id", "left_semi")}
        for sales in chosen
    ]


def _on_mart(report: Callable[[marts.SalesMart], DataFrame]) -> Query:
    """A report on a mart that was brought up to date after each of three appends."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        clean = tables(spark, folder, "clean")
        mart = marts.SalesMart.of(clean, fresh_path(spark, "mart"))
        for batch in _batches(clean):
            mart.append(batch)
            mart.update()
        return presentable(report(mart))

    return run


def _refresh_months(spark: SparkSession, folder: str) -> DataFrame:
    """Sales by month of which one month came too high and was replaced."""
    sales = tables(spark, folder, "clean")["sales"]
    sales = sales.withColumn("sales_month", F.trunc("sale_date", "month"))
    stored = versioned.VersionedTable(spark, fresh_path(spark, "sales"), sales.schema)
    month = F.col("sales_month") == F.lit(RANGE_FROM).cast("date")
    wrong = F.when(month, 0).otherwise(F.col("discount_amount"))
    first = sales.withColumn("discount_amount", wrong.cast(sales.schema["discount_amount"].dataType))
    versioned.refresh_parts(stored, first, "sales_month", F.lit(True))
    versioned.refresh_parts(stored, sales, "sales_month", month)
    return presentable(stored.read().drop("sales_month"))


def _on_facts(report: Callable[[Tables], DataFrame]) -> Query:
    """A sale report on facts that are stored first; the time of a run includes storing them."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = fresh_path(spark, "facts")
        facts = files.with_sale_facts(tables(spark, folder, "clean"), path)
        return presentable(report(facts))

    return run


def _bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """Net revenue of each sale, joined from bucketed tables without a shuffle."""
    root = fresh_path(spark, "bucketed")
    clean = tables(spark, folder, "clean")
    (database, *_) = files.create_layers(spark, root, f"countinghouse_{root[-8:]}_")
    stored = files.write_bucketed(clean, root, database, 8)
    net = measures.sale_net_revenue({**clean, **stored})
    return presentable(net.select("sale_id", "net_revenue"))


def _layout(spark: SparkSession, folder: str) -> DataFrame:
    """A date range read from the partitioned files."""
    stored = files.write_layout(tables(spark, folder, "clean"), fresh_path(spark, "layout"))
    return sales.sales_in_range(stored, RANGE_FROM, RANGE_UNTIL)


def _clustered(*keys: str) -> Query:
    """Lines looked up by some keys in a layout that is clustered by all of them; the time of
    a run includes storing it, whatever ran before."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        lines, root = measures.sale_lines(tables(spark, folder, "clean")), fresh_path(spark, "lines")
        clustered.write_clustered(lines, root, CLUSTER_KEYS, ["sale_item_id"], CLUSTER_FILES)
        wanted = {key: WANTED[key] for key in keys}
        return presentable(clustered.lookup(spark, root, lines.schema, **wanted))

    return run


def _filtered(key: str) -> Query:
    """Lines looked up by a key that they are not ordered by, through Bloom filters."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        lines = measures.sale_lines(tables(spark, folder, "clean"))
        path, order = fresh_path(spark, "lines"), ["sale_date", "sale_item_id"]
        stored = clustered.write_filtered(lines, path, order, ["product_id", "employee_id"])
        return presentable(stored.filter(F.col(key) == WANTED[key]))

    return run


def _key_filter(sales: DataFrame, blocks: int) -> DataFrame:
    """The filter of two loads, each added to what was there."""
    first, second = (
        stored(appended.key_filter(sales.filter(F.col("sale_id") % 2 == n), "sale_id", blocks), "keys")
        for n in range(2)
    )
    return stored(appended.united(first, second), "keys")


def _appended_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that a batch of late sales repeats: some it has twice, some are stored."""
    sales = tables(spark, folder, "raw")["sales"]
    known = sales.filter(F.col("sale_date") < BATCH_UNTIL)
    again, twice = F.col("sale_id") % 97 == 3, F.col("sale_id") % 89 == 5
    late = sales.filter(F.col("sale_date") >= BATCH_UNTIL)
    batch = late.unionByName(late.filter(twice)).unionByName(known.filter(again))
    blocks = appended.blocks_for(sales.count())
    return appended.repeated_keys(known, batch, "sale_id", _key_filter(known, blocks), blocks)


def _appended_items(spark: SparkSession, folder: str) -> DataFrame:
    """Sales that a batch of lines refers to and that are not stored."""
    sales = tables(spark, folder, "raw")["sales"].filter(F.col("sale_date") < BATCH_UNTIL)
    batch = tables(spark, folder, "bad")["sale_items"].filter(F.col("sale_id") % 9 == 0)
    blocks = appended.blocks_for(sales.count())
    return appended.orphans(sales, batch, "sale_id", _key_filter(sales, blocks), blocks)


def _default(t: Tables) -> DataFrame:
    omitted = t["sales"].drop("discount_amount")
    return constraints.with_defaults(omitted, TABLES["sales"]).select("sale_id", "discount_amount")


def _type_limits(t: Tables) -> DataFrame:
    """Prices as loaded from a wider source, some beyond the declared precision."""
    wide = F.expr(
        "if(product_id % 50 = 13, selling_price * 100000000BD, cast(selling_price as decimal(30,2)))"
    )
    products = t["products"].withColumn("selling_price", wide.cast("decimal(38,2)"))
    return constraints.type_limits({**t, "products": products})


def _make_numeric(t: Tables) -> DataFrame:
    text = people.branch_performance(t).select(
        "branch_id",
        F.when(F.col("branch_id") % 5 == 0, "n/a")
        .otherwise(F.col("net_revenue").cast("string"))
        .alias("net_revenue"),
        F.col("estimated_net_profit").cast("string").alias("estimated_net_profit"),
    )
    return dashboard.make_numeric(text, ["net_revenue", "estimated_net_profit", "not_there"])


def _first_present(t: Tables) -> DataFrame:
    return dashboard.counts_by_first_present(
        customers.customer_segments(t), dashboard.SEGMENT_COLUMNS, "customer_count"
    )


def queries() -> dict[str, Query]:
    clean = {
        "m_transaction_totals": _transaction_totals,
        "m_sale_net_revenue": lambda t: measures.sale_net_revenue(t).select(
            "sale_id", "net_revenue"
        ),
        "m_employee_net": measures.employee_net,
        "m_discount_allocation": _discount_allocation,
        "m_reference_date": _reference_date,
        "m_inventory_status": _inventory_status,
        "m_pct_change": _pct_change,
        "m_share_of_total": _share_of_total,
        "eda_overview": explore.overview,
        "eda_date_range": explore.date_range,
        "eda_category_overview": explore.category_overview,
        "eda_payment_mix": explore.payment_mix,
        "eda_branch_overview": explore.branch_overview,
        "eda_customer_type": explore.customer_type,
        "eda_customer_city": explore.customer_city,
        "eda_quantity_overview": explore.quantity_overview,
        "eda_margins": explore.margins,
        "eda_inventory_status": explore.inventory_overview,
        "eda_gold_prices": explore.gold_prices,
        "eda_monthly_trend": explore.monthly_trend,
        "eda_category_units": explore.category_units,
        "eda_supplier_products": explore.supplier_products,
        "sales_kpis": sales.kpis,
        "sales_monthly": sales.monthly,
        "sales_mom_growth": sales.month_growth,
        "sales_by_category": sales.by_category,
        "sales_by_payment": sales.by_payment,
        "sales_top_products": sales.top_products,
        "sales_by_weekday": sales.by_weekday,
        "sales_discounted_vs_not": sales.discounted_vs_not,
        "cust_kpis": customers.kpis,
        "cust_top20": customers.top_customers,
        "cust_frequency_groups": customers.frequency_groups,
        "cust_city_revenue": customers.city_revenue,
        "cust_valuable_inactive": customers.valuable_inactive,
        "cust_new_vs_returning": customers.new_vs_returning,
        "cust_rfm_scores": customers.rfm,
        "cust_rfm_segments": customers.rfm_segments,
        "inv_kpis": inventory.kpis,
        "prod_by_category": inventory.by_category,
        "inv_low_stock": inventory.low_stock,
        "inv_value_by_branch": inventory.value_by_branch,
        "prod_slow_moving": inventory.slow_moving,
        "prod_top20": inventory.top_products,
        "inv_overstock": inventory.overstock,
        "supplier_performance": inventory.supplier_performance,
        "branch_performance_detail": people.branch_performance_detail,
        "branch_rankings": people.branch_rankings,
        "employee_performance_detail": people.employee_performance_detail,
        "employee_rankings": people.employee_rankings,
        "employee_monthly_target": people.employee_monthly_target,
        "employee_target_summary": people.employee_target_summary,
        "branch_monthly_growth": people.branch_monthly_growth,
        "adv_cumulative_rolling": advanced.cumulative_rolling,
        "adv_product_rank": advanced.product_rank,
        "adv_pareto": advanced.pareto,
        "adv_branch_share": people.monthly_branch_share,
        "adv_gold_vs_sales": advanced.gold_vs_sales,
        **{f"v_{name}": build for name, build in views.VIEWS.items()},
        "x_sales_in_range": lambda t: sales.sales_in_range(t, RANGE_FROM, RANGE_UNTIL),
        "dash_kpis": dashboard.kpis,
        "dash_monthly_trend": dashboard.monthly_trend,
        "dash_branch_revenue": dashboard.branch_revenue,
        "dash_top_customers": dashboard.top_customers,
        "dash_segment_counts": dashboard.segment_counts,
        "dash_customer_table": dashboard.customer_table,
        "dash_top_products": dashboard.top_products,
        "dash_category_revenue": dashboard.category_revenue,
        "dash_inventory_status": dashboard.inventory_counts,
        "dash_inventory_table": dashboard.inventory_table,
        "dash_branch_options": dashboard.branch_options,
        "dash_employee_filter": lambda t: dashboard.employees(t, SELECTED_BRANCH),
        "dash_top_employees": dashboard.top_employees,
        "dash_employee_table": lambda t: dashboard.employee_table(t, SELECTED_BRANCH),
        "dash_make_numeric": _make_numeric,
        "dash_first_present_column": _first_present,
        "gen_date_spine": generate.date_spine,
        "gen_average_price": generate.average_price,
        "gen_eligible_employees": generate.eligible_employees,
        "gen_eligible_employee_lists": lambda t: generate.eligible_lists(t).select(
            "sale_id", "eligible_employees", "list_hash"
        ),
        "gen_earliest_employee": generate.earliest_employee,
        "gen_fallback_sale_day": generate.fallback_sale_day,
        "gen_eligible_customers": generate.eligible_customers,
        **{f"clean_{name}": (lambda t, name=name: t[name]) for name in TABLES},
    }
    raw = {
        "k_default": _default,
        "dq_row_counts": quality.row_counts,
        "dq_missing_customers": quality.missing_customers,
        "dq_missing_suppliers": quality.missing_suppliers,
        "dq_walk_in_sales": quality.walk_in_sales,
        "dq_duplicate_customers": quality.duplicate_customers,
        "dq_duplicate_sale_items": quality.duplicate_sale_items,
        "dq_sale_before_registration": quality.sale_before_registration,
        "dq_sale_before_hire": quality.sale_before_hire,
        "dq_sale_before_opening": quality.sale_before_opening,
        "dq_branch_mismatch": quality.branch_mismatch,
    }
    bad = {
        "k_not_null": constraints.not_null,
        "k_primary_key": constraints.primary_key,
        "k_unique": constraints.unique,
        "k_check": constraints.check,
        "k_foreign_key": constraints.foreign_key,
        "k_type_limits": _type_limits,
        "k_not_future": lambda t: constraints.not_future(t["branches"], AS_OF),
        "dq_invalid_products": lambda t: quality.invalid_rows(t, "products"),
        "dq_invalid_sale_items": lambda t: quality.invalid_rows(t, "sale_items"),
        "dq_invalid_inventory": lambda t: quality.invalid_rows(t, "inventory"),
        "dq_invalid_discounts": lambda t: quality.invalid_rows(t, "sales"),
        "dq_invalid_gold_prices": lambda t: quality.invalid_rows(t, "gold_prices"),
        "dq_orphan_sales_customer": quality.orphan_sales_customer,
        "dq_orphan_sales_employee": quality.orphan_sales_employee,
        "dq_orphan_sale_items": quality.orphan_sale_items,
        "clean_quarantine": constraints.quarantine_summary,
    }
    return {
        **{name: _on("clean", report) for name, report in clean.items()},
        **{name: _on("raw", report) for name, report in raw.items()},
        **{name: _on("bad", report) for name, report in bad.items()},
        "k_appended_primary_key": _appended_sales,
        "k_appended_foreign_key": _appended_items,
        "io_csv_rejects": _csv_rejects,
        "io_insert_ignore": _insert_ignore,
        "io_csv_scan": _csv_scan,
        "io_csv_sink": _csv_sink,
        "io_create_layers": _create_layers,
        "io_full_refresh": _full_refresh,
        "io_views": _views,
        "io_query_to_frame": _query_to_frame,
        "io_cached_mart": _cached_mart,
        "x_layout": _layout,
        "x_clustered_customer": _clustered("customer_id"),
        "x_clustered_branch": _clustered("branch_id"),
        "x_clustered_product": _clustered("product_id"),
        "x_clustered_branch_product": _clustered("branch_id", "product_id"),
        "x_filtered_product": _filtered("product_id"),
        "x_filtered_employee": _filtered("employee_id"),
        "facts_executive_summary": _on_facts(views.executive_summary),
        "facts_sales_monthly": _on_facts(sales.monthly),
        "facts_sales_in_range": _on_facts(
            lambda t: sales.sales_in_range(t, RANGE_FROM, RANGE_UNTIL)
        ),
        "facts_bucketed_net_revenue": _bucketed,
        "io_refresh_months": _refresh_months,
        "mart_monthly_sales_summary": _on_mart(marts.monthly_sales_summary),
        "mart_executive_summary": _on_mart(marts.executive_summary),
        "mart_yearly_customers": _on_mart(marts.yearly_customers),
        "mart_branch_customers": _on_mart(marts.branch_customers),
    }
