"""Edge cases on a shop that can be checked by hand."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from countinghouse.operators import measures
from countinghouse.plans import (
    advanced,
    customers,
    dashboard,
    explore,
    generate,
    inventory,
    people,
    sales,
    views,
)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_sale_without_items_is_no_transaction(shop):
    row = sales.kpis(shop).first()
    assert (row.total_transactions, row.total_units_sold) == (4, 6)
    assert row.gross_revenue == 10 + 20 + 20 + 20.01 + 9.99
    assert row.total_discounts == 3.0
    assert row.net_revenue == 77.0
    assert row.average_transaction_value == 19.25
    assert row.estimated_net_profit == pytest.approx(4 + 5 + 8 + 5.01 + 3.99 - 3)


def test_month_before_is_the_previous_month_with_sales(shop):
    rows = by(sales.month_growth(shop), "sales_month")
    assert list(rows) == [date(2024, 1, 1), date(2024, 3, 1), date(2024, 7, 1)]
    assert rows[date(2024, 1, 1)].monthly_growth_percentage is None
    assert rows[date(2024, 3, 1)].previous_month_revenue == 27.0
    assert rows[date(2024, 3, 1)].monthly_growth_percentage == 48.19  # 40.01 after 27


def test_discount_is_shared_in_proportion(shop):
    rows = by(sales.by_category(shop), "category")
    assert rows["Ring"].allocated_discounts == 1.0
    assert rows["Chain"].allocated_discounts == 2.0
    assert rows["Ring"].transaction_count == 3


def test_allocation_adds_up(shop):
    lines = measures.discount_allocation(shop)
    totals = lines.groupBy("sale_id").agg(F.sum("allocated_discount").alias("d"))
    assert {r.sale_id: float(r.d) for r in totals.collect()} == {101: 3, 102: 0, 103: 0, 105: 0}
    assert lines.count() == 5


def test_sale_without_revenue_has_no_allocation(spark, shop):
    free = shop["sale_items"].withColumn("unit_price", F.lit(0).cast("decimal(14,2)"))
    lines = measures.discount_allocation({**shop, "sale_items": free})
    assert {r.allocated_discount for r in lines.collect()} == {None}
    row = by(sales.by_category({**shop, "sale_items": free}), "category")["Ring"]
    assert (row.gross_revenue, row.net_revenue) == (0.0, None)


def test_walk_in_sales_belong_to_no_customer(shop):
    row = customers.kpis(shop).first()
    assert row.customers_with_purchases == 2
    assert (row.one_time_customers, row.repeat_customers) == (1, 1)
    assert row.repeat_customer_percentage == 50.0
    assert row.registered_customer_revenue == 27 + 20 + 9.99
    assert sum(r.transaction_count for r in explore.customer_type(shop).collect()) == 5


def test_frequency_counts_sales_without_items(shop):
    rows = by(customers.frequency_groups(shop), "customer_group")
    assert rows["One-time Customer"].customer_count == 2
    assert rows["Occasional Customer"].customer_count == 1


def test_new_and_returning_customers(shop):
    rows = by(customers.new_vs_returning(shop), "sales_month")
    july = rows[date(2024, 7, 1)]
    assert (july.new_customers, july.returning_customers, july.active_customers) == (0, 1, 1)


def test_customer_without_purchase_stays_in_the_summary(shop):
    row = by(views.customer_summary(shop), "customer_id")[3]
    assert (row.purchase_count, row.total_spent, row.average_transaction_value) == (0, 0.0, 0.0)
    assert row.last_purchase_date is None


def test_inactive_means_more_than_180_days(spark, shop):
    assert customers.valuable_inactive(shop).count() == 0  # Bob: 150 days before 29 July
    later = shop["sales"].withColumn(
        "sale_date",
        F.when(F.col("sale_id") == 105, F.lit("2024-08-28 09:00:00").cast("timestamp_ntz"))
        .otherwise(F.col("sale_date")),
    )
    assert customers.valuable_inactive({**shop, "sales": later}).count() == 0  # exactly 180
    later = later.withColumn(
        "sale_date",
        F.when(F.col("sale_id") == 105, F.lit("2024-08-29 09:00:00").cast("timestamp_ntz"))
        .otherwise(F.col("sale_date")),
    )
    row = customers.valuable_inactive({**shop, "sales": later}).first()
    assert (row.customer_id, row.days_inactive) == (2, 181)


def test_scores_with_fewer_customers_than_tiles(shop):
    rows = by(customers.rfm(shop), "customer_id")
    assert (rows[1].recency_days, rows[1].frequency) == (1, 2)
    assert rows[1].monetary_value == 36.99
    assert [rows[1][s] for s in ("recency_score", "frequency_score", "monetary_score")] == [2, 2, 2]
    assert [rows[2][s] for s in ("recency_score", "frequency_score", "monetary_score")] == [1, 1, 1]
    assert rows[2].city == "Unknown"


@pytest.mark.parametrize(
    ("scores", "expected"),
    [
        ((5, 5, 5, 9), "Champions"),
        ((2, 3, 5, 9), "At Risk"),
        ((4, 2, 1, 1), "New Customers"),
        ((3, 4, 3, 9), "Loyal Customers"),
        ((4, 3, 1, 2), "Potential Loyalists"),
        ((2, 2, 5, 2), "Hibernating"),
        ((3, 3, 5, 2), "Needs Attention"),
    ],
)
def test_first_matching_segment_wins(spark, scores, expected):
    frame = spark.createDataFrame(
        [scores], "recency_score int, frequency_score int, monetary_score int, frequency long"
    )
    assert frame.select(customers.segment()).first()[0] == expected


def test_branch_without_sales(shop):
    detail = by(people.branch_performance_detail(shop), "branch_id")[3]
    assert (detail.transaction_count, detail.net_revenue) == (0, None)
    view = by(people.branch_performance(shop), "branch_id")[3]
    assert (view.net_revenue, view.average_transaction_value) == (0.0, 0.0)
    ranks = by(people.branch_rankings(shop), "branch_id")
    assert [ranks[b].revenue_rank for b in (1, 2, 3)] == [1, 2, 3]
    assert [ranks[b].transaction_rank for b in (1, 2, 3)] == [1, 1, 3]


def test_employee_ranks_share_places(shop):
    rows = by(people.employee_rankings(shop), "employee_id")
    assert (rows[1].rank_within_branch, rows[3].rank_within_branch) == (1, 2)
    assert [rows[e].overall_rank for e in (1, 2, 3)] == [1, 2, 3]


def test_zero_target_is_achieved_without_a_percentage(shop):
    rows = [r for r in people.employee_monthly_target(shop).collect() if r.employee_id == 2]
    assert {r.target_achievement_percentage for r in rows} == {None}
    assert {r.target_status for r in rows} == {"Target Achieved"}
    row = by(people.employee_target_summary(shop), "employee_id")[2]
    assert row.target_success_rate_percentage == 100.0
    assert row.average_target_achievement_percentage is None


def test_unsold_product(shop):
    row = by(inventory.slow_moving(shop), "product_id")[13]
    assert (row.product_status, row.total_units_sold) == ("Never Sold", 0)
    assert by(inventory.product_performance(shop), "product_id")[13].gross_revenue == 0.0
    assert by(inventory.by_category(shop), "category")["Ring"].average_product_price == 8.0


def test_stock_risk(shop):
    rows = by(inventory.overstock(shop), "product_id")
    assert rows[13].inventory_risk == "Normal Stock"  # nothing sold, nothing in stock
    assert rows[12].inventory_risk == "No Recent Sales"
    assert 11 not in rows  # one in stock, one sold in the last 90 days


def test_ninety_days_back_is_not_recent(shop):
    """The window is open at its start."""
    moved = shop["sales"].withColumn(
        "sale_date",
        F.when(F.col("sale_id") == 103, F.lit("2024-04-30 12:00:00").cast("timestamp_ntz"))
        .otherwise(F.col("sale_date")),
    )
    assert by(inventory.overstock({**shop, "sales": moved}), "product_id")[
        12
    ].units_sold_last_90_days == 0
    moved = moved.withColumn(
        "sale_date",
        F.when(F.col("sale_id") == 103, F.lit("2024-05-01 12:00:00").cast("timestamp_ntz"))
        .otherwise(F.col("sale_date")),
    )
    row = by(inventory.overstock({**shop, "sales": moved}), "product_id")[12]
    assert (row.units_sold_last_90_days, row.inventory_risk) == (1, "Potential Overstock")
    assert row.stock_to_recent_sales_ratio == 9.0


def test_supplier_without_products(shop):
    row = by(inventory.supplier_performance(shop), "supplier_id")[2]
    assert (row.products_supplied, row.units_sold, row.gross_revenue) == (0, 0, 0.0)


def test_exactly_eighty_percent_belongs_to_the_top(spark, shop):
    items = spark.createDataFrame(
        [("a", 101, 11, 8, 1), ("b", 101, 12, 2, 1)],
        "sale_item_id string, sale_id long, product_id long, quantity int, p int",
    ).withColumn("unit_price", F.col("p").cast("decimal(14,2)")).drop("p")
    rows = by(advanced.pareto({**shop, "sale_items": items}), "product_id")
    assert rows[11].pareto_group == "Top Revenue Contributors"
    assert rows[12].pareto_group == "Remaining Products"
    assert rows[12].cumulative_revenue_percentage == 100.0


def test_rolling_mean_is_partial_at_the_start(shop):
    rows = by(advanced.cumulative_rolling(shop), "sales_month")
    assert rows[date(2024, 1, 1)].three_month_rolling_average == 27.0
    assert rows[date(2024, 7, 1)].cumulative_net_revenue == 77.0
    assert rows[date(2024, 7, 1)].three_month_rolling_average == 25.67


def test_price_is_compared_over_shared_months(shop):
    rows = advanced.gold_vs_sales(shop).collect()
    assert [r.sales_month.month for r in rows] == [1, 3]
    assert rows[0].average_24k_price_per_gram == 100.5
    assert rows[1].gold_price_change_percentage == 9.45


def test_totals_agree_across_reports(shop):
    total = sales.kpis(shop).first().net_revenue
    for report in (sales.monthly, sales.by_payment, sales.by_weekday, sales.by_category):
        assert sum(r.net_revenue for r in report(shop).collect()) == pytest.approx(total)


def test_range_is_half_open(shop):
    found = sales.sales_in_range(shop, "2024-01-31 23:59:59", "2024-03-10 09:00:00")
    assert {r.sale_id for r in found.collect()} == {101, 102}


def test_branch_filter(shop):
    assert dashboard.employees(shop).count() == 3
    assert {r.employee_id for r in dashboard.employees(shop, "North").collect()} == {1, 3}
    options = [r.branch_name for r in dashboard.branch_options(shop).collect()]
    assert options == ["All Branches", "North", "South"]


def test_top_lists_end_with_the_largest(shop):
    rows = dashboard.top_products(shop, top=2).collect()
    assert [r.product_id for r in rows] == [11, 12]  # 39.99 and 40.01


def test_eligible_employees_by_brute_force(shop):
    staff = shop["employees"].collect()
    found = by(generate.eligible_employees(shop), "sale_id")
    for sale in shop["sales"].collect():
        able = sum(
            e.branch_id == sale.branch_id and e.hire_date <= sale.sale_date.date() for e in staff
        )
        assert found[sale.sale_id].eligible_employees == able


def test_eligible_customers_by_brute_force(shop):
    days = [c.registration_date for c in shop["customers"].collect()]
    found = by(generate.eligible_customers(shop), "sale_id")
    for sale in shop["sales"].collect():
        expected = sum(d <= sale.sale_date.date() for d in days)
        assert found[sale.sale_id].eligible_customers == expected


def test_reports_on_empty_tables(nothing):
    assert sales.kpis(nothing).first().total_transactions == 0
    assert sales.kpis(nothing).first().average_transaction_value is None
    for report in (
        sales.month_growth, sales.by_category, sales.top_products, customers.rfm,
        customers.rfm_segments, customers.top_customers, people.employee_rankings,
        advanced.pareto, advanced.product_rank, inventory.overstock, explore.payment_mix,
    ):
        assert report(nothing).count() == 0
