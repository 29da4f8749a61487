"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from checks.registry import queries
from tests.conftest import FOLDER


#: Queries whose feature is to write files, and ones that store an order or valid keys.
WRITES = {"k_appended_primary_key", "k_appended_foreign_key", "io_csv_scan", "io_csv_rejects", "io_csv_sink", "io_insert_ignore", "io_create_layers", "io_full_refresh",
          "io_views", "io_query_to_frame", "io_cached_mart", "x_layout",
          "facts_executive_summary", "facts_sales_monthly", "facts_sales_in_range",
          "facts_bucketed_net_revenue", "io_refresh_months", "mart_monthly_sales_summary",
          "mart_executive_summary", "mart_yearly_customers", "mart_branch_customers",
          "x_clustered_customer", "x_clustered_branch", "x_clustered_product",
          "x_clustered_branch_product", "x_filtered_product", "x_filtered_employee"}
STORES = {"cust_rfm_scores", "cust_rfm_segments", "v_customer_segments",
          "dash_segment_counts", "dash_first_present_column", "employee_rankings",
          "adv_product_rank", "adv_pareto", "clean_quarantine", "gen_eligible_employee_lists"}


def plan_of(spark, name: str) -> str:
    return queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored_plans(monkeypatch):
    """The plans of what is stored or checkpointed while a query is built."""
    from countinghouse import session
    from countinghouse.functions import ordering
    from countinghouse.operators import constraints
    from countinghouse.plans import customers, people

    seen = []

    def watched(step):
        def run(df, *rest):
            seen.append(df._jdf.queryExecution().executedPlan().toString())
            return step(df, *rest)

        return run

    for module in (session, ordering, constraints, customers, people):
        for name in ("stored", "checkpointed"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, watched(getattr(session, name)))
    return seen


def windows_without_key(plan: str) -> list[str]:
    lines = [x for x in plan.splitlines() if re.search(r"\bWindow \[", x)]
    return [x for x in lines if not re.search(r"\)\) AS \S+\], \[\w", x)]


@pytest.mark.parametrize("name", sorted(STORES))
def test_no_single_task_window_over_rows(spark, stored_plans, name):
    """Windows without a partition key run over one row per partition or per segment."""
    plans = [plan_of(spark, name), *stored_plans]
    assert len(plans) > 1
    for plan in plans:
        for line in windows_without_key(plan):
            assert "_amount" in line or "sum(customer_count" in line, line


@pytest.mark.parametrize("name", list(queries()))
def test_no_cross_join_and_no_row_by_row_python(spark, stored_plans, name):
    plan = plan_of(spark, name)
    assert bool(stored_plans) == (name in STORES or name == "io_views")
    for text in (plan, *stored_plans):
        assert "CartesianProduct" not in text
        assert "BroadcastNestedLoopJoin" not in text
        assert "PythonUDF" not in text and "EvalPython" not in text


@pytest.mark.parametrize("name", sorted(set(queries()) - WRITES - STORES))
def test_building_a_report_runs_no_job(spark, name):
    context = spark.sparkContext
    context.setJobGroup(f"building-{name}", name)
    try:
        queries()[name](spark, FOLDER)
        assert not context.statusTracker().getJobIdsForGroup(f"building-{name}")
    finally:
        context.setJobGroup("tests", "tests")


#: Ids of entities that may be many; a report with such a column has a row for each.
MANY = {"customer_id", "product_id", "employee_id", "supplier_id", "inventory_id", "sale_id",
        "sale_item_id"}
#: Reports with many rows whose key is not an id, or not among their columns.
OTHER_KEYS = {"dq_duplicate_customers": "phone", "dash_inventory_table": "inventory_id",
              "employee_monthly_target": "sales_month", "dash_employee_table": "employee_name"}


@pytest.mark.parametrize("name", sorted(set(queries()) - WRITES))
def test_sorts_of_entities_can_be_split(spark, name):
    """A sort over a row for each entity ends in its id, so equal values can be dealt out."""
    report = queries()[name](spark, FOLDER)
    keys = MANY & set(report.columns) | {OTHER_KEYS[name]} if name in OTHER_KEYS else MANY & set(report.columns)
    plan = report._jdf.queryExecution().executedPlan().toString()
    for order in re.findall(r"Exchange rangepartitioning\((.*?), \d+\)", plan) if keys else []:
        last = re.match(r" ?(\w+)#", order.split(",")[-1])
        assert last and last.group(1) in keys, (order, keys)


def test_only_needed_columns_are_read(spark):
    plan = plan_of(spark, "sales_mom_growth")
    (lineitem,) = set(re.findall(r"ReadSchema: (struct<l_\S+>)", plan))
    assert lineitem == "struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double>"


def test_lines_are_summed_before_the_shuffle(spark):
    plan = plan_of(spark, "m_sale_net_revenue")
    assert "partial_sum" in plan
    assert plan.count("Exchange hashpartitioning") <= 2


def test_top_lists_use_a_bounded_sort(spark):
    for name in ("cust_top20", "cust_valuable_inactive", "prod_top20", "sales_top_products",
                 "dash_top_customers", "dash_top_products", "dash_top_employees"):
        assert "TakeOrderedAndProject" in plan_of(spark, name)
