from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks.registry import tables
from countinghouse.operators import constraints, quality
from countinghouse.schemas import TABLES
from tests.conftest import FOLDER


def test_clean_tables_pass(shop):
    constraints.enforce(shop)


def test_enforce_names_the_broken_rule(shop):
    broken = shop["sales"].withColumn("discount_amount", F.lit(-1).cast("decimal(12,2)"))
    with pytest.raises(constraints.RuleViolation, match="sales.discount_amount: 5"):
        constraints.enforce({**shop, "sales": broken})


def test_null_passes_a_check_but_not_a_required_column(shop):
    unknown = shop["sales"].withColumn("discount_amount", F.lit(None).cast("decimal(12,2)"))
    t = {**shop, "sales": unknown}
    assert all(r.violations == 0 for r in constraints.check(t).collect())
    found = {(r.table_name, r.column_name): r.violations for r in constraints.not_null(t).collect()}
    assert found["sales", "discount_amount"] == 5
    assert ("sales", "customer_id") not in found


def test_default_fills_only_an_omitted_column(shop):
    spec = TABLES["sales"]
    omitted = constraints.with_defaults(shop["sales"].drop("discount_amount"), spec)
    assert {str(r.discount_amount) for r in omitted.collect()} == {"0.00"}
    explicit = shop["sales"].withColumn("discount_amount", F.lit(None).cast("decimal(12,2)"))
    kept = constraints.with_defaults(explicit, spec)
    assert {r.discount_amount for r in kept.collect()} == {None}


def test_quarantine_keeps_every_row(spark):
    bad = tables(spark, FOLDER, "bad")
    valid, rejected = constraints.quarantine(bad)
    for name in TABLES:
        assert valid[name].count() + rejected[name].count() == bad[name].count(), name
    constraints.enforce(valid)


def test_children_of_rejected_parents_are_rejected(shop):
    twice = shop["branches"].unionByName(shop["branches"].filter("branch_id = 2"))
    valid, rejected = constraints.quarantine({**shop, "branches": twice})
    assert rejected["branches"].count() == 2
    assert {r.sale_id for r in rejected["sales"].collect()} == {103, 104, 105}
    reasons = {r.sale_item_id: r.reasons for r in rejected["sale_items"].collect()}
    assert reasons == {"d": ["foreign_key:sale_id"], "e": ["foreign_key:sale_id"]}


def test_orphans_include_unknown_keys_only_where_required(spark, shop):
    moved = shop["sales"].withColumn(
        "employee_id", F.when(F.col("sale_id") == 101, None).otherwise(F.col("employee_id"))
    )
    t = {**shop, "sales": moved}
    assert [r.sale_id for r in quality.orphan_sales_employee(t).collect()] == [101]
    assert quality.orphan_sales_customer(t).count() == 0
    lost = shop["sale_items"].withColumn(
        "product_id", F.when(F.col("sale_item_id") == "a", 99).otherwise(F.col("product_id"))
    )
    assert quality.orphan_sale_items({**shop, "sale_items": lost}).count() == 1


@pytest.mark.parametrize(
    ("report", "expected"),
    [
        (lambda t: quality.invalid_rows(t, "products"), 8),
        (lambda t: quality.invalid_rows(t, "sale_items"), 192),
        (lambda t: quality.invalid_rows(t, "inventory"), 40),
        (lambda t: quality.invalid_rows(t, "sales"), 19),
        (lambda t: quality.invalid_rows(t, "gold_prices"), 7),
        (quality.orphan_sales_customer, 15),
        (quality.orphan_sales_employee, 16),
        (quality.orphan_sale_items, 123),
    ],
)
def test_known_numbers_of_violations(spark, report, expected):
    assert report(tables(spark, FOLDER, "bad")).count() == expected


def test_too_long_text_is_rejected(spark):
    bad = tables(spark, FOLDER, "bad")
    valid, rejected = constraints.quarantine(bad)
    reasons = {x for r in rejected["customers"].select("reasons").collect() for x in r.reasons}
    assert "type:phone" in reasons
    assert valid["customers"].filter("length(phone) > 30").count() == 0
    with pytest.raises(constraints.RuleViolation, match="customers.phone"):
        constraints.enforce(bad)
