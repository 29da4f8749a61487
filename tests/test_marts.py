from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.registry import _batches, tables
from countinghouse.operators.measures import sale_facts
from countinghouse.plans import marts, views
from countinghouse.session import fresh_path
from countinghouse.sources.versioned import Conflict, VersionedTable
from tests.conftest import FOLDER


def state(mart):
    """Sums and customers as plain values."""
    sums = sorted(map(tuple, mart.sums().collect()), key=str)
    buyers = sorted(
        (str(r.sales_month), r.branch_id, r.bucket, bytes(r.buyers)) for r in mart.buyers().collect()
    )
    return sums, buyers


def report(df):
    return sorted((sorted(row.asDict().items()) for row in df.collect()), key=repr)


def some(shop, *sales):
    listed = ", ".join(map(str, sales))
    return {
        **shop,
        "sales": shop["sales"].filter(f"sale_id in ({listed})"),
        "sale_items": shop["sale_items"].filter(f"sale_id in ({listed})"),
    }


@pytest.fixture
def mart(spark, shop):
    return marts.SalesMart.of(shop, fresh_path(spark, "mart"))


def test_three_appends_equal_a_full_build(spark):
    clean = tables(spark, FOLDER, "clean")
    grown, whole = (marts.SalesMart.of(clean, fresh_path(spark, "mart")) for _ in range(2))
    for batch in _batches(clean):
        grown.append(batch)
        assert grown.update()
    whole.append(clean)
    whole.update()
    assert state(grown) == state(whole)
    for name in ("monthly_sales_summary", "executive_summary"):
        from_lines = getattr(views, name)(clean)
        from_mart = getattr(marts, name)(grown)
        assert sorted(from_mart.columns) == sorted(from_lines.columns)
        assert report(from_mart) == report(from_lines)


def test_an_update_reads_only_what_was_appended(spark, mart, shop):
    for sales in ((101,), (102, 103)):
        mart.append(some(shop, *sales))
        mart.update()
    before = mart.state.latest()
    mart.append(some(shop, 105))
    new, version = mart.appended()
    known = set(mart.facts.at(2).parts[""])
    (folder,) = set(version.parts[""]) - known
    assert new.inputFiles() and all(folder in file for file in new.inputFiles())
    assert mart.update() == ["2024-07-01"]
    after = mart.state.latest()
    changed = {x for x in after.parts if after.parts[x] != before.parts.get(x)}
    assert changed == {"sums/2024-07-01", "buyers/2024-07-01"}
    assert mart.update() == [] and mart.state.latest() == after


def test_late_sales_change_their_month(spark, mart, shop):
    mart.append(some(shop, 103, 105))
    mart.update()
    mart.append(some(shop, 101, 102))
    assert mart.update() == ["2024-01-01", "2024-03-01"]
    assert report(marts.monthly_sales_summary(mart)) == report(views.monthly_sales_summary(shop))
    assert report(marts.executive_summary(mart)) == report(views.executive_summary(shop))


def test_a_broken_off_update_is_made_good(spark, mart, shop, monkeypatch):
    mart.append(shop)
    with monkeypatch.context() as patch:
        def lost(*_, **__):
            raise OSError("lost")

        patch.setattr(VersionedTable, "commit", lost)
        with pytest.raises(OSError, match="lost"):
            mart.update()
    assert mart.sums().count() == 0
    mart.update()
    assert report(marts.executive_summary(mart)) == report(views.executive_summary(shop))


def test_of_two_updates_one_counts(spark, mart, shop, monkeypatch):
    mart.append(shop)
    commit, calls = VersionedTable.commit, []

    def slower(self, base, parts, **marks):
        if not calls:
            calls.append(1)
            monkeypatch.setattr(VersionedTable, "commit", commit)
            assert mart.update()  # another one gets in before
            raise Conflict("taken")
        return commit(self, base, parts, **marks)

    monkeypatch.setattr(VersionedTable, "commit", slower)
    assert mart.update() == []
    assert report(marts.executive_summary(mart)) == report(views.executive_summary(shop))


def test_customers_of_years_and_branches(spark, mart, shop):
    mart.append(shop)
    mart.update()
    assert [tuple(r) for r in marts.yearly_customers(mart).collect()] == [(2024, 2)]
    assert [tuple(r) for r in marts.branch_customers(mart).collect()] == [(1, 2, 2), (2, 2, 1)]


def test_wide_and_negative_customer_ids(spark, shop):
    ids = [0, 1, -1, 32_767, 32_768, -32_768, 1 << 40, -(1 << 40)]
    sales = spark.createDataFrame(
        [(200 + n, c, 1, 1, datetime(2024, 1 + n % 2, 1), "Cash", Decimal(0)) for n, c in enumerate(ids * 2)],
        shop["sales"].schema,
    )
    items = spark.createDataFrame(
        [(f"i{n}", 200 + n, 11, 1, Decimal(1)) for n in range(2 * len(ids))], shop["sale_items"].schema
    )
    mart = marts.SalesMart.of(shop, fresh_path(spark, "mart"))
    mart.append({**shop, "sales": sales, "sale_items": items})
    mart.update()
    assert marts.executive_summary(mart).first().registered_customers == len(ids)


def test_nothing_appended(spark, mart, nothing):
    assert mart.update() == []
    mart.append(nothing)
    assert mart.update() == []
    assert marts.monthly_sales_summary(mart).count() == 0
    row = marts.executive_summary(mart).first()
    assert (row.total_transactions, row.registered_customers, row.active_branches) == (0, 0, 0)


def test_facts_keep_their_schema(spark, mart, shop):
    mart.append(shop)
    assert mart.facts.read().schema.names == sale_facts(shop).schema.names
    assert mart.facts.read().filter(F.col("sales_month").isNull()).isEmpty()
