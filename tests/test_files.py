from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.registry import tables
from countinghouse.plans import advanced, customers, people, sales, views
from countinghouse.session import fresh_path, shared_dir
from countinghouse.sources import files
from tests.conftest import FOLDER


@pytest.fixture(scope="module")
def shop(spark, shop):
    """The shop with one line of an unknown product, which some reports leave out."""
    extra = spark.createDataFrame(
        [("z", 104, 99, 2, Decimal("7.00"))], shop["sale_items"].schema
    )
    known = shop["sale_items"].unionByName(extra).filter("sale_item_id <> 'none'")
    return {**shop, "sale_items": known}


@pytest.fixture(scope="module")
def facts(spark, shop):
    return files.with_sale_facts(shop, fresh_path(spark, "facts"))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_csv_text_survives(spark, tmp_path):
    (tmp_path / "suppliers.csv").write_text(
        "supplier_id,supplier_name,city,phone\n"
        '1,"Hill, Dale and Sons",Oldtown,0970123\n'
        '2,"The ""Best""",,\n'
        "3,  padded ,Newtown,091\n"
    )
    rows = files.read_csv(spark, str(tmp_path / "suppliers.csv"), "suppliers").collect()
    assert rows[0].supplier_name == "Hill, Dale and Sons"
    assert rows[0].phone == "0970123"
    assert rows[1].supplier_name == 'The "Best"'
    assert (rows[1].city, rows[1].phone) == (None, None)
    assert rows[2].supplier_name == "  padded "


def test_bad_csv_fails_the_load(spark, tmp_path):
    (tmp_path / "gold_types.csv").write_text("gold_type_id,gold_type_name\nx,24K\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv(spark, str(tmp_path / "gold_types.csv"), "gold_types").collect()


def test_csv_round_trip_of_every_table(spark, shop):
    root = fresh_path(spark, "csv")
    for name, df in shop.items():
        files.write_csv(df, f"{root}/{name}.csv")
    loaded = files.load_folder(spark, root, "csv")
    for name, df in shop.items():
        assert sorted(loaded[name].collect(), key=repr) == sorted(df.collect(), key=repr), name


def test_full_refresh_replaces_the_layer(spark, shop):
    root = fresh_path(spark, "cleaned")
    first = files.full_refresh(shop, root)
    files.full_refresh({**shop, "sales": shop["sales"].limit(2)}, root)
    loaded = files.current_layer(spark, root)
    assert loaded["sales"].count() == 2
    assert loaded["customers"].count() == 3
    assert first["sales"].count() == 5  # a reader of the old layer is not disturbed


def test_a_failed_refresh_leaves_the_layer(spark, shop):
    root = fresh_path(spark, "cleaned")
    files.full_refresh(shop, root)
    broken = shop["sales"].withColumn("discount_amount", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        files.full_refresh({"branches": shop["branches"].limit(0), "sales": broken}, root)
    assert files.current_layer(spark, root)["branches"].count() == 3


def test_mart_is_shared_until_it_is_too_old(spark):
    path, built = fresh_path(spark, "mart"), []

    def build():
        built.append(1)
        return spark.range(len(built))

    assert [files.cached_mart(spark, build, path).count() for _ in range(3)] == [1, 1, 1]
    assert files.cached_mart(spark, build, path, max_age=-1).count() == 2
    assert len(built) == 2


def test_insert_ignore_stores(spark):
    path = fresh_path(spark, "stored")
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(path)
    new = spark.createDataFrame([(1, "x"), (2, "d"), (2, "c")], "k int, v string")
    files.insert_ignore_into(spark, path, new, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")]


def test_views_show_what_is_stored_now(spark, shop):
    path = fresh_path(spark, "sales")
    shop["sales"].filter("sale_id <= 103").write.parquet(path)

    def loaded():
        return {**shop, "sales": spark.read.schema(shop["sales"].schema).parquet(path)}

    assert "now_customer_segments" not in views.register_views(loaded(), "now_")
    text = "select sum(transaction_count) from now_monthly_sales_summary"
    segments = "select count(*) from now_customer_segments"
    assert spark.sql(text).first()[0] == 3
    assert views.query(spark, segments, loaded(), "now_").first()[0] == 2
    later = shop["sales"].filter("sale_id = 105").withColumn("customer_id", F.lit(3))
    later.select(*shop["sales"].columns).write.mode("append").parquet(path)
    assert views.query(spark, text, loaded(), "now_").first()[0] == 4
    assert views.query(spark, segments, loaded(), "now_").first()[0] == 3


def test_fetch_is_bounded(spark):
    assert len(views.fetch(spark.range(3), 3)) == 3
    with pytest.raises(ValueError, match="more than 2"):
        views.fetch(spark.range(3), 2)


def test_insert_ignore_keeps_the_stored_row(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, files.insert_ignore(stored, new, "k").collect())) == [
        (1, "a"), (2, "b"), (3, "c"),
    ]


def test_month_layout_reads_only_the_month(spark):
    stored = files.write_layout(tables(spark, FOLDER, "clean"), fresh_path(spark, "layout"))
    found = sales.sales_in_range(stored, "1998-01-01 00:00:00", "1998-02-01 00:00:00")
    plan = _plan(found)
    assert "PartitionFilters: [isnotnull(sales_month" in plan
    assert "sales_month >= 1998-01-01" in plan or "sales_month#" in plan
    assert "GreaterThanOrEqual(sale_date" in plan  # pushed to the files
    plain = sales.sales_in_range(
        tables(spark, FOLDER, "clean"), "1998-01-01 00:00:00", "1998-02-01 00:00:00"
    )
    assert sorted(found.collect()) == sorted(plain.collect())


@pytest.mark.parametrize(
    "report",
    [
        sales.kpis, sales.monthly, sales.month_growth, sales.by_payment, sales.by_weekday,
        sales.discounted_vs_not, customers.top_customers, customers.rfm, customers.city_revenue,
        people.branch_performance_detail, people.branch_rankings, people.employee_rankings,
        people.employee_monthly_target, people.branch_monthly_growth, views.executive_summary,
        views.monthly_sales_summary, views.customer_summary, advanced.gold_vs_sales,
    ],
)
def test_reports_on_stored_sale_facts(shop, facts, report):
    def rows(df):
        return sorted((sorted(r.asDict().items()) for r in df.collect()), key=repr)

    assert rows(report(facts)) == rows(report(shop))


def test_sale_facts_replace_the_lines(facts):
    """Without items in reach the reports still work, so none of them reads the lines."""
    alone = {name: df for name, df in facts.items() if name != "sale_items"}
    assert views.executive_summary(alone).first().total_transactions == 4
    plan = _plan(sales.sales_in_range(alone, "2024-03-01 00:00:00", "2024-04-01 00:00:00"))
    assert "PartitionFilters: [isnotnull(sales_month" in plan and "Exchange" not in plan


def test_bucketed_facts_join_without_a_shuffle(spark):
    clean = tables(spark, FOLDER, "clean")
    root = fresh_path(spark, "bucketed")
    (database, *_) = files.create_layers(spark, root, f"t_{root[-8:]}_")
    stored = files.write_bucketed(clean, root, database, 4)
    t = {**clean, **stored}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from countinghouse.operators.measures import sale_net_revenue

        found = sale_net_revenue(t)
        assert "Exchange" not in _plan(found)
        assert found.count() == sale_net_revenue(clean).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == f"{folder}/{spark.sparkContext.applicationId}"
    assert fresh_path(spark, "x") != fresh_path(spark, "x")




def _sale_items(tmp_path, *lines):
    names = "sale_item_id,sale_id,product_id,quantity,unit_price"
    (tmp_path / "items.csv").write_text("\n".join([names, *lines]) + "\n")
    return str(tmp_path / "items.csv")


def test_rejected_lines_have_their_reason(spark, tmp_path):
    path = _sale_items(
        tmp_path,
        "a,1,2,3,4.50",
        'b,1,2,x,4.50',
        "c,1,2,3",
        "d,1,2,3,4.50,6,7",
        "e,1,zwei,3,vier",
        '"f, g",1,2,3,4.50',
        '"h, ""i""",1,2,three,4.50',
        "j,,,,",
        'k,1,"2,3,4.50',
        "l,1,2,3,99999999999999999",
    )
    typed, rejects = files.load_csv(spark, path, "sale_items", fresh_path(spark, "loaded"))
    assert typed.schema.names == ["sale_item_id", "sale_id", "product_id", "quantity", "unit_price"]
    assert sorted(map(tuple, typed.collect())) == [
        ("a", 1, 2, 3, Decimal("4.50")), ("f, g", 1, 2, 3, Decimal("4.50")), ("j", None, None, None, None),
    ]
    found = {row[files.LINE].split(",")[0]: row[files.REASON] for row in rejects.collect()}
    assert found == {
        "b": "bad value: quantity", "c": "missing fields", "d": "surplus fields",
        "e": "bad value: product_id, unit_price", '"h': "bad value: quantity", "k": "unreadable",
        "l": "bad value: unit_price",
    }


def test_a_file_is_read_once_for_rows_and_rejects(spark, tmp_path):
    path = _sale_items(tmp_path, "a,1,2,3,4.50", "b,1,2,x,4.50")
    typed, rejects = files.load_csv(spark, path, "sale_items", fresh_path(spark, "loaded"))
    assert path not in "".join(typed.inputFiles() + rejects.inputFiles())
    assert "PartitionFilters: [isnotnull(accepted" in _plan(typed)
    assert (typed.count(), rejects.count()) == (1, 1)


def test_a_checked_load_of_nothing(spark, tmp_path):
    typed, rejects = files.load_csv(
        spark, _sale_items(tmp_path), "sale_items", fresh_path(spark, "loaded")
    )
    assert (typed.count(), rejects.count()) == (0, 0)


def test_views_are_named_in_any_case(spark, shop):
    text = "select total_transactions from Cased_Executive_SUMMARY"
    assert views.query(spark, text, shop, "cased_").first()[0] == 4


def test_a_folder_of_one_machine_is_refused_on_a_cluster(spark, monkeypatch):
    from countinghouse import session

    class Conf:
        def __init__(self, unset):
            self.unset = unset

        def get(self, key, *default):
            if key == "spark.checkpoint.dir":
                return None
            return "file:/one/machine" if key == "spark.sql.warehouse.dir" else self.unset

    class Context:
        master, applicationId = "spark://host:7077", "app-1"
        _jvm, _jsc = spark.sparkContext._jvm, spark.sparkContext._jsc

        def getConf(self):
            return Conf(None)

    class Session:
        sparkContext, conf = Context(), Conf(None)

    with pytest.raises(ValueError, match="folder of one machine"):
        session.shared_dir(Session())
