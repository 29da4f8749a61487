"""Data-quality checks over the raw tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countinghouse.functions.dates import day_of

Tables = dict[str, DataFrame]

#: Bits of a filter of lost keys, as a power of two: one megabyte.
FILTER_BITS = 23


def _missing(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def row_counts(tables: Tables) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).orderBy("table_name")


def missing_values(df: DataFrame, total: str, columns: dict[str, str]) -> DataFrame:
    """One row: the row count and, per output name, the NULLs of a column."""
    return df.agg(
        F.count(F.lit(1)).alias(total),
        *(_missing(column).alias(name) for name, column in columns.items()),
    )


def missing_customers(tables: Tables) -> DataFrame:
    return missing_values(
        tables["customers"],
        "total_customers",
        {
            "missing_names": "customer_name",
            "missing_phones": "phone",
            "missing_cities": "city",
            "missing_registration_dates": "registration_date",
        },
    )


def missing_suppliers(tables: Tables) -> DataFrame:
    return missing_values(
        tables["suppliers"],
        "total_suppliers",
        {"missing_names": "supplier_name", "missing_phones": "phone", "missing_cities": "city"},
    )


def walk_in_sales(tables: Tables) -> DataFrame:
    return missing_values(tables["sales"], "total_sales", {"walk_in_sales": "customer_id"})


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once; NULLs count as equal."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("duplicate_count"))
        .filter("duplicate_count > 1")
        .orderBy(F.desc("duplicate_count"), *keys)
    )


def duplicate_customers(tables: Tables) -> DataFrame:
    return duplicates(tables["customers"], ["customer_name", "phone"])


def duplicate_sale_items(tables: Tables) -> DataFrame:
    return duplicates(tables["sale_items"], ["sale_id", "product_id"])


# What makes a row of each table invalid.
INVALID = {
    "products": "weight_grams <= 0 or making_charge < 0 or cost_price <= 0 or selling_price <= 0",
    "sale_items": "quantity <= 0 or unit_price <= 0",
    "inventory": "stock_quantity < 0 or reorder_level < 0",
    "sales": "discount_amount < 0",
    "gold_prices": "price_per_gram <= 0",
}


def invalid_rows(tables: Tables, name: str) -> DataFrame:
    return tables[name].filter(INVALID[name])


def lost_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct known keys of ``child`` that have no parent.

    Only distinct keys are shuffled, so a key shared by very many rows weighs
    no more than any other. When few are lost, as it should be, adaptive
    execution broadcasts them.
    """
    return child.select(key).dropna().distinct().join(parent.select(key), key, "left_anti")


def _places(column: str) -> list[Column]:
    """The bits of a key in a filter: three parts of its hash."""
    code = F.xxhash64(F.lit(column), F.col(column))
    mask = F.lit((1 << FILTER_BITS) - 1).cast("bigint")
    return [F.shiftrightunsigned(code, n).bitwiseAND(mask) for n in (0, 23, 41)]


def _filter_of(lost: dict[str, DataFrame]) -> Column:
    """A Bloom filter of the keys in each column, an array of 64-bit words, as a scalar subquery."""
    words = next(iter(lost.values())).sparkSession.range(1 << (FILTER_BITS - 6))
    parts = [words.selectExpr("id as word", "0L as bits")]
    for column, keys in lost.items():
        places = keys.select(F.explode(F.array(*_places(column))).alias("place"))
        parts.append(
            places.selectExpr(
                "shiftright(place, 6) as word", "shiftleft(1L, cast(place & 63 as int)) as bits"
            )
        )
    united = reduce(DataFrame.unionByName, parts).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return united.agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"]).scalar()


def perhaps_lost(child: DataFrame, lost: dict[str, DataFrame]) -> DataFrame:
    """The rows of ``child`` that may have a lost key in some column, and few others.

    The size of a filter is fixed, and it goes to the rows, so only rows that it lets pass
    have to be moved to be compared with the lost keys. With millions of lost keys it lets
    more pass, in the end all.
    """
    words, found = _filter_of(lost), F.lit(False)
    for column in lost:
        hit = F.col(column).isNotNull()
        for place in _places(column):
            word = F.get(words, F.shiftright(place, 6).cast("int"))
            bit = place.bitwiseAND(F.lit(63)).cast("int")
            hit &= F.call_function("getbit", word, bit) == 1
        found |= hit
    return child.filter(found)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose known key has no parent."""
    lost = lost_keys(child, parent, key)
    return perhaps_lost(child, {key: lost}).join(lost, key, "left_semi")


def orphan_sales_customer(tables: Tables) -> DataFrame:
    return orphans(tables["sales"], tables["customers"], "customer_id")


def orphan_sales_employee(tables: Tables) -> DataFrame:
    """A sale without any employee counts as well."""
    sales = tables["sales"]
    return orphans(sales, tables["employees"], "employee_id").unionByName(
        sales.filter(F.col("employee_id").isNull())
    )


def orphan_sale_items(tables: Tables) -> DataFrame:
    """Items whose sale or product is missing."""
    items = tables["sale_items"]
    sales = lost_keys(items, tables["sales"], "sale_id")
    products = lost_keys(items, tables["products"], "product_id")
    unknown = "sale_id is null or product_id is null"
    perhaps = perhaps_lost(items.filter(f"not ({unknown})"), {"sale_id": sales, "product_id": products})
    return (
        perhaps.join(products.withColumn("_product", F.lit(True)), "product_id", "left")
        .join(sales.withColumn("_sale", F.lit(True)), "sale_id", "left")
        .filter("_sale or _product")
        .select(*items.columns)
        .unionByName(items.filter(unknown))
    )


def sales_before(tables: Tables, parent: str, key: str, date: str) -> DataFrame:
    """Sales dated before the related record existed."""
    related = tables[parent].select(key, date)
    return (
        tables["sales"]
        .join(related, key)
        .filter(day_of(F.col("sale_date")) < F.col(date))
        .select("sale_id", key, "sale_date", date)
    )


def sale_before_registration(tables: Tables) -> DataFrame:
    return sales_before(tables, "customers", "customer_id", "registration_date")


def sale_before_hire(tables: Tables) -> DataFrame:
    return sales_before(tables, "employees", "employee_id", "hire_date")


def sale_before_opening(tables: Tables) -> DataFrame:
    return sales_before(tables, "branches", "branch_id", "opening_date")


def branch_mismatch(tables: Tables) -> DataFrame:
    home = tables["employees"].select("employee_id", F.col("branch_id").alias("home_branch"))
    return (
        tables["sales"]
        .join(home, "employee_id")
        .filter("branch_id <> home_branch")
        .agg(F.count(F.lit(1)).alias("mismatched_branch_sales"))
    )
