"""Maps the given star schema onto the ten retail tables.

The text columns carry padding and case noise on purpose: the raw layer has to
be cleaned before it is used. Everything is lazy, so a report reads only the
columns it needs from the Parquet files.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]

# Layout of the given Parquet files.
GIVEN = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def read_given(spark: SparkSession, folder: str) -> Tables:
    """The files with a declared schema, so that no footer is read to plan a query."""
    return {
        name: spark.read.schema(ddl).parquet(f"{folder.rstrip('/')}/{name}.parquet")
        for name, ddl in GIVEN.items()
    }


# Purity of 24, 22, 18 and 14 carat gold.
PURITY = {1: "1.000", 2: "0.916", 3: "0.750", 4: "0.585"}


def thousandths() -> list[int]:
    """The purities in order of their gold types, as whole thousandths."""
    return [int(Decimal(PURITY[kind]) * 1000) for kind in sorted(PURITY)]


def _row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def _branches(given: Tables) -> DataFrame:
    region = given["region"].withColumnRenamed("r_regionkey", "n_regionkey")
    return given["nation"].join(region, "n_regionkey").selectExpr(
        "cast(n_nationkey as bigint) as branch_id",
        "concat('  ', lower(n_name), ' branch ') as branch_name",
        "concat(' ', lower(r_name)) as city",
        "date_add(date'1994-01-01', n_nationkey * 40) as opening_date",
    )


def _customers(given: Tables) -> DataFrame:
    twin = "if(c_custkey % 50 = 3, c_custkey - 1, c_custkey)"
    return given["customer"].withColumn("k", F.expr(twin)).selectExpr(
        "c_custkey as customer_id",
        "concat('  customer#', lpad(cast(k as string), 9, '0'), ' ') as customer_name",
        "case k % 20 when 0 then null when 1 then '   ' else concat('09', 100000000 + k) end"
        " as phone",
        "case c_custkey % 12 when 0 then null when 1 then '  '"
        " else concat(' ', lower(c_mktsegment)) end as city",
        "date_add(date'1992-01-01', cast(c_custkey * 37 % 1500 as int)) as registration_date",
    )


def _suppliers(given: Tables) -> DataFrame:
    return given["supplier"].selectExpr(
        "s_suppkey as supplier_id",
        "concat(' ', lower(s_name), '-supply co ') as supplier_name",
        "if(s_suppkey % 9 = 0, null, concat(' nation ', s_nationkey)) as city",
        "case s_suppkey % 10 when 0 then null when 1 then ''"
        " else concat('09', 200000000 + s_suppkey) end as phone",
    )


def _gold_types(given: Tables) -> DataFrame:
    kinds = given["part"].select((F.col("p_partkey") % 4 + 1).alias("gold_type_id")).distinct()
    return kinds.selectExpr(
        "gold_type_id",
        "case gold_type_id when 1 then ' 24k ' when 2 then '22K' when 3 then '18k'"
        " else '14K' end as gold_type_name",
    )


def _employees(given: Tables) -> DataFrame:
    return given["supplier"].selectExpr(
        "s_suppkey as employee_id",
        "concat('employee#', lpad(cast(s_suppkey as string), 9, '0')) as employee_name",
        "cast(s_nationkey as bigint) as branch_id",
        "case s_suppkey % 8 when 0 then 'branch manager' when 1 then 'senior sales associate'"
        " when 2 then 'cashier' else 'sales associate' end as job_title",
        "date_add(date'1994-06-01', cast(s_suppkey * 53 % 700 as int)) as hire_date",
        "cast(5000000 + s_suppkey % 51 * 500000 as decimal(12,2)) as monthly_target",
    )


def _parts(given: Tables) -> DataFrame:
    """The parts and, of every fortieth, a further article that was never sold."""
    shift = _row_count(given["part"])
    unsold = given["part"].filter("p_partkey % 40 = 7")
    return given["part"].unionByName(
        unsold.withColumn("p_partkey", F.col("p_partkey") + shift)
    )


def _products(given: Tables) -> DataFrame:
    sellers = _row_count(given["supplier"]) - 1
    return _parts(given).withColumn("supplier_id", F.col("p_partkey") % sellers).selectExpr(
        "p_partkey as product_id",
        "concat(' ', p_name, ' ') as product_name",
        "lower(p_type) as category",
        "p_partkey % 4 + 1 as gold_type_id",
        "cast(p_size as decimal(10,2)) as weight_grams",
        "cast(p_size * 1000 as decimal(12,2)) as making_charge",
        "cast(cast(p_retailprice as decimal(14,2)) * 30 as decimal(14,2)) as cost_price",
        "cast(cast(p_retailprice as decimal(14,2)) * 40 as decimal(14,2)) as selling_price",
        "supplier_id",
    )


def _sales(given: Tables) -> DataFrame:
    sellers = _row_count(given["supplier"]) - 1
    staff = given["supplier"].selectExpr("s_suppkey as employee_id", "s_nationkey")
    orders = given["orders"].withColumn("employee_id", F.col("o_orderkey") % sellers)
    return orders.join(staff, "employee_id").selectExpr(
        "o_orderkey as sale_id",
        "if(o_orderkey % 7 = 0, null, o_custkey) as customer_id",
        "employee_id",
        "cast(if(o_orderkey % 50 = 0, (s_nationkey + 1) % 25, s_nationkey) as bigint)"
        " as branch_id",
        "o_orderdate + make_dt_interval(0, 0, 0, 32400 + o_orderkey * 7919 % 36000) as sale_date",
        "concat(' ', o_orderpriority) as payment_method",
        "cast(if(o_orderkey % 20 < 7, cast(o_totalprice as decimal(14,2)) * 0.05, 0)"
        " as decimal(12,2)) as discount_amount",
    )


def _sale_items(given: Tables) -> DataFrame:
    return given["lineitem"].selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as sale_item_id",
        "l_orderkey as sale_id",
        "l_partkey as product_id",
        "cast(l_quantity as int) as quantity",
        "cast(l_extendedprice as decimal(14,2)) as unit_price",
    )


def _inventory(given: Tables) -> DataFrame:
    """Each product is kept in five branches, which follow from its key."""
    kept = _parts(given).select(
        F.col("p_partkey").alias("p"), (_row_count(given["part"]) * 2).alias("keys"),
        F.expr("explode(sequence(0, 20, 5))").alias("step"),
    ).withColumn("b", F.expr("(p + step) % 25"))
    branches = given["nation"].select(F.col("n_nationkey").cast("bigint").alias("b"))
    return kept.join(branches, "b").selectExpr(
        "b * keys + p + 1 as inventory_id",
        "b as branch_id",
        "p as product_id",
        "cast((p * 7 + b * 3) % 16 as int) as stock_quantity",
        "cast(2 + (p + b) % 4 as int) as reorder_level",
        "date_add(date'2001-07-01', cast((p + b) % 31 as int)) as last_updated",
    )


def _gold_prices(given: Tables) -> DataFrame:
    """A price for every gold type on every day from the first to the last order."""
    day = F.col("o_orderdate").cast("date")
    first, last = (given["orders"].agg(f(day)).scalar() for f in (F.min, F.max))
    kinds = _gold_types(given).select("gold_type_id", first.alias("first"), last.alias("last"))
    return kinds.select(
        "gold_type_id", "first", F.explode(F.sequence("first", "last")).alias("price_date")
    ).withColumn("i", F.datediff("price_date", "first").cast("long")).withColumn(
        "m", F.element_at(F.lit(thousandths()), F.col("gold_type_id").cast("int"))
    ).withColumn("base", F.expr("180000 + 20 * i + i * 7919 % 2000")).selectExpr(
        "price_date",
        "gold_type_id",
        "cast((base * m + 50000) div 100000 * 100 as decimal(14,2)) as price_per_gram",
    )


def raw_tables(given: Tables) -> Tables:
    return {
        "branches": _branches(given),
        "customers": _customers(given),
        "suppliers": _suppliers(given),
        "gold_types": _gold_types(given),
        "employees": _employees(given),
        "products": _products(given),
        "sales": _sales(given),
        "sale_items": _sale_items(given),
        "inventory": _inventory(given),
        "gold_prices": _gold_prices(given),
    }


def _changed(df: DataFrame, changes: dict[str, str]) -> DataFrame:
    """Rewrite columns, every expression seeing the values before any change."""
    kinds = dict(df.dtypes)
    return df.select(
        *(
            F.expr(f"cast({changes[c]} as {kinds[c]})").alias(c) if c in changes else F.col(c)
            for c in df.columns
        )
    )


def _doubled(df: DataFrame, condition: str) -> DataFrame:
    copies = F.when(F.expr(condition), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.select("*", F.explode(copies).alias("_copy")).drop("_copy")


def violating_tables(given: Tables) -> Tables:
    """The raw tables with rows that break every integrity rule."""
    raw = raw_tables(given)
    changes = {
        "products": {
            "cost_price": "if(product_id % 50 = 11, 0, cost_price)",
            "weight_grams": "if(product_id % 50 = 12, -1, weight_grams)",
        },
        "sale_items": {
            "quantity": "if(sale_id % 70 = 3, 0, quantity)",
            "unit_price": "if(sale_id % 70 = 4, 0, unit_price)",
            "product_id": "if(sale_id % 90 = 5, -1, product_id)",
            "sale_id": "if(sale_id % 110 = 6, -sale_id, sale_id)",
        },
        "sales": {
            "discount_amount": "if(sale_id % 80 = 9, -1, discount_amount)",
            "customer_id": "if(sale_id % 90 = 5 and customer_id is not null, -1, customer_id)",
            "employee_id": "if(sale_id % 95 = 7, -1, employee_id)",
        },
        "inventory": {
            "stock_quantity": "if(product_id % 60 = 8, -1, stock_quantity)",
            "reorder_level": "if(product_id % 60 = 9, -2, reorder_level)",
        },
        "gold_prices": {
            "price_per_gram": "if(gold_type_id = 4 and month(price_date) = 1"
            " and day(price_date) = 1, 0, price_per_gram)",
        },
        "branches": {
            "opening_date": "if(branch_id = 24, date'2030-01-01', opening_date)",
        },
        "customers": {
            "customer_name": "if(customer_id % 200 = 15, null, customer_name)",
            "phone": "if(customer_id % 200 = 16, repeat('9', 40), phone)",
        },
        "employees": {
            "monthly_target": "if(employee_id % 10 = 4, -1, monthly_target)",
            "hire_date": "if(employee_id % 10 = 5, null, hire_date)",
        },
    }
    broken = {name: _changed(df, changes.get(name, {})) for name, df in raw.items()}
    broken["branches"] = _doubled(broken["branches"], "branch_id = 0")
    broken["inventory"] = _doubled(broken["inventory"], "branch_id = 0 and product_id < 3")
    return broken
