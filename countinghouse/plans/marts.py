"""Stored summaries that appended sales bring up to date.

A mart holds, for each month and branch, the sums of its sales, and the customers who
bought as bitmaps: one row for each month, branch and bucket of 32 768 customer ids, with
a bit for each. Both merge: sums add up and bitmaps are united, so a month, a year or a
branch has its exact number of different customers from stored rows, without a second
look at the sales. The mart notes the version of the facts that it has seen; an update
reads what has been appended since and replaces the months that it touches, however long
ago they are. An appended batch holds whole sales.

Ids spread thinly over the whole range of numbers take a bitmap of four kilobytes each;
dense ids, as the given ones, take a bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countinghouse.functions.numbers import average, money
from countinghouse.operators.measures import SALE_FACTS, Tables, sale_facts, transaction_totals
from countinghouse.sources.versioned import (
    Conflict,
    Version,
    VersionedTable,
    folders_since,
    part_name,
)

#: Sums of a month and branch: the name in the mart and the measure of a sale.
SUMS = {
    "units": "units_sold",
    "gross": "gross_revenue",
    "discounts": "discount_amount",
    "net": "net_revenue",
    "profit": "estimated_net_profit",
}
_KEYS = ["sales_month", "branch_id"]


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_MONTH = {"sales_month": T.DateType(), "branch_id": T.LongType()}
SUMS_SCHEMA = _schema(
    **_MONTH, transactions=T.LongType(), units=T.LongType(),
    **{name: T.DecimalType(38, 2) for name in SUMS if name != "units"},
)
BUYERS_SCHEMA = _schema(**_MONTH, bucket=T.LongType(), buyers=T.BinaryType())
#: The mark that names the facts that are in the mart.
SEEN = "facts"



class SalesMart:
    """The facts of sales and their monthly summaries, below ``root``.

    Sums and customers of a month are two parts of one table, so a version has both or
    neither.
    """

    def __init__(self, spark: SparkSession, root: str, facts_schema: T.StructType):
        self.facts = VersionedTable(spark, f"{root}/facts", facts_schema)
        self.state = VersionedTable(spark, f"{root}/state", SUMS_SCHEMA)

    @classmethod
    def of(cls, tables: Tables, root: str) -> SalesMart:
        """A mart for tables like these; nothing is stored yet."""
        return cls(tables["sales"].sparkSession, root, sale_facts(tables).schema)

    def append(self, tables: Tables) -> Version:
        """Store the facts of a batch of sales with all their lines."""
        return self.facts.append(sale_facts(tables))

    def appended(self) -> tuple[DataFrame, Version]:
        """The facts that the mart has not seen, and the version that has them."""
        now, seen = self.facts.latest(), self.state.latest().marks.get(SEEN, 0)
        return self.facts.read_folders(folders_since(self.facts, seen, now)), now

    def update(self) -> list[str]:
        """Bring the summaries up to date; gives the months that were replaced. A repeated
        or broken off update does no harm."""
        while True:
            base = self.state.latest()
            facts, now = self.appended()
            if now.number == base.marks.get(SEEN, 0):
                return []
            # As many rows as there are months.
            found = facts.select(part_name(F.col("sales_month"))).distinct().collect()
            months = sorted(row[0] for row in found)
            sums = self._merged(
                self.sums(base, months), _summed(facts), _KEYS,
                {name: F.sum for name in ("transactions", *SUMS)},
            )
            buyers = self._merged(
                self.buyers(base, months), _bought(facts), [*_KEYS, "bucket"],
                {"buyers": F.bitmap_or_agg},
            )
            parts = {
                **base.parts,
                **self.state.write(sums, "sales_month", "sums/"),
                **self.state.write(buyers, "sales_month", "buyers/"),
            }
            try:
                self.state.commit(base, parts, **{SEEN: now.number})
                return months
            except Conflict:
                continue  # another update was faster; look at what is left

    @staticmethod
    def _merged(known: DataFrame, new: DataFrame, keys: list[str], steps: dict) -> DataFrame:
        kinds = {x.name: x.dataType for x in known.schema}
        return (
            known.unionByName(new)
            .groupBy(*keys)
            .agg(*(step(name).cast(kinds[name]).alias(name) for name, step in steps.items()))
            .repartitionByRange(*keys)
        )

    def _read(self, prefix: str, schema, version: Version | None, months) -> DataFrame:
        version = version or self.state.latest()
        folders = [
            folder
            for name, held in version.parts.items()
            if name.startswith(prefix) and (months is None or name.removeprefix(prefix) in months)
            for folder in held
        ]
        return self.state.read_folders(folders, schema)

    def sums(self, version: Version | None = None, months: list[str] | None = None) -> DataFrame:
        return self._read("sums/", SUMS_SCHEMA, version, months)

    def buyers(self, version: Version | None = None, months: list[str] | None = None) -> DataFrame:
        return self._read("buyers/", BUYERS_SCHEMA, version, months)


def _summed(facts: DataFrame) -> DataFrame:
    sales = transaction_totals({SALE_FACTS: facts}, *_KEYS)
    return sales.groupBy(*_KEYS).agg(
        F.count(F.lit(1)).alias("transactions"),
        *(F.sum(measure).alias(name) for name, measure in SUMS.items()),
    )


def _bought(facts: DataFrame) -> DataFrame:
    customer = F.col("customer_id")
    bought = transaction_totals({SALE_FACTS: facts}, *_KEYS, "customer_id")
    return (
        bought.filter(customer.isNotNull())
        .groupBy(*_KEYS, F.bitmap_bucket_number(customer).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(customer)).alias("buyers"))
    )


def customers_by(mart: SalesMart, *by: Column, version: Version | None = None) -> DataFrame:
    """The number of different customers in each group of months and branches."""
    names = [f"by_{n}" for n in range(len(by))]
    united = (
        mart.buyers(version)
        .groupBy(*(column.alias(name) for column, name in zip(by, names)), "bucket")
        .agg(F.bitmap_or_agg("buyers").alias("buyers"))
    )
    return united.groupBy(*names).agg(
        F.sum(F.bitmap_count("buyers")).alias("registered_customers")
    )


def _presented(totals: DataFrame, *first: str) -> DataFrame:
    return totals.select(
        *first,
        money(F.col("gross")).alias("gross_revenue"),
        money(F.col("discounts")).alias("total_discounts"),
        money(F.col("net")).alias("net_revenue"),
        money(F.col("profit")).alias("estimated_net_profit"),
        average(F.col("net"), F.col(first[-1])).alias("average_transaction_value"),
    )


def _totals(count: str, units: str) -> list[Column]:
    return [
        F.coalesce(F.sum("transactions"), F.lit(0)).alias(count),
        F.sum("units").alias(units),
        *(F.sum(name).alias(name) for name in SUMS if name != "units"),
    ]


def _with_customers(totals: DataFrame, buyers: DataFrame, key: str) -> DataFrame:
    known = buyers.select(F.col("by_0").alias("bought"), "registered_customers")
    return totals.join(known, F.col(key).eqNullSafe(F.col("bought")), "left").fillna(
        0, ["registered_customers"]
    )


def monthly_sales_summary(mart: SalesMart) -> DataFrame:
    """The view of the same name, from the mart."""
    now, month = mart.state.latest(), F.col("sales_month")
    totals = mart.sums(now).groupBy("sales_month").agg(*_totals("transaction_count", "units_sold"))
    rows = _with_customers(totals, customers_by(mart, month, version=now), "sales_month")
    return _presented(
        rows, "sales_month", "registered_customers", "units_sold", "transaction_count"
    ).orderBy("sales_month")


def executive_summary(mart: SalesMart) -> DataFrame:
    """The view of the same name, from the mart."""
    now = mart.state.latest()
    totals = mart.sums(now).agg(
        *_totals("total_transactions", "total_units_sold"),
        F.count_distinct("branch_id").alias("active_branches"),
    )
    buyers = customers_by(mart, version=now).select(
        F.coalesce("registered_customers", F.lit(0)).alias("registered_customers")
    )
    return _presented(
        totals.withColumn("registered_customers", buyers.scalar()),
        "registered_customers", "active_branches", "total_units_sold", "total_transactions",
    )


def yearly_customers(mart: SalesMart) -> DataFrame:
    """Different customers of each year: at most twelve rows a branch and bucket are united."""
    return customers_by(mart, F.year("sales_month")).select(
        F.col("by_0").alias("sales_year"), "registered_customers"
    ).orderBy("sales_year")


def branch_customers(mart: SalesMart) -> DataFrame:
    """Transactions and different customers of each branch with sales."""
    now = mart.state.latest()
    totals = mart.sums(now).groupBy("branch_id").agg(
        F.sum("transactions").alias("transaction_count")
    )
    rows = _with_customers(
        totals, customers_by(mart, F.col("branch_id"), version=now), "branch_id"
    )
    return rows.select("branch_id", "transaction_count", "registered_customers").orderBy("branch_id")
