"""CSV and Parquet in and out, and the raw, cleaned and analytics layers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countinghouse.functions.dates import month_of
from countinghouse.operators.cleaning import clean
from countinghouse.operators.measures import SALE_FACTS, sale_facts
from countinghouse.schemas import TABLES

Tables = dict[str, DataFrame]
LAYERS = ("raw", "cleaned", "analytics")
MAX_AGE = 600.0

# Doubled quotes, untouched blanks; an empty field, quoted or not, is NULL.
_CSV = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_csv(spark: SparkSession, path: str, table: str, multiline: bool = False) -> DataFrame:
    """A typed table from CSV. The schema is declared, so leading zeros survive.

    Malformed values fail the load. ``multiline`` gives up splitting of files.
    """
    return (
        spark.read.schema(TABLES[table].schema)
        .options(**_CSV, mode="FAILFAST", enforceSchema="false")
        .option("multiLine", multiline)
        .csv(path)
    )


#: Columns that a checked load adds.
LINE, REASON = "rejected_line", "reject_reason"
_MARK = "\u0001"


def read_csv_checked(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Every line of a CSV: a typed row, or the rejected line with its reason.

    Reasons are ``missing fields``, ``surplus fields``, ``unreadable`` (an open quotation
    mark) and ``bad value`` with the columns that don't take their values; the fields of a
    rejected line are NULL. A header that differs from the table's fails the load. Lines
    end at a line break, so this doesn't read texts that hold one.
    """
    schema = TABLES[table].schema
    names = schema.names
    rows = (
        spark.read.schema(T.StructType(schema.fields).add(LINE, "string"))
        .options(**_CSV, mode="PERMISSIVE", enforceSchema="false", columnNameOfCorruptRecord=LINE)
        .csv(path)
    )
    # Behind a line's last field a mark: where it stands tells how many fields there are.
    parts = [f"_{n}" for n in range(len(names) + 1)]
    texts = F.from_csv(
        F.concat(F.col(LINE), F.lit("," + _MARK)),
        ", ".join(f"{x} string" for x in parts),
        {k: v for k, v in _CSV.items() if k != "header"},
    )
    at = F.coalesce(
        *(F.when(texts.getField(x) == _MARK, n) for n, x in enumerate(parts))
    )
    bad = F.array_compact(
        F.array(
            *(
                F.when(
                    texts.getField(x).isNotNull()
                    & texts.getField(x).try_cast(schema[name].dataType).isNull(),
                    F.lit(name),
                )
                for x, name in zip(parts, names)
            )
        )
    )
    open_quote = (F.length(LINE) - F.length(F.replace(LINE, F.lit('"')))) % 2 == 1
    reason = (
        F.when(F.col(LINE).isNull(), None)
        .when(open_quote, "unreadable")
        .when(at < len(names), "missing fields")
        .when(at.isNull(), "surplus fields")
        .when(F.size(bad) > 0, F.concat(F.lit("bad value: "), F.array_join(bad, ", ")))
        .otherwise("unreadable")
    )
    values = [F.when(F.col(LINE).isNull(), F.col(x)).alias(x) for x in names]
    return rows.select(*values, LINE, reason.alias(REASON))


def load_csv(
    spark: SparkSession, path: str, table: str, root: str
) -> tuple[DataFrame, DataFrame]:
    """The typed rows and the rejected lines (``rejected_line``, ``reject_reason``) of a CSV,
    stored below ``root`` in one pass over it."""
    checked = read_csv_checked(spark, path, table)
    accepted = F.col(REASON).isNull().alias("accepted")
    checked.select("*", accepted).write.partitionBy("accepted").parquet(root)
    stored = spark.read.schema(T.StructType(checked.schema.fields).add("accepted", "boolean")).parquet(root)
    return (
        stored.filter("accepted").select(*TABLES[table].schema.names),
        stored.filter("not accepted").select(LINE, REASON),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV).csv(path)


def load_folder(spark: SparkSession, folder: str, kind: str = "parquet") -> Tables:
    """All ten tables from ``folder/<table>`` (Parquet) or ``folder/<table>.csv``."""
    if kind == "csv":
        return {name: read_csv(spark, f"{folder}/{name}.csv", name) for name in TABLES}
    return {
        name: spark.read.schema(spec.schema).parquet(f"{folder}/{name}")
        for name, spec in TABLES.items()
    }


def insert_ignore(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` plus the new rows whose key it lacks; of equal new keys the smallest row."""
    return existing.unionByName(_absent(existing, new.select(*existing.columns), key))


def _absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    unknown = new.join(existing.select(key), key, "left_anti")
    least = unknown.groupBy(key).agg(F.min(F.struct(*new.columns)).alias("row"))
    return least.select("row.*")


def insert_ignore_into(spark: SparkSession, path: str, new: DataFrame, key: str) -> DataFrame:
    """Append the new rows whose key the stored table lacks, and read the table back.

    For a plain folder with one writer; ``versioned.insert_ignore`` is for several.
    """
    existing = spark.read.schema(new.schema).parquet(path)
    _absent(existing, new, key).write.mode("append").parquet(path)
    return spark.read.schema(new.schema).parquet(path)


def create_layers(spark: SparkSession, root: str, prefix: str = "") -> list[str]:
    """One database per layer, each in its own folder under ``root``."""
    names = [prefix + layer for layer in LAYERS]
    for name in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{root}/{name}'")
    return names


def full_refresh(raw: Tables, root: str) -> Tables:
    """Rewrite every cleaned table from the raw one, and read the new layer.

    The tables go to a folder of their own; it is listed under ``versions`` only when all
    of them are complete, so a reader sees the old layer or the new one, never a mixture,
    and the raw tables may lie anywhere.
    """
    spark = next(iter(raw.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in raw.items():
        clean(name, df).write.parquet(f"{root}/{version}/{name}")
    listed = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("at")
    )
    listed.write.mode("append").parquet(f"{root}/versions")
    return current_layer(spark, root, list(raw))


def current_layer(spark: SparkSession, root: str, names: list[str] | None = None) -> Tables:
    """The tables of the latest complete refresh."""
    version = spark.read.parquet(f"{root}/versions").agg(F.max_by("version", "at")).first()[0]
    return {
        name: spark.read.schema(TABLES[name].schema).parquet(f"{root}/{version}/{name}")
        for name in names or TABLES
    }


def cached_mart(
    spark: SparkSession, build: Callable[[], DataFrame], path: str, max_age: float = MAX_AGE
) -> DataFrame:
    """A stored report, built anew if the stored one is older than ``max_age`` seconds.

    Each result has a folder of its own, so readers of the last one are not disturbed.
    """
    age = F.current_timestamp().cast("double") - F.col("at").cast("double")
    try:
        kept = spark.read.parquet(f"{path}/stamps").filter(age <= max_age)
        row = kept.agg(F.max_by("version", "at")).first()
    except AnalysisException:  # no result has been stored yet
        row = None
    if row and row[0]:
        return spark.read.parquet(f"{path}/{row[0]}")
    version = uuid.uuid4().hex
    build().write.parquet(f"{path}/{version}")
    stamp = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("at")
    )
    stamp.write.mode("append").parquet(f"{path}/stamps")
    return spark.read.parquet(f"{path}/{version}")


def _write_by_month(sales: DataFrame, path: str) -> DataFrame:
    (
        sales.repartitionByRange("sale_date", "sale_id")
        .sortWithinPartitions("sale_date")
        .write.mode("overwrite")
        .partitionBy("sales_month")
        .parquet(path)
    )
    return sales.sparkSession.read.schema(sales.schema).parquet(path)


def with_sale_facts(cleaned: Tables, path: str) -> Tables:
    """Store the sale facts by month; reports given the result read them, not the lines."""
    return {**cleaned, SALE_FACTS: _write_by_month(sale_facts(cleaned), path)}


def write_layout(cleaned: Tables, root: str) -> Tables:
    """Sales and items laid out for the usual access paths.

    Sales are partitioned by month, so a date range reads only its months. The
    shuffle is by ranges of time and sale, which spreads a busy month over many
    tasks and still gives few files per month. Items lie under the month of their
    sale, ranged and sorted by sale; a sale of any size is split.
    """
    spark = cleaned["sales"].sparkSession
    sales = cleaned["sales"].withColumn("sales_month", month_of(F.col("sale_date")))
    items = cleaned["sale_items"]
    stored_sales = _write_by_month(sales, f"{root}/sales")
    # The month of a line is its sale's; a line without a sale is kept under no month.
    dated = items.join(sales.select("sale_id", "sales_month"), "sale_id", "left")
    (
        dated.repartitionByRange("sales_month", "sale_id", "product_id")
        .sortWithinPartitions("sale_id")
        .write.mode("overwrite")
        .partitionBy("sales_month")
        .parquet(f"{root}/sale_items")
    )
    return {
        "sales": stored_sales,
        "sale_items": spark.read.schema(dated.schema).parquet(f"{root}/sale_items"),
    }


def write_bucketed(cleaned: Tables, root: str, database: str, buckets: int) -> Tables:
    """Both facts bucketed on ``sale_id``, so that joining them moves no row.

    Meant for facts without very hot sales: one sale always stays in one bucket.
    """
    spark = cleaned["sales"].sparkSession
    tables = {}
    for name in ("sales", "sale_items"):
        table = f"{database}.{name}"
        (
            cleaned[name].repartition(buckets, "sale_id")
            .write.mode("overwrite")
            .option("path", f"{root}/{name}")
            .bucketBy(buckets, "sale_id")
            .sortBy("sale_id")
            .saveAsTable(table)
        )
        tables[name] = spark.table(table)
    return tables
