"""Layouts that serve look-ups by several columns.

``write_clustered`` deals rows out in Morton order: each key is reduced to its place among
the key's quantiles, and the bits of the places are interleaved, so rows that are near in
every key follow each other. The first bits of the code name a cell; no file holds rows of
two cells, and a cell of many rows is several files. A manifest holds the least and
greatest value of each key for each file; ``lookup`` chooses files by it before the scan,
so files that cannot hold a value are neither listed nor opened. With k keys and n files a
look-up by one key opens about n to the power of (k - 1) / k files.

``write_filtered`` serves keys that rows are not ordered by: each row group carries a Bloom
filter of each such key, and Spark's reader leaves out row groups whose filter denies the
value that is looked up.

The files of a layout are listed in its manifest only when all are written, so a reader
sees a layout whole or not at all. Keys are whole numbers, dates or timestamps. A value
that holds a third of all rows is divided by the other keys, and by ``tie``, columns that
tell rows apart, where those are equal too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bits of each key's place: 63 quantiles.
BITS = 6
#: Names the folders of the cells.
CELL = "morton_cell"
#: Rows of a row group, and the share of them that a filter lets pass by mistake.
GROUP_ROWS = 20_000
FALSE_POSITIVES = 0.01


def _number(key: str, schema: StructType) -> Column:
    """The key as a whole number of the same order."""
    kind = schema[key].dataType.typeName()
    if kind == "date":
        return F.unix_date(key).cast("bigint")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(key).cast("timestamp"))
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{key}: no layout by {kind}")
    return F.col(key).cast("bigint")


def quantiles(df: DataFrame, keys: Sequence[str], bits: int = BITS) -> dict[str, list[int]]:
    """For each key the values that divide its rows into ``2 ** bits`` equal parts, from
    sketches that each task merges: the driver gets a fixed number of values a key."""
    shares = [n / (1 << bits) for n in range(1, 1 << bits)]
    found = df.agg(
        *(F.percentile_approx(_number(key, df.schema), shares, 10_000).alias(key) for key in keys)
    ).first()
    return {key: found[key] or [] for key in keys}


def _place(number: Column, cuts: list[int]) -> Column:
    """How many cuts are no greater, as a tree of comparisons; 0 for null. A value that
    holds several cuts has the place of the last, so halves of the places hold about
    half of the rows."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(number < F.lit(cuts[middle]), between(low, middle)).otherwise(
            between(middle + 1, high)
        )

    return F.when(number.isNull(), 0).otherwise(between(0, len(cuts)))


def morton(df: DataFrame, keys: Sequence[str], cuts: dict[str, list[int]], bits: int = BITS) -> Column:
    """The interleaved bits of the keys' places, the first key's highest bit first."""
    places = [_place(_number(key, df.schema), cuts[key]) for key in keys]
    code = F.lit(0).cast("bigint")
    for bit in reversed(range(bits)):
        for place in places:
            own = F.shiftright(place, bit).bitwiseAND(F.lit(1)).cast("bigint")
            code = F.shiftleft(code, 1).bitwiseOR(own)
    return code


def write_clustered(
    df: DataFrame, root: str, keys: Sequence[str], tie: Sequence[str], files: int
) -> DataFrame:
    """Store ``df`` in ``files`` to twice as many files, by the cells of ``keys``; gives the
    manifest."""
    spark = df.sparkSession
    code = morton(df, keys, quantiles(df, keys))
    spare = max(0, BITS * len(keys) - (files.bit_length() - 1))
    # Asking for a number of partitions keeps Spark from merging small ones.
    (
        df.withColumn(CELL, F.shiftright(code, spare))
        .repartitionByRange(files, CELL, *tie)
        .sortWithinPartitions(CELL, *tie)
        .write.partitionBy(CELL)
        .parquet(f"{root}/rows")
    )
    stored = spark.read.schema(df.schema).parquet(f"{root}/rows")
    ends = [
        end(_number(key, df.schema)).alias(f"{name}_{key}")
        for key in keys
        for name, end in (("least", F.min), ("greatest", F.max))
    ]
    place = F.regexp_extract("_metadata.file_path", f"{CELL}=[^/]+/[^/]+$", 0)
    manifest = stored.groupBy(place.alias("file")).agg(F.count(F.lit(1)).alias("rows"), *ends)
    manifest.write.parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")


def files_for(manifest: DataFrame, schema: StructType, **wanted: object) -> list[str]:
    """The names of the files that may hold rows with the wanted value of each key."""
    rows = manifest
    for key, value in wanted.items():
        asked = manifest.sparkSession.range(1).select(
            F.lit(value).cast(schema[key].dataType).alias(key)
        )
        number = asked.select(_number(key, schema)).scalar()
        rows = rows.filter(number.between(F.col(f"least_{key}"), F.col(f"greatest_{key}")))
    return sorted(row["file"] for row in rows.select("file").collect())


def lookup(spark: SparkSession, root: str, schema: StructType, **wanted: object) -> DataFrame:
    """The rows with the wanted value of each key, from the files that may hold them."""
    files = files_for(spark.read.parquet(f"{root}/manifest"), schema, **wanted)
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*(f"{root}/rows/{name}" for name in files))
    for key, value in wanted.items():
        rows = rows.filter(F.col(key) == F.lit(value).cast(schema[key].dataType))
    return rows


def write_filtered(
    df: DataFrame,
    path: str,
    order: Sequence[str],
    keys: Sequence[str],
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Store ``df`` by ranges of ``order``, with a Bloom filter of each of ``keys`` in each row
    group. The filters have room for a group of different values each."""
    options = {"parquet.block.row.count.limit": group_rows}
    for key in keys:
        options |= {
            f"parquet.bloom.filter.enabled#{key}": "true",
            f"parquet.bloom.filter.expected.ndv#{key}": group_rows,
            f"parquet.bloom.filter.fpp#{key}": FALSE_POSITIVES,
            # A dictionary would take the filter's place, and be read whole.
            f"parquet.enable.dictionary#{key}": "false",
        }
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.options(**options)
        .parquet(path)
    )
    return df.sparkSession.read.schema(df.schema).parquet(path)
