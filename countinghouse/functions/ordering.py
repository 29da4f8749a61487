"""Whole-table order without a single-task window.

``Window.orderBy`` without a partition key moves every row to one task. Here
the rows are range-partitioned and sorted once, their place is written down in
the shared folder, and only one row per partition takes part in the step that
links the partitions. The order keys must end in a unique column wherever ties
could be frequent: that column is what splits a run of equal values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countinghouse.session import checkpointed, stored

_SLOT_BITS = 33  # fixed layout of monotonically_increasing_id: partition, then row


def _placed(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Rows in global order with their partition ``_part`` and row ``_slot`` in it."""
    ordered = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    place = F.col("_place")
    return (
        checkpointed(ordered)
        .withColumn("_part", F.shiftright(place, _SLOT_BITS))
        .withColumn("_slot", place.bitwiseAND(F.lit((1 << _SLOT_BITS) - 1)))
        .drop("_place")
    )


def _before(placed: DataFrame, amount: Column, name: str) -> DataFrame:
    """Per partition, the total of ``amount`` in all earlier partitions, and overall.

    One row per partition, so the unpartitioned window and the broadcast are
    bounded by the number of shuffle partitions.
    """
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    per_part = placed.groupBy("_part").agg(amount.alias("_amount"))
    return per_part.select(
        "_part",
        F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias(name),
        F.sum("_amount").over(everything).alias(f"{name}_all"),
    )


def with_position(df: DataFrame, keys: Sequence[Column], name: str = "position") -> DataFrame:
    """Add the 1-based place in the global order and ``{name}_count``, the row total."""
    placed = _placed(df, keys)
    offsets = _before(placed, F.count(F.lit(1)), "_rows")
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_slot") + F.col("_rows") + 1)
        .withColumnRenamed("_rows_all", f"{name}_count")
        .drop("_part", "_slot", "_rows")
    )


def with_running_total(df: DataFrame, keys: Sequence[Column], value: str, name: str) -> DataFrame:
    """Add the running total of ``value`` and ``{name}_all``, the grand total."""
    placed = _placed(df, keys)
    offsets = _before(placed, F.sum(value), "_sum")
    inside = (
        Window.partitionBy("_part")
        .orderBy("_slot")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        placed.withColumn("_inside", F.sum(value).over(inside))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_inside") + F.col("_sum"))
        .withColumnRenamed("_sum_all", f"{name}_all")
        .drop("_part", "_slot", "_inside", "_sum")
    )


def tile(position: Column, count: Column, tiles: int) -> Column:
    """The NTILE bucket of a 1-based position: the first ``count % tiles`` are one larger."""
    size, extra = F.call_function("div", count, F.lit(tiles)), count % tiles
    large = extra * (size + 1)
    in_large = F.call_function("div", position - 1, size + 1) + 1
    in_small = F.call_function("div", position - 1 - large, F.nullif(size, F.lit(0))) + 1 + extra
    return F.when(position <= large, in_large).otherwise(in_small).cast("int")


def with_rank(
    df: DataFrame, value: str, name: str, by: Sequence[str] = (), dense: bool = False
) -> DataFrame:
    """Add RANK (or DENSE_RANK) of ``value``, largest first, inside each ``by`` group.

    Ranks are worked out over the distinct values and joined back, so neither a
    hot group nor a value shared by many rows has to fit in one task. Rows whose
    ``value`` is NULL rank first, as a descending order puts them there. ``df``
    is read twice, so pass a stored frame if it is costly to compute.
    """
    if not by:
        df = df.withColumn("_group", F.lit(0))
        return with_rank(df, value, name, ["_group"], dense).drop("_group")
    step = F.lit(1).cast("long") if dense else F.count(F.lit(1))
    levels = df.groupBy(*by, value).agg(F.max(step) if dense else step).toDF(*by, value, "_rows")
    keys = [*(F.col(c).asc_nulls_last() for c in by), F.col(value).desc_nulls_first()]
    running = with_running_total(levels, keys, "_rows", "_upto").withColumn(
        "_start", F.col("_upto") - F.col("_rows")
    )
    groups = running.groupBy(*by).agg(F.min("_start").alias("_first"))
    ranks = running.alias("r").join(
        groups.alias("g"), [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]
    ).select(
        *(F.col(f"r.{c}").alias(f"_by_{c}") for c in by),
        F.col(f"r.{value}").alias("_value"),
        (F.col("_start") - F.col("_first") + 1).cast("int").alias(name),
    )
    ranks = stored(ranks, "ranks")
    match = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    match.append(F.col(value).eqNullSafe(F.col("_value")))
    return df.join(ranks, match).drop("_value", *(f"_by_{c}" for c in by))
