"""Connected components of a graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countinghouse.session import stored


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each ``u``, stored: a join with it can then be split by Spark."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node that it is connected with.

    ``edges`` has the columns ``u`` and ``v``; nodes without an edge are not returned.
    Alternating large-star and small-star steps: each links the neighbours of a node
    to the smallest of them, so paths shorten by about half each time. No step
    gathers the neighbours of a node; it only takes their minimum.
    """
    now = stored(
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    before = _state(now)
    if not before[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(
            both.join(_least(both), "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct(),
            "edges",
        )
        least = _least(large)
        moved = large.join(least, "u").filter("v <> m").select("v", F.col("m")).toDF("u", "v")
        now = stored(moved.unionByName(least.toDF("u", "v")).distinct(), "edges")
        after = _state(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        before = after
