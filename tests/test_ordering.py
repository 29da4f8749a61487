from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from countinghouse.functions.ordering import tile, with_position, with_rank, with_running_total


@pytest.fixture(scope="module")
def uneven(spark):
    """A third of the rows share one value and most share one group."""
    value = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50)
    group = F.when(F.col("id") % 10 < 6, "hot").otherwise((F.col("id") % 4).cast("string"))
    return spark.range(0, 2000, 1, 8).select(
        "id", value.cast("decimal(12,2)").alias("value"), group.alias("g")
    )


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_position_equals_row_number(uneven):
    found = with_position(uneven, [F.desc("value"), F.asc("id")])
    window = Window.orderBy(F.desc("value"), F.asc("id"))
    expected = uneven.withColumn("position", F.row_number().over(window).cast("long"))
    assert _rows(found.drop("position_count")) == _rows(expected)
    assert {r.position_count for r in found.collect()} == {2000}


@pytest.mark.parametrize("tiles", [2, 5, 7])
def test_tiles_equal_the_window_function(uneven, tiles):
    placed = with_position(uneven, [F.asc("value"), F.asc("id")])
    found = placed.select(
        "id", tile(F.col("position"), F.col("position_count"), tiles).alias("t")
    )
    expected = uneven.select("id", F.ntile(tiles).over(Window.orderBy("value", "id")).alias("t"))
    assert _rows(found) == _rows(expected)


def test_fewer_rows_than_tiles(spark):
    placed = with_position(spark.range(3), [F.col("id")])
    found = placed.select(tile(F.col("position"), F.col("position_count"), 5)).collect()
    assert sorted(r[0] for r in found) == [1, 2, 3]


def test_running_total_equals_the_window(uneven):
    found = with_running_total(uneven, [F.desc("value"), F.asc("id")], "value", "upto")
    window = Window.orderBy(F.desc("value"), F.asc("id")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    expected = uneven.withColumn("upto", F.sum("value").over(window))
    assert _rows(found.drop("upto_all")) == _rows(expected)


@pytest.mark.parametrize("dense", [False, True])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_rank_equals_the_window(uneven, by, dense):
    found = with_rank(uneven, "value", "place", by, dense)
    function = F.dense_rank() if dense else F.rank()
    window = Window.partitionBy(*by).orderBy(F.desc("value"))
    expected = uneven.withColumn("place", function.over(window))
    assert _rows(found.select("id", "place")) == _rows(expected.select("id", "place"))


def test_empty_frame(spark):
    empty = spark.range(0).withColumn("value", F.col("id").cast("decimal(12,2)"))
    assert with_position(empty, [F.col("id")]).count() == 0
    assert with_running_total(empty, [F.col("id")], "value", "upto").count() == 0
    assert with_rank(empty, "value", "place").count() == 0


def test_null_values_rank_first(spark):
    frame = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 1)], "id int, value int")
    found = with_rank(frame, "value", "place").select("id", "place")
    assert dict(_rows(found)) == {1: 1, 2: 2, 3: 2, 4: 4}
