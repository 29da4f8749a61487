from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from countinghouse.functions import selection
from countinghouse.plans import customers
from countinghouse.session import stored
from tests.conftest import FOLDER


def frame(spark, values):
    rows = [(n * 7_919 % 100_003, value) for n, value in enumerate(values)]
    return stored(spark.createDataFrame(rows, "id bigint, value bigint").repartition(5), "values")


def values_of(kind, count):
    pick = random.Random(kind)
    return {
        "different": lambda: pick.sample(range(-(10**12), 10**12), count),
        "ties": lambda: [pick.choice([1, 1, 1, 2, 3]) for _ in range(count)],
        "one": lambda: [7] * count,
        "two": lambda: [pick.choice([-(1 << 62), 1 << 62]) for _ in range(count)],
        "skewed": lambda: [min(pick.randrange(count), 50) for _ in range(count)],
        "steep": lambda: [2 ** pick.randrange(60) + pick.randrange(9) for _ in range(count)],
    }[kind]()


@pytest.mark.parametrize("few", [5, 20_000])
@pytest.mark.parametrize("kind", ["different", "ties", "one", "two", "skewed", "steep"])
def test_tiles_are_those_of_a_sort(spark, monkeypatch, kind, few):
    monkeypatch.setattr(selection, "FEW", few)
    rows = frame(spark, values_of(kind, 1_203))
    ends = selection.cuts(rows, {"v": F.col("value")}, "id", selection.tile_ends(1_203, 5), 1_203)
    found = rows.select("id", selection.tile_of(F.col("value"), "id", ends["v"]).alias("t"))
    wanted = rows.select("id", F.ntile(5).over(Window.orderBy("value", "id")).alias("t"))
    assert sorted(found.collect()) == sorted(wanted.collect())


@pytest.mark.parametrize("count", [0, 1, 3, 5, 7])
def test_few_rows(spark, count):
    rows = frame(spark, values_of("ties", count))
    ends = selection.cuts(rows, {"v": F.col("value")}, "id", selection.tile_ends(count, 5))
    found = rows.select("id", selection.tile_of(F.col("value"), "id", ends["v"]).alias("t"))
    wanted = rows.select("id", F.ntile(5).over(Window.orderBy("value", "id")).alias("t"))
    assert sorted(found.collect()) == sorted(wanted.collect())


def test_a_sketch_that_is_far_out_is_corrected(spark, monkeypatch):
    """Margins that enclose nothing: each miss still narrows, from the other side."""
    monkeypatch.setattr(selection, "FEW", 3)
    monkeypatch.setattr(selection, "MARGIN", -0.3)
    monkeypatch.setattr(selection, "GRID", 8)
    values = sorted(values_of("different", 400))
    rows = frame(spark, values)
    places = [1, 77, 200, 399, 400]
    sought = [selection.Sought(F.col("value"), F.lit(True), place) for place in places]
    selection.find(rows, sought)
    assert [(x.found, x.below) for x in sought] == [(values[n - 1], n - 1) for n in places]


def test_a_place_that_is_not_there(spark):
    with pytest.raises(ValueError, match="place 4"):
        selection.find(frame(spark, [1, 2, 3]), [selection.Sought(F.col("value"), F.lit(True), 4)])
    with pytest.raises(ValueError, match="beyond 3"):
        selection.find(frame(spark, [1, 2, 3]), [selection.Sought(F.col("value"), F.lit(True), 4)], 3)


def test_scores_sort_and_shuffle_no_customers(spark, monkeypatch):
    """The only exchanges of customers are those that sum their sales."""
    from checks.registry import tables

    plans = []
    found = selection.find

    def watched(rows, *rest):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return found(rows, *rest)

    monkeypatch.setattr(selection, "find", watched)
    scores = customers.rfm_scores(tables(spark, FOLDER, "clean"))
    plans.append(scores._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 3
    for plan in plans:
        assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
