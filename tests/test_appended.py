from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from countinghouse.operators import appended
from countinghouse.session import stored

BLOCKS = appended.blocks_for(40_000)


@pytest.fixture(scope="module")
def known(spark):
    """Even numbers, and a filter of them that was put together from two halves."""
    rows = stored(spark.range(20_000).selectExpr("id * 2 as k", "id as v"), "known")
    halves = [appended.key_filter(rows.filter(F.col("v") % 2 == n), "k", BLOCKS) for n in range(2)]
    return rows, stored(appended.united(*halves), "filter")


def keys_of(df):
    return sorted(row.k for row in df.collect())


def test_the_filter_loses_no_key_and_lets_few_others_pass(spark, known):
    rows, keys = known
    assert keys.count() == BLOCKS
    assert keys_of(appended.maybe_known(rows, "k", keys, BLOCKS)) == list(range(0, 40_000, 2))
    others = spark.range(20_000).selectExpr("id * 2 + 1 as k")
    assert appended.maybe_known(others, "k", keys, BLOCKS).count() < 600
    whole = appended.key_filter(rows, "k", BLOCKS)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, keys.collect()))


def test_repeated_and_lost_keys(spark, known):
    rows, keys = known
    batch = spark.createDataFrame([(4,), (5,), (7,), (7,), (8,), (8,), (None,), (None,), (-2,)], "k bigint")
    found = appended.repeated_keys(rows, batch, "k", keys, BLOCKS)
    assert sorted(map(tuple, found.collect())) == [(4, 1, True), (7, 2, False), (8, 2, True)]
    lost = appended.orphans(rows, batch, "k", keys, BLOCKS)
    assert sorted(map(tuple, lost.collect())) == [(-2, 1), (5, 1), (7, 2)]


def test_the_stored_keys_stay_where_they_are(spark, known):
    """No exchange above the scan of what is stored but that of the few that are found."""
    rows, keys = known
    batch = spark.range(50).selectExpr("id as k")
    found = appended.known_keys(rows, batch, "k", keys, BLOCKS)
    assert keys_of(found) == list(range(0, 50, 2))
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin [k" in final and "LeftSemi" in final
    assert "SortMergeJoin" not in final


def test_texts_empty_tables_and_an_empty_batch(spark, known):
    rows, keys = known
    nothing = spark.createDataFrame([], "k bigint")
    assert appended.repeated_keys(rows, nothing, "k", keys, BLOCKS).count() == 0
    empty = appended.key_filter(nothing, "k", 1)
    batch = spark.createDataFrame([(1,), (1,), (2,)], "k bigint")
    assert keys_of(appended.repeated_keys(nothing, batch, "k", empty, 1)) == [1]
    assert keys_of(appended.orphans(nothing, batch, "k", empty, 1)) == [1, 2]
    names = spark.createDataFrame([("a",), ("é",)], "k string")
    text = appended.key_filter(names, "k", 1)
    asked = spark.createDataFrame([("é",), ("b",)], "k string")
    assert keys_of(appended.orphans(names, asked, "k", text, 1)) == ["b"]
