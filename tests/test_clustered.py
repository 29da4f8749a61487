from __future__ import annotations

import json
import subprocess
import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks.registry import CLUSTER_FILES, CLUSTER_KEYS, queries, tables
from countinghouse.operators.measures import sale_lines
from countinghouse.session import fresh_path
from countinghouse.sources import clustered

#: Large enough for all 25 branches to have sales; no branch holds a fifth of them.
FOLDER = "/root/testdata/sf0.01"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def layout(spark):
    lines = sale_lines(tables(spark, FOLDER, "clean"))
    root = fresh_path(spark, "lines")
    manifest = clustered.write_clustered(
        lines, root, CLUSTER_KEYS, ["sale_item_id"], CLUSTER_FILES
    )
    return root, lines, manifest


@pytest.mark.parametrize("key", CLUSTER_KEYS)
def test_each_key_reads_under_a_fifth_of_the_files(spark, layout, key):
    root, lines, manifest = layout
    total = manifest.count()
    assert CLUSTER_FILES * 0.9 < total <= 2 * CLUSTER_FILES
    values = [row[0] for row in lines.select(key).distinct().orderBy(key).collect()]
    known = [x for x in values if x is not None]
    reads = []
    for value in known[:: max(1, len(known) // 8)]:
        found = clustered.lookup(spark, root, lines.schema, **{key: value})
        reads.append(len(found.inputFiles()))
        assert sorted(found.collect()) == sorted(lines.filter(F.col(key) == value).collect())
    assert max(reads) < total / 5, reads


def test_two_keys_read_fewer_files(spark, layout):
    root, lines, manifest = layout
    one = clustered.files_for(manifest, lines.schema, branch_id=3)
    both = clustered.files_for(manifest, lines.schema, branch_id=3, product_id=17)
    assert set(both) < set(one) and len(both) < len(one) / 3
    empty = clustered.lookup(spark, root, lines.schema, branch_id=-1)
    assert empty.count() == 0 and empty.inputFiles() == []


def test_the_plan_reads_the_chosen_files_only(spark, layout):
    root, lines, manifest = layout
    found = clustered.lookup(spark, root, lines.schema, product_id=17)
    chosen = clustered.files_for(manifest, lines.schema, product_id=17)
    plan = found._jdf.queryExecution().executedPlan()
    assert sorted("/".join(x.split("/")[-2:]) for x in found.inputFiles()) == chosen
    assert f"InMemoryFileIndex({len(chosen)} paths)" in plan.toString()
    assert "EqualTo(product_id,17)" in plan.toString()


def test_each_query_stores_the_layout_itself(spark, monkeypatch):
    """A query does the same work whatever ran before it in the session."""
    seen, write = [], clustered.write_clustered

    def watched(df, root, keys, tie, files):
        seen.append((root, list(keys), files))
        return write(df, root, keys, tie, 4)

    monkeypatch.setattr(clustered, "write_clustered", watched)
    for name in ("x_clustered_customer", "x_clustered_branch_product", "x_clustered_branch_product"):
        queries()[name](spark, "/root/testdata/sf0.001")
    assert len({root for root, _, _ in seen}) == 3
    assert {(*keys, files) for _, keys, files in seen} == {(*CLUSTER_KEYS, CLUSTER_FILES)}


def test_bits_of_all_keys_are_interleaved(spark):
    frame = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "a int, b bigint")
    code = clustered.morton(frame, ["a", "b"], {"a": [1, 2, 3], "b": [1, 2, 3]}, bits=2)
    for row in frame.select("a", "b", code.alias("code")).collect():
        bits = [row.a >> 1, row.b >> 1, row.a & 1, row.b & 1]
        assert row.code == int("".join(map(str, bits)), 2)


def test_hot_values_nulls_dates_and_repeated_rows(spark):
    rows = [(n % 3 and 7, date(2024, 1, 1 + n % 28) if n % 5 else None, n) for n in range(900)]
    frame = spark.createDataFrame([(k or None, d, n) for k, d, n in rows], "k int, d date, n bigint")
    twice = frame.unionByName(frame)
    root = fresh_path(spark, "hot")
    manifest = clustered.write_clustered(twice, root, ["k", "d"], ["n"], 32)
    assert manifest.agg(F.max("rows")).first()[0] < 300  # two thirds of the rows share k
    found = clustered.lookup(spark, root, twice.schema, k=7, d=date(2024, 1, 9))
    wanted = [n for k, d, n in rows if k == 7 and d == date(2024, 1, 9)]
    assert sorted(row.n for row in found.collect()) == sorted(wanted * 2)
    assert spark.read.schema(twice.schema).parquet(f"{root}/rows").count() == 1_800


def test_an_empty_table(spark):
    frame = spark.createDataFrame([], "k bigint, d timestamp_ntz")
    root = fresh_path(spark, "empty")
    assert clustered.write_clustered(frame, root, ["k", "d"], [], 4).agg(F.sum("rows")).first()[0] is None
    assert clustered.lookup(spark, root, frame.schema, k=1).count() == 0


def test_text_is_no_key(spark, layout):
    _, lines, _ = layout
    with pytest.raises(TypeError, match="sale_item_id"):
        clustered.quantiles(lines, ["sale_item_id"])


SCAN = """
import sys
from countinghouse.session import fresh_path, local_session
from countinghouse.sources import clustered
spark = local_session("2", spark__eventLog__enabled="true", spark__eventLog__dir=sys.argv[1],
    spark__eventLog__compress="false", spark__eventLog__rolling__enabled="false",
    spark__checkpoint__dir=sys.argv[2])
rows = spark.range(40_000).selectExpr("id", "id * 7919 % 20000 as key")
stored = clustered.write_filtered(rows, fresh_path(spark, "filtered"), ["id"], ["key"], 1_000)
spark.sparkContext.setJobDescription("looked up")
print(stored.filter("key = 4242").count(), stored.filter("key = 777777").count())
"""


def test_row_groups_are_left_out_by_bloom_filters(tmp_path):
    """The event log tells how many rows the scan has read; min and max deny no group."""
    events = tmp_path / "events"
    events.mkdir()
    ran = subprocess.run(
        [sys.executable, "-c", SCAN, events.as_uri(), (tmp_path / "shared").as_uri()],
        cwd=ROOT, capture_output=True, text=True, timeout=240,
    )
    assert ran.stdout.split() == ["2", "0"], ran.stderr
    stages, read = set(), 0
    for line in "".join(x.read_text() for x in events.iterdir()).splitlines():
        event = json.loads(line)
        if event["Event"] == "SparkListenerJobStart":
            if event["Properties"].get("spark.job.description") == "looked up":
                stages.update(event["Stage IDs"])
        if event["Event"] == "SparkListenerTaskEnd" and event["Stage ID"] in stages:
            read += event["Task Metrics"]["Input Metrics"]["Records Read"]
    assert 2 <= read <= 6_000  # two groups of 1 000 hold the value, of 40; about one in a hundred errs
