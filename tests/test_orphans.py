from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

from countinghouse.operators import quality

ROOT = Path(__file__).resolve().parents[1]

MOVED = """
import sys
from countinghouse.operators import quality
from countinghouse.session import local_session
spark = local_session("2", spark__eventLog__enabled="true", spark__eventLog__dir=sys.argv[1],
    spark__eventLog__compress="false", spark__eventLog__rolling__enabled="false",
    spark__checkpoint__dir=sys.argv[2], spark__sql__autoBroadcastJoinThreshold="-1")
items = spark.range(60_000).selectExpr(
    "concat(sha2(string(id), 512), sha2(string(-id), 512)) as sale_item_id",
    "id div 4 as sale_id", "id % 3000 as product_id")
sales = spark.range(5, 60_000).selectExpr("id as sale_id", "if(id = 77, -1, id % 500) as customer_id",
    "concat(sha2(string(id), 512), sha2(string(-id), 512)) as payment_method")
t = {"sale_items": items, "sales": sales, "products": spark.range(2_999).toDF("product_id"),
     "customers": spark.range(500).toDF("customer_id")}
spark.sparkContext.setJobDescription("items")
print(len(quality.orphan_sale_items(t).collect()))
spark.sparkContext.setJobDescription("sales")
print(len(quality.orphan_sales_customer(t).collect()))
"""


def test_only_rows_that_may_be_orphans_are_shuffled(tmp_path):
    """The event log tells what was moved; joins are not broadcast, as with large parents."""
    events = tmp_path / "events"
    events.mkdir()
    ran = subprocess.run(
        [sys.executable, "-c", MOVED, events.as_uri(), (tmp_path / "shared").as_uri()],
        cwd=ROOT, capture_output=True, text=True, timeout=240,
    )
    assert ran.stdout.split() == ["40", "1"], ran.stderr
    stages, moved = {}, {"items": 0, "sales": 0}
    for line in "".join(x.read_text() for x in events.iterdir()).splitlines():
        event = json.loads(line)
        if event["Event"] == "SparkListenerJobStart":
            stages |= dict.fromkeys(event["Stage IDs"], event["Properties"].get("spark.job.description"))
        if event["Event"] == "SparkListenerTaskEnd" and stages.get(event["Stage ID"]) in moved:
            written = event["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"]
            moved[stages[event["Stage ID"]]] += written
    # Whole items take 15 MB and more, the filters 4 MB at most.
    assert 0 < moved["items"] < 6_000_000 and 0 < moved["sales"] < 6_000_000, moved


def test_a_full_filter_loses_and_adds_no_row(spark, monkeypatch):
    """A filter that lets everything pass: the rows are compared with the lost keys in any case."""
    monkeypatch.setattr(quality, "FILTER_BITS", 6)
    rows = [(n, None if n % 11 == 0 else n % 50, None if n % 13 == 0 else n % 30) for n in range(300)]
    items = spark.createDataFrame(rows + rows, "sale_item_id int, sale_id bigint, product_id bigint")
    t = {
        "sale_items": items,
        "sales": spark.createDataFrame([(n,) for n in range(0, 50, 2)] * 2, "sale_id bigint"),
        "products": spark.createDataFrame([(n,) for n in range(3, 30)] + [(None,)], "product_id bigint"),
    }
    wanted = [r for r in rows if None in r or r[1] % 2 or r[2] < 3]
    assert sorted(r.sale_item_id for r in quality.orphan_sale_items(t).collect()) == sorted(
        [n for n, _, _ in wanted] * 2
    )
    known = quality.orphans(items, t["sales"], "sale_id")
    odd = [n for n, sale, _ in rows if sale is not None and sale % 2]
    assert sorted(r.sale_item_id for r in known.collect()) == sorted(odd * 2)


def test_no_lost_key(spark):
    items = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "sale_item_id int, sale_id bigint, product_id bigint")
    t = {"sale_items": items, "sales": items.select("sale_id"), "products": items.select("product_id")}
    assert quality.orphan_sale_items(t).count() == 0
    assert quality.orphan_sale_items({**t, "sale_items": items.limit(0)}).count() == 0
