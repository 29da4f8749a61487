from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from countinghouse.llm import queries, topk
from tests.llm.conftest import FOLDER

NAN, INF = float("nan"), float("inf")


def plain(rows, k):
    vectors = [
        (n, [math.floor(256 * x) for x in v])
        for n, v in rows
        if n is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    asked = {}
    for n, v in vectors:
        if n % 50 == 0:
            asked[n] = min(v, asked.get(n, v))
    out = []
    for n, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), m) for m, w in vectors if m != n)[:k]
        out += [(n, rank, m, -score) for rank, (score, m) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(
    "blocks, k, parts, kept",
    [
        ((1_024, 8_192), 5, 2, 64),
        ((1_024, 8_192), 5, 2, 1),
        ((3, 16), 5, 2, 6),
        ((2, 7), 1, 3, 1),
        ((2, 90), 3, 1, 3),
        ((2, 3), 300, 4, 64),
    ],
)
def test_like_brute_force(spark, monkeypatch, blocks, k, parts, kept):
    pick = random.Random(1)
    rows = [(n, [pick.randint(-3, 3) / 256 for _ in range(5)]) for n in range(160)]
    rows += [(300 + n, [0.1] * 5) for n in range(30)] + [(7, [0.5] * 5), (50, [9.0] * 5)]
    rows += [(None, [1.0] * 5), (400, None), (401, []), (402, [1.0, None]), (403, [NAN]), (450, [INF])]
    rows += [(500, [1e6] * 5), (501, [1e6] * 5), (350, [0.1] * 3)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    frame = frame.withColumn("id", F.lit(1)).withColumn("vector", F.lit(1))
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    found = topk.top_k(frame, F.col("vec_id") % 50 == 0, k=k, parts=parts, kept=kept)
    assert sorted(tuple(row) for row in found.collect()) == plain(rows, k)


def test_no_rows(spark):
    frame = spark.createDataFrame([(50, [1.0])], "vec_id bigint, embedding array<float>")
    assert topk.top_k(frame, F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_query_like_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    found = sorted(tuple(row) for row in queries.op5_uniform_threshold(spark, FOLDER).collect())
    assert found == sorted(duck.execute(queries.OP5_SQL).fetchall())


def test_scores_beyond_64_bits_are_refused(spark):
    huge = spark.createDataFrame([(50, [2.0**40, 1.0]), (1, [2.0**40, 1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="more than 64 bits"):
        topk.top_k(huge, F.col("vec_id") % 50 == 0).collect()
    large = spark.createDataFrame([(50, [2.0**21, 1.0]), (1, [2.0**21, 3.0])], "vec_id bigint, embedding array<double>")
    (row,) = topk.top_k(large, F.col("vec_id") % 50 == 0).collect()
    assert row.score == 2**58 + 3 * 2**16


def test_few_tiles_are_worked_out_again(spark, monkeypatch):
    """Of the given vectors; in a hot group of near copies the result stays whole."""
    entries, stored = {}, topk.stored

    def counted(frame, name):
        kept = stored(frame, name)
        entries[name] = kept.count()
        return kept

    monkeypatch.setattr(topk, "stored", counted)
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    assert topk.top_k(vectors, F.col("vec_id") % 50 == 0).count() == 5 * entries["queries"]
    assert entries["gathered"] == 5 * entries["queries"]
    assert entries["open"] <= entries["queries"] / 2
    pick = random.Random(3)
    near = [(n, [round(pick.uniform(0.9, 1.0), 3) for _ in range(6)]) for n in range(400)]
    near += [(401, [0.1] * 6)] * 50
    frame = spark.createDataFrame(near, "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 200)
    found = topk.top_k(frame, F.col("vec_id") % 50 == 0, kept=5)
    assert sorted(tuple(row) for row in found.collect()) == plain(near, 5)
    assert entries["open"] > 0 and entries["candidates"] == 405
