from __future__ import annotations

import math
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from countinghouse.functions import dates, numbers, text
from countinghouse.functions.ordering import tile


def column(spark, kind, values, expression):
    frame = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in frame.select(expression(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("given_text", "expected"),
    [
        ("jacobson-baker o'brien", "Jacobson-Baker O'Brien"),
        ("foo_bar  24k 9ab", "Foo_Bar  24k 9ab"),
        ("  LTD.co  ", "Ltd.Co"),
        ("-x", "-X"),
        ("ÉCOLE élan", "École Élan"),
        ("", ""),
        (None, None),
    ],
)
def test_tidy_name(spark, given_text, expected):
    assert column(spark, "string", [given_text], text.tidy_name) == [expected]


def test_blank_becomes_null(spark):
    values = ["  ", "", " a ", None]
    assert column(spark, "string", values, text.blank_to_null) == [None, None, "a", None]
    assert column(spark, "string", [" "], text.tidy_optional_name) == [None]


def _half_up(value: Fraction, digits: int = 2) -> float:
    scaled = abs(value) * 10**digits
    whole = math.floor(scaled + Fraction(1, 2))
    return float(Decimal(-whole if value < 0 else whole).scaleb(-digits))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.integers(-(10**12), 10**12), st.integers(-(10**9), 10**9)
        ),
        min_size=1,
        max_size=20,
    )
)
def test_ratio_is_exact(spark, pairs):
    rows = [(Decimal(a).scaleb(-2), Decimal(b).scaleb(-2)) for a, b in pairs]
    frame = spark.createDataFrame(rows, "a decimal(20,2), b decimal(20,2)")
    found = [r[0] for r in frame.select(numbers.ratio(F.col("a"), F.col("b"))).collect()]
    expected = [None if b == 0 else _half_up(Fraction(a) / Fraction(b)) for a, b in rows]
    assert [x if x is None else x + 0.0 for x in found] == [
        x if x is None else x + 0.0 for x in expected
    ]


def test_half_cents_round_away_from_zero(spark):
    frame = spark.createDataFrame(
        [(Decimal("10.01"), 2), (Decimal("-10.01"), 2), (Decimal("1.005") * 2, 2)],
        "total decimal(12,2), n long",
    )
    found = [r[0] for r in frame.select(numbers.average(F.col("total"), F.col("n"))).collect()]
    assert found == [5.01, -5.01, 1.01]


def test_percent_change_needs_an_earlier_value(spark):
    frame = spark.createDataFrame(
        [(Decimal(150), Decimal(100)), (Decimal(50), Decimal(-100)), (Decimal(1), Decimal(0)),
         (Decimal(1), None)],
        "now decimal(12,2), before decimal(12,2)",
    )
    change = numbers.percent_change(F.col("now"), F.col("before"))
    assert [r[0] for r in frame.select(change).collect()] == [50.0, -150.0, None, None]


def test_unparseable_numbers_become_null(spark):
    frame = spark.createDataFrame([("1.5", "x"), ("n/a", "y"), (None, "z")], "a string, b string")
    shown = numbers.as_numbers(frame, ["a", "missing"])
    assert [tuple(r) for r in shown.collect()] == [(1.5, "x"), (None, "y"), (None, "z")]


def test_first_present_column(spark):
    frame = spark.createDataFrame([], "segment string, other int")
    assert numbers.first_present(frame, ["customer_segment", "segment"]) == "segment"
    assert numbers.first_present(frame, ["nope"]) is None


def test_weekday_starts_on_sunday(spark):
    frame = spark.createDataFrame(
        [(datetime(2024, 3, 3, 23, 59),), (datetime(2024, 3, 9, 0, 0),)], "x timestamp_ntz"
    )
    number = dates.weekday_number(F.col("x"))
    found = frame.select(number, dates.weekday_name(number)).collect()
    assert [tuple(r) for r in found] == [(0, "Sunday"), (6, "Saturday")]


def test_tile_formula_for_every_small_case(spark):
    cases = [(n, k, p) for n in range(1, 14) for k in (1, 2, 4, 5, 7) for p in range(1, n + 1)]
    frame = spark.createDataFrame(cases, "n long, k int, p long")
    for k in (1, 2, 4, 5, 7):
        found = frame.filter(F.col("k") == k).select(
            "n", "p", tile(F.col("p"), F.col("n"), k).alias("t")
        ).collect()
        for n in range(1, 14):
            tiles = [r.t for r in sorted(found) if r.n == n]
            sizes = [tiles.count(i + 1) for i in range(k)]
            assert tiles == sorted(tiles)
            assert sizes == [n // k + (i < n % k) for i in range(k)]


def test_sum_of_exact_amounts_rounds_like_decimal(spark):
    values = [Decimal("0.005"), Decimal("0.015")]
    frame = spark.createDataFrame([(v,) for v in values], "x decimal(10,3)")
    found = [r[0] for r in frame.select(F.round("x", 2)).collect()]
    assert found == [v.quantize(Decimal("0.01"), ROUND_HALF_UP) for v in values]
