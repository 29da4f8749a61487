from __future__ import annotations

import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from countinghouse.schemas import TABLES  # noqa: E402
from countinghouse.session import local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "8",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    yield session
    session.stop()


def money(value) -> Decimal:
    return Decimal(str(value))


@pytest.fixture(scope="session")
def shop(spark):
    """A shop small enough to check by hand.

    Branch 3 and employee 3 have no sale, product 13 was never sold, sale 104
    has no item, sale 103 is a walk-in, February 2024 has no sale.
    """
    rows = {
        "branches": [
            (1, "North", "Oldtown", date(2020, 1, 1)),
            (2, "South", "Oldtown", date(2020, 1, 1)),
            (3, "Empty", "Newtown", None),
        ],
        "customers": [
            (1, "Ann", "091", "Oldtown", date(2021, 1, 1)),
            (2, "Bob", None, None, date(2021, 1, 1)),
            (3, "Cleo", "093", "Newtown", date(2024, 4, 1)),
        ],
        "suppliers": [(1, "Smith", "Oldtown", None), (2, "Idle", None, None)],
        "gold_types": [(1, "24K"), (2, "22K")],
        "employees": [
            (1, "Eve", 1, "Cashier", date(2020, 1, 1), money("100.00")),
            (2, "Fay", 2, "Cashier", date(2024, 3, 5), money("0.00")),
            (3, "Gus", 1, "Cashier", date(2020, 1, 1), money("100.00")),
        ],
        "products": [
            (11, "Ring", "Ring", 1, money("1.00"), money("1.00"), money("6.00"), money("10.00"), 1),
            (12, "Chain", "Chain", 2, money("2.00"), money("1.00"), money("15.00"), money("20.00"), 1),
            (13, "Dust", "Ring", 1, money("3.00"), money("1.00"), money("1.00"), money("2.00"), 1),
        ],
        "sales": [
            (101, 1, 1, 1, datetime(2024, 1, 31, 23, 59, 59), "Cash", money("3.00")),
            (102, 2, 1, 1, datetime(2024, 3, 1, 9, 0, 0), "Card", money("0.00")),
            (103, None, 2, 2, datetime(2024, 3, 10, 9, 0, 0), "Cash", money("0.00")),
            (104, 3, 2, 2, datetime(2024, 3, 20, 9, 0, 0), "Card", money("1.00")),
            (105, 1, 2, 2, datetime(2024, 7, 29, 9, 0, 0), "Cash", money("0.00")),
        ],
        "sale_items": [
            ("a", 101, 11, 1, money("10.00")),
            ("b", 101, 12, 1, money("20.00")),
            ("c", 102, 11, 2, money("10.00")),
            ("d", 103, 12, 1, money("20.01")),
            ("e", 105, 11, 1, money("9.99")),
        ],
        "inventory": [
            (1, 1, 11, 1, 2, date(2024, 1, 1)),
            (2, 1, 12, 9, 2, date(2024, 1, 1)),
            (3, 1, 13, 0, 2, date(2024, 1, 1)),
        ],
        "gold_prices": [
            (date(2024, 1, 1), 1, money("100.00")),
            (date(2024, 1, 2), 1, money("101.00")),
            (date(2024, 3, 1), 1, money("110.00")),
            (date(2024, 3, 1), 2, money("90.00")),
        ],
    }
    return {
        name: spark.createDataFrame(rows[name], spec.schema) for name, spec in TABLES.items()
    }


@pytest.fixture(scope="session")
def nothing(spark):
    """All ten tables without rows."""
    return {name: spark.createDataFrame([], spec.schema) for name, spec in TABLES.items()}
