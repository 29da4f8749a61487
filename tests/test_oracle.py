"""Every registered report against DuckDB on the given files."""

from __future__ import annotations

import pytest

from checks.compare import connect, difference
from checks.registry import queries
from checks.statements import oracle_sql
from tests.conftest import FOLDER

NAMES = list(queries())


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_report_has_a_statement():
    assert set(oracle_sql()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_report_agrees(spark, db, name):
    assert difference(spark, db, FOLDER, name) is None
