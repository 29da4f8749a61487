from __future__ import annotations

import threading
from datetime import date

import pytest
from pyspark.sql import functions as F

from countinghouse.session import fresh_path
from countinghouse.sources import versioned
from countinghouse.sources.versioned import WHOLE, Conflict, Version, VersionedTable

SCHEMA = "k bigint, v string"


@pytest.fixture
def table(spark):
    schema = spark.createDataFrame([], SCHEMA).schema
    return VersionedTable(spark, fresh_path(spark, "versioned"), schema)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def content(df):
    return sorted(map(tuple, df.collect()))


def test_nothing_is_stored_at_first(table):
    assert table.latest() == Version()
    assert table.read().count() == 0 and table.read().columns == ["k", "v"]


def test_versions_stay_as_they_are(spark, table):
    table.append(rows(spark, (1, "a")))
    first = table.latest()
    reader = table.read(first)
    table.append(rows(spark, (2, "b")))
    assert content(reader) == [(1, "a")] == content(table.read(table.at(1)))
    assert content(table.read()) == [(1, "a"), (2, "b")]
    assert table.latest().number == 2


def test_a_number_is_given_once(spark, table):
    base = table.latest()
    one, other = table.write(rows(spark, (1, "a"))), table.write(rows(spark, (2, "b")))
    table.commit(base, one, seen=7)
    with pytest.raises(Conflict):
        table.commit(base, other)
    assert content(table.read()) == [(1, "a")] and table.latest().marks == {"seen": 7}
    left = [x.getPath().getName() for x in table._files.listStatus(table._path("versions"))]
    assert [x for x in left if x.endswith(".json")] == ["000000000001.json"]
    assert not [x for x in left if len(x) == 33]  # no draft is left


def test_commits_of_many_threads(spark, table):
    """Everyone retries until it is in; no version is lost or doubled."""
    won, folder = [], {WHOLE: []}

    def writer(name):
        for _ in range(5):
            while True:
                base = table.latest()
                try:
                    won.append(table.commit(base, folder, **{name: base.number}).number)
                    break
                except Conflict:
                    pass

    threads = [threading.Thread(target=writer, args=(f"w{n}",)) for n in range(4)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert sorted(won) == list(range(1, 21))


def test_insert_ignore(spark, table):
    versioned.insert_ignore(table, rows(spark, (1, "a"), (2, "c"), (2, "b")), "k")
    versioned.insert_ignore(table, rows(spark, (2, "a"), (3, "z"), (3, "z")), "k")
    assert content(table.read()) == [(1, "a"), (2, "b"), (3, "z")]


def test_two_writers_insert_each_key_once(spark, table, monkeypatch):
    """Both look at the empty table before either commits."""
    meet, waited = threading.Barrier(2), set()
    commit, errors = VersionedTable.commit, []

    def together(self, base, parts, **marks):
        me = threading.get_ident()
        if me not in waited:
            waited.add(me)
            meet.wait(60)
        return commit(self, base, parts, **marks)

    monkeypatch.setattr(VersionedTable, "commit", together)

    def writer(name, keys):
        try:
            versioned.insert_ignore(table, rows(spark, *((k, name) for k in keys)), "k")
        except Exception as error:  # reported below, in the test's own thread
            errors.append(error)

    threads = [
        threading.Thread(target=writer, args=("one", range(60))),
        threading.Thread(target=writer, args=("two", range(40, 100))),
    ]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert not errors
    found = content(table.read())
    assert [k for k, _ in found] == list(range(100))
    assert table.latest().number == 2
    assert {v for k, v in found if k < 40} == {"one"} and {v for k, v in found if k > 59} == {"two"}
    assert len({v for k, v in found if 40 <= k < 60}) == 1  # all from the writer that won


@pytest.fixture
def months(spark):
    frame = spark.createDataFrame(
        [(date(2024, m, 1), n, f"{m}-{n}") for m in (1, 2, 3) for n in range(4)],
        "month date, k bigint, v string",
    )
    stored = VersionedTable(spark, fresh_path(spark, "months"), frame.schema)
    versioned.refresh_parts(stored, frame, "month", F.lit(True))
    return stored, frame


def test_a_changed_month_rewrites_one_folder(spark, months):
    stored, frame = months
    before = stored.latest()
    reader = stored.read(before)
    changed = frame.filter("k < 2").withColumn("v", F.concat("v", F.lit("!")))
    versioned.refresh_parts(stored, changed, "month", F.col("month") == date(2024, 2, 1))
    after = stored.latest()
    assert [x for x in after.parts if after.parts[x] != before.parts[x]] == ["2024-02-01"]
    found = sorted((str(row.month), row.k, row.v) for row in stored.read().collect())
    assert [x for x in found if x[0] == "2024-02-01"] == [
        ("2024-02-01", 0, "2-0!"), ("2024-02-01", 1, "2-1!"),
    ]
    assert len(found) == 10 and reader.count() == 12
    only = stored.read(parts=["2024-03-01"])
    assert only.count() == 4 and all("2024-03-01" in x for x in only.inputFiles())


def test_a_month_without_rows_goes(spark, months):
    stored, frame = months
    versioned.refresh_parts(stored, frame.limit(0), "month", F.col("month") < date(2024, 3, 1))
    assert list(stored.latest().parts) == ["2024-03-01"]


def test_a_broken_refresh_changes_nothing(spark, months):
    stored, frame = months
    broken = frame.withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        versioned.refresh_parts(stored, broken, "month", F.col("month") == date(2024, 1, 1))
    assert stored.latest().number == 1 and stored.read().count() == 12


def test_values_that_are_no_names_of_folders(spark):
    frame = spark.createDataFrame([("a/b=c%", 1), (None, 2), ("é ü", 3)], "part_of string, k int")
    stored = VersionedTable(spark, fresh_path(spark, "odd"), frame.schema)
    versioned.refresh_parts(stored, frame, "part_of", F.lit(True))
    assert set(stored.latest().parts) == {"a/b=c%", "null", "é ü"}
    assert sorted(map(tuple, stored.read().collect()), key=str) == sorted(map(tuple, frame.collect()), key=str)
