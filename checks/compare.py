"""Run reports in Spark and DuckDB on the same files and compare the rows.

    python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

from checks.registry import queries
from checks.statements import oracle_sql
from countinghouse.session import local_session


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if hasattr(value, "isoformat"):
        text = value.isoformat()
        return text.removesuffix("T00:00:00")
    return value


def rows_of(frame_columns, records):
    order = sorted(range(len(frame_columns)), key=lambda i: frame_columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in records]
    return sorted(plain, key=repr)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def difference(spark, db, folder: str, name: str) -> str | None:
    """What differs between the two engines, or None."""
    frame = queries()[name](spark, folder)
    ours = rows_of(frame.columns, frame.collect())
    sql = oracle_sql().get(name)
    if sql is None:
        return None if ours else "no rows"
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows, first {wrong[0][0]} against {wrong[0][1]}"
    kinds = [(type(a).__name__, type(b).__name__) for x, y in zip(ours, theirs) for a, b in zip(x, y)
             if type(a) is not type(b)]
    return f"types {set(kinds)}" if kinds else None


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = local_session()
    db = connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            found = difference(spark, db, folder, name)
        except Exception as error:  # report and go on with the next one
            found = f"{type(error).__name__}: {str(error)[:600]}"
            if len(names) < 4:
                traceback.print_exc()
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.1f}s {found or ''}",
              flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")


if __name__ == "__main__":
    main()
