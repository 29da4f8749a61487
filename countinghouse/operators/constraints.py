"""Keys and checks as validation operators.

A database rejects a bad row at load time. Files accept it, so each rule here
counts its violations, ``enforce`` fails on the first broken rule, and
``quarantine`` splits a table into valid rows and rejected rows with reasons.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countinghouse.operators.quality import lost_keys
from countinghouse.schemas import TABLES, Table
from countinghouse.session import stored

Tables = dict[str, DataFrame]


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _counted(df: DataFrame, table: str, label: str, rules: dict[str, Column]) -> DataFrame:
    """One pass over ``df``: (table_name, label, violations) for every rule."""
    rows = [
        F.struct(F.lit(name).alias(label), F.count_if(broken).alias("violations"))
        for name, broken in rules.items()
    ]
    return df.agg(F.array(*rows).alias("rules")).select(
        F.lit(table).alias("table_name"), F.inline("rules")
    )


def not_null(tables: Tables) -> DataFrame:
    return _union(
        _counted(
            df, name, "column_name",
            {c: F.col(c).isNull() for c in TABLES[name].required if c in df.columns},
        )
        for name, df in tables.items()
    )


def _repeated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fully known key values held by more than one row."""
    return (
        df.dropna(subset=list(columns))
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def _repeats(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    return _repeated(df, columns).agg(
        F.count(F.lit(1)).alias("repeated_keys"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_involved"),
    ).select(
        F.lit(table).alias("table_name"),
        F.lit(",".join(columns)).alias("key_columns"),
        "repeated_keys", "rows_involved",
    )


def primary_key(tables: Tables) -> DataFrame:
    """Repeated keys; NULL key parts are reported by ``not_null``."""
    return _union(_repeats(df, name, TABLES[name].key) for name, df in tables.items())


def unique(tables: Tables) -> DataFrame:
    return _union(
        _repeats(df, name, columns)
        for name, df in tables.items()
        for columns in TABLES[name].unique
    )


def _broken(predicate: str) -> Column:
    """A NULL outcome passes, as in a SQL check."""
    return ~F.coalesce(F.expr(predicate), F.lit(True))


def check(tables: Tables) -> DataFrame:
    return _union(
        _counted(df, name, "column_name", {c: _broken(p) for c, p in TABLES[name].checks.items()})
        for name, df in tables.items()
        if TABLES[name].checks
    )


def foreign_key(tables: Tables) -> DataFrame:
    """Rows whose known key value has no parent row, counted per key before the join."""
    results = []
    for name, df in tables.items():
        for column, parent in TABLES[name].parents.items():
            keys = tables[parent].select(F.col(TABLES[parent].key[0]).alias(column))
            held = df.dropna(subset=[column]).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
            lost = held.join(keys, column, "left_anti")
            results.append(
                lost.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("violations")).select(
                    F.lit(name).alias("table_name"),
                    F.lit(column).alias("column_name"),
                    F.lit(parent).alias("parent_table"),
                    "violations",
                )
            )
    return _union(results)


def with_defaults(df: DataFrame, spec: Table) -> DataFrame:
    """Fill columns the input omits. A stored NULL is not a missing column."""
    missing = {
        c: F.lit(value).cast(spec.columns[c])
        for c, value in spec.defaults.items()
        if c not in df.columns
    }
    return df.withColumns(missing) if missing else df


def _too_wide(df: DataFrame, spec: Table) -> dict[str, Column]:
    """By column: text longer than declared, or a number the declared decimal can't hold."""
    rules = {c: F.length(c) > n for c, n in spec.text_limits.items() if c in df.columns}
    rules |= {
        c: F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()
        for c, kind in spec.columns.items()
        if kind.startswith("decimal") and c in df.columns
    }
    return rules


def type_limits(tables: Tables, declared: dict[str, Table] | None = None) -> DataFrame:
    """Text longer than declared, and numbers that do not fit the declared decimal."""
    limits = {n: _too_wide(df, (declared or TABLES)[n]) for n, df in tables.items()}
    return _union(
        _counted(tables[name], name, "column_name", rules)
        for name, rules in limits.items()
        if rules
    )


def not_future(branches: DataFrame, as_of: str) -> DataFrame:
    return branches.filter(F.col("opening_date") > F.lit(as_of).cast("date"))


def _flagged(df: DataFrame, keys: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Append ``label`` to the reasons of the rows whose key is listed in ``keys``."""
    listed = keys.select(*columns, F.lit(label).alias("_label"))
    marked = df.join(listed, list(columns), "left")
    return marked.withColumn("reasons", F.array_append("reasons", F.col("_label"))).drop("_label")


def _rules(name: str, df: DataFrame) -> list[Column]:
    """Reasons that a row shows by itself."""
    spec = TABLES[name]
    present = [c for c in spec.required if c in df.columns]
    reasons = [F.when(F.col(c).isNull(), F.lit(f"not_null:{c}")) for c in present]
    reasons += [F.when(_broken(p), F.lit(f"check:{c}")) for c, p in spec.checks.items()]
    reasons += [F.when(wide, F.lit(f"type:{c}")) for c, wide in _too_wide(df, spec).items()]
    return reasons


def _judged(name: str, df: DataFrame, parents: Tables) -> DataFrame:
    """``df`` with ``reasons``, an array that is empty for a valid row.

    ``parents`` holds the valid keys of the parent tables. Distinct keys only are compared.
    """
    spec = TABLES[name]
    out = df.withColumn("reasons", F.array(*_rules(name, df)))
    for columns in (spec.key, *spec.unique):
        label = f"unique:{','.join(columns)}"
        out = _flagged(out, _repeated(df, columns), columns, label)
    for column, parent in spec.parents.items():
        lost = lost_keys(df, parents[parent].toDF(column), column)
        out = _flagged(out, lost, [column], f"foreign_key:{column}")
    return out.withColumn("reasons", F.array_compact("reasons"))


def _judge_all(tables: Tables) -> Tables:
    """Every table judged, parents first.

    Every copy of a repeated key is rejected: no rule prefers one of them. A child of a
    rejected parent is rejected too, since its parent would be absent from the cleaned
    layer. One plan for each level of parents finds and stores their valid keys, so that
    no table is judged again for each of its descendants.
    """
    specs = {name: TABLES[name] for name in TABLES if name in tables}
    asked = {parent for spec in specs.values() for parent in spec.parents.values()}
    results: Tables = {}
    keys: Tables = {}
    while len(results) < len(specs):
        level = [
            name
            for name, spec in specs.items()
            if name not in results and all(parent in keys for parent in spec.parents.values())
        ]
        results |= {name: _judged(name, tables[name], keys) for name in level}
        if wanted := [name for name in level if name in asked]:
            valid = stored(
                _union(
                    results[name]
                    .filter(F.size("reasons") == 0)
                    .select(F.lit(name).alias("table_name"), F.col(specs[name].key[0]).alias("key"))
                    for name in wanted
                ),
                "valid-keys",
            )
            keys |= {n: valid.filter(F.col("table_name") == n).select("key") for n in wanted}
    return {name: results[name] for name in specs}


def quarantine(tables: Tables) -> tuple[Tables, Tables]:
    """Valid rows and rejected rows, the latter with their ``reasons``."""
    results = _judge_all(tables)
    valid = {n: df.filter(F.size("reasons") == 0).drop("reasons") for n, df in results.items()}
    rejected = {n: df.filter(F.size("reasons") > 0) for n, df in results.items()}
    return valid, rejected


def quarantine_summary(tables: Tables) -> DataFrame:
    """Rows per table and outcome: ``valid``, ``rejected`` and each single reason."""
    outcome = F.when(F.size("reasons") == 0, F.array(F.lit("valid"))).otherwise(
        F.array_append("reasons", F.lit("rejected"))
    )
    return _union(
        rows.select(F.explode(outcome).alias("outcome"))
        .groupBy("outcome")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(name).alias("table_name"), "outcome", "row_count")
        for name, rows in _judge_all(tables).items()
    )


class RuleViolation(ValueError):
    """Rows were found that break a rule."""


def enforce(tables: Tables) -> None:
    """Raise when any rule is broken, as a database would at load time."""
    found = _union(
        [
            not_null(tables).selectExpr("table_name", "column_name as rule", "violations"),
            check(tables).selectExpr("table_name", "column_name as rule", "violations"),
            foreign_key(tables).selectExpr("table_name", "column_name as rule", "violations"),
            primary_key(tables).selectExpr(
                "table_name", "key_columns as rule", "repeated_keys as violations"
            ),
            unique(tables).selectExpr(
                "table_name", "key_columns as rule", "repeated_keys as violations"
            ),
            type_limits(tables).selectExpr("table_name", "column_name as rule", "violations"),
        ]
    ).filter("violations > 0")
    broken = found.collect()  # at most one row per declared rule
    if broken:
        raise RuleViolation("; ".join(f"{r.table_name}.{r.rule}: {r.violations}" for r in broken))
