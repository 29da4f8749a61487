"""Exact money and ratio arithmetic.

Money stays DECIMAL until the last step. A rounded quotient is computed as an
integer division, so it is the true value rounded half away from zero and does
not depend on the order in which rows were added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = "decimal(38,2)"


def money(amount: Column) -> Column:
    """Presentation form of an exact amount."""
    return amount.cast("double")


def ratio(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """``round(numerator / denominator, digits)``; NULL for a zero denominator."""
    top, bottom = numerator.cast(_WHOLE), denominator.cast(_WHOLE)
    scaled = F.abs(top) * F.lit(2 * 10**digits) + F.abs(bottom)
    size = F.call_function("div", scaled, F.abs(bottom) * F.lit(2))
    signed = F.when((top < 0) != (bottom < 0), -size).otherwise(size)
    return F.when(bottom != 0, signed.cast("double") / F.lit(10.0**digits))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part * F.lit(100), whole)


def percent_change(now: Column, before: Column) -> Column:
    """Growth against the earlier value; NULL when there is none or it is zero."""
    return percent(now - before, before)


def average(total: Column, count: Column) -> Column:
    return ratio(total, count)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def revenue(prefix: str = "") -> Column:
    return F.col(prefix + "quantity") * F.col(prefix + "unit_price")


def presentable(df: DataFrame) -> DataFrame:
    """Every DECIMAL column as DOUBLE, for the edge of a report."""
    return df.select(
        *(
            F.col(field.name).cast("double").alias(field.name)
            if isinstance(field.dataType, T.DecimalType)
            else F.col(field.name)
            for field in df.schema.fields
        )
    )


def as_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns, where present, as numbers; unparseable text becomes NULL."""
    present = [name for name in columns if name in df.columns]
    return df.withColumns({name: F.col(name).try_cast("double") for name in present})


def first_present(df: DataFrame, candidates: list[str]) -> str | None:
    return next((name for name in candidates if name in df.columns), None)
