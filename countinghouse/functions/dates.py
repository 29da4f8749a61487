"""Calendar helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def month_of(moment: Column) -> Column:
    return F.trunc(F.to_date(moment), "month")


def day_of(moment: Column) -> Column:
    return moment.cast("date")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def weekday_number(moment: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(F.to_date(moment)) - 1).cast("int")


def weekday_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _DAY_NAMES)), number + 1)
