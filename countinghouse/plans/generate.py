"""Rules that shape a retail data set, as set operations.

Look-ups by date go through running counts over calendar days, so no pair of
sale and employee, or sale and customer, is ever formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countinghouse.functions.dates import day_of
from countinghouse.functions.numbers import average
from countinghouse.functions.ordering import with_position
from countinghouse.operators.measures import Tables

_WIDE = "decimal(38,0)"


def date_spine(t: Tables) -> DataFrame:
    """Every day from the first to the last sale, for every gold type."""
    day = day_of(F.col("sale_date"))
    first, last = (t["sales"].agg(f(day)).scalar() for f in (F.min, F.max))
    return t["gold_types"].select(
        "gold_type_id",
        first.alias("first"),
        F.explode(F.sequence(first, last)).alias("price_date"),
    ).select(
        "price_date",
        F.datediff("price_date", "first").cast("long").alias("day_index"),
        "gold_type_id",
    )


def average_price(t: Tables) -> DataFrame:
    price = F.col("price_per_gram")
    return t["gold_prices"].groupBy("gold_type_id").agg(
        average(F.sum(price), F.count(price)).alias("average_price")
    )


def _as_of(days: DataFrame, wanted: DataFrame, day: str, value: str, *by: str) -> DataFrame:
    """For each wanted day, the latest ``value`` known on or before it.

    Both sides hold at most one row per group and calendar day.
    """
    known = days.select(*by, day, value, F.lit(0).alias("_ask"))
    asked = wanted.select(*by, day, F.lit(None).cast("long").alias(value), F.lit(1).alias("_ask"))
    window = Window.partitionBy(*by).orderBy(day, "_ask").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    latest = F.coalesce(F.last(value, ignorenulls=True).over(window), F.lit(0)).alias(value)
    return (
        known.unionByName(asked)
        .select(*by, day, "_ask", latest)
        .filter("_ask = 1")
        .drop("_ask")
    )


def _running_days(df: DataFrame, day: str, name: str, *by: str) -> DataFrame:
    """Rows up to each day; the window runs over a group's calendar days."""
    window = Window.partitionBy(*by).orderBy(day).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    daily = df.groupBy(*by, day).agg(F.count(F.lit(1)).alias("_n"))
    return daily.select(*by, day, F.sum("_n").over(window).alias(name))


def _sale_days(t: Tables) -> DataFrame:
    return t["sales"].select("sale_id", "branch_id", day_of(F.col("sale_date")).alias("sale_day"))


def eligible_employees(t: Tables) -> DataFrame:
    """Per sale, how many of its branch's employees had been hired by its day."""
    staff = t["employees"].select("branch_id", F.col("hire_date").alias("sale_day"))
    sales = _sale_days(t)
    counts = _as_of(
        _running_days(staff, "sale_day", "eligible_employees", "branch_id"),
        sales.select("branch_id", "sale_day").distinct(),
        "sale_day", "eligible_employees", "branch_id",
    )
    return sales.join(counts, ["branch_id", "sale_day"]).select("sale_id", "eligible_employees")


def roster(t: Tables) -> DataFrame:
    """The employees in order of branch and hire date, with their ``place`` in this order."""
    staff = t["employees"].select("branch_id", "hire_date", "employee_id")
    order = [F.col(x) for x in ("branch_id", "hire_date", "employee_id")]
    return with_position(staff, order, "place").drop("place_count")


def _roster_days(staff: DataFrame) -> DataFrame:
    """Per branch and day of hire: where the branch's list begins and where it then ends."""
    mixed = F.col("employee_id") * 7919 % 1_000_003
    daily = staff.groupBy("branch_id", "hire_date").agg(
        F.min("place").alias("first"),
        F.max("place").alias("upto"),
        F.count(F.lit(1)).alias("hired"),
        # From these follows a list's hash, wherever in the order its branch begins.
        F.sum((F.col("place") * mixed).cast(_WIDE)).alias("placed"),
        F.sum(mixed.cast(_WIDE)).alias("plain"),
    )
    # The windows run over a branch's calendar days.
    branch = Window.partitionBy("branch_id").orderBy("hire_date")
    upto_now = branch.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select(
        "branch_id",
        F.col("hire_date").alias("sale_day"),
        F.first("first").over(upto_now).alias("first"),
        "upto",
        F.sum("hired").over(upto_now).alias("hired"),
        F.sum("placed").over(upto_now).alias("placed"),
        F.sum("plain").over(upto_now).alias("plain"),
    )


def eligible_lists(t: Tables, staff: DataFrame | None = None) -> DataFrame:
    """Per sale its list of eligible employees, as a stretch of the roster.

    The list is the branch's part of the roster from place ``first_place`` to ``last_place``
    (both 0 if nobody had been hired); ``list_hash`` adds up place in the list times a mix
    of the id. No pair of sale and employee is formed; ``expanded`` gives the ids.
    """
    staff = roster(t) if staff is None else staff
    days, sales = _roster_days(staff), _sale_days(t)
    ends = _as_of(
        days.select("branch_id", "sale_day", "upto"),
        sales.select("branch_id", "sale_day").distinct(),
        "sale_day", "upto", "branch_id",
    )
    listed = ends.join(days.drop("sale_day"), ["branch_id", "upto"], "left")
    hash_ = F.col("placed") - F.col("plain") * (F.col("first") - 1)
    return sales.join(listed, ["branch_id", "sale_day"]).select(
        "sale_id",
        "branch_id",
        F.coalesce("hired", F.lit(0)).alias("eligible_employees"),
        F.coalesce("first", F.lit(0)).alias("first_place"),
        F.col("upto").alias("last_place"),
        F.coalesce(hash_, F.lit(0)).cast("bigint").alias("list_hash"),
    )


def expanded(lists: DataFrame, staff: DataFrame) -> DataFrame:
    """``sale_id``, ``position`` and ``employee_id`` of the lists of the sales asked for."""
    within = (F.col("place") >= F.col("first_place")) & (F.col("place") <= F.col("last_place"))
    return (
        lists.filter("eligible_employees > 0")
        .join(staff, "branch_id")
        .filter(within)
        .select(
            "sale_id", (F.col("place") - F.col("first_place") + 1).alias("position"), "employee_id"
        )
    )


def earliest_employee(t: Tables) -> DataFrame:
    """The first employee hired in each branch."""
    first = F.min(F.struct("hire_date", "employee_id")).alias("first")
    return t["employees"].groupBy("branch_id").agg(first).select(
        "branch_id", "first.employee_id", "first.hire_date"
    )


def fallback_sale_day(t: Tables) -> DataFrame:
    """Sales made before anyone was hired move to the first hire's day."""
    return (
        _sale_days(t)
        .join(earliest_employee(t), "branch_id")
        .filter(F.col("sale_day") < F.col("hire_date"))
        .select("sale_id", "branch_id", "employee_id", "sale_day",
                F.col("hire_date").alias("moved_to"))
    )


def eligible_customers(t: Tables) -> DataFrame:
    """Per sale, the number of customers registered on or before its day."""
    registered = t["customers"].select(F.col("registration_date").alias("sale_day"))
    sales = _sale_days(t).drop("branch_id")
    counts = _as_of(
        _running_days(registered, "sale_day", "eligible_customers"),
        sales.select("sale_day").distinct(), "sale_day", "eligible_customers",
    )
    return sales.join(counts, "sale_day").select("sale_id", "eligible_customers")
