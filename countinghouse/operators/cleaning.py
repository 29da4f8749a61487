"""Raw to cleaned projections. No row is dropped here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countinghouse.functions.text import blank_to_null, tidy_name, tidy_optional_name
from countinghouse.schemas import TABLES


def _upper(text: Column) -> Column:
    return F.upper(F.trim(text))


# Which column gets which treatment; all others pass through.
RULES: dict[str, dict[str, Callable[[Column], Column]]] = {
    "branches": {"branch_name": tidy_name, "city": tidy_name},
    "customers": {
        "customer_name": tidy_name,
        "phone": blank_to_null,
        "city": tidy_optional_name,
    },
    "suppliers": {
        "supplier_name": tidy_name,
        "city": tidy_optional_name,
        "phone": blank_to_null,
    },
    "gold_types": {"gold_type_name": _upper},
    "employees": {"employee_name": tidy_name, "job_title": tidy_name},
    "products": {"product_name": F.trim, "category": tidy_name},
    "sales": {"payment_method": tidy_name},
}


def clean(name: str, raw: DataFrame) -> DataFrame:
    rules = RULES.get(name, {})
    return raw.select(
        *(
            rules[c](F.col(c)).alias(c) if c in rules else F.col(c)
            for c in TABLES[name].columns
            if c in raw.columns
        )
    )


def clean_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: clean(name, df) for name, df in raw.items()}
