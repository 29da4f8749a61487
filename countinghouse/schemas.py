"""The ten tables: types, keys and rules.

Ids are 64-bit so that they hold at any scale. Spark does not enforce keys or
checks on files, so the rules below feed the validation operators.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    columns: dict[str, str]
    key: tuple[str, ...]
    optional: frozenset[str] = frozenset()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    parents: dict[str, str] = field(default_factory=dict)
    text_limits: dict[str, int] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)

    @property
    def required(self) -> list[str]:
        return [c for c in self.columns if c not in self.optional]

    @property
    def schema(self) -> T.StructType:
        ddl = ", ".join(f"{name} {kind}" for name, kind in self.columns.items())
        return T.StructType.fromDDL(ddl)


# Table layout, limits and rules of the retail model, parents first.
TABLES: dict[str, Table] = {
    "branches": Table(
        columns={
            "branch_id": "bigint",
            "branch_name": "string",
            "city": "string",
            "opening_date": "date",
        },
        key=("branch_id",),
        optional=frozenset({"opening_date"}),
        unique=(("branch_name",),),
        text_limits={"branch_name": 100, "city": 50},
    ),
    "customers": Table(
        columns={
            "customer_id": "bigint",
            "customer_name": "string",
            "phone": "string",
            "city": "string",
            "registration_date": "date",
        },
        key=("customer_id",),
        optional=frozenset({"phone", "city"}),
        text_limits={"customer_name": 100, "phone": 30, "city": 50},
    ),
    "suppliers": Table(
        columns={
            "supplier_id": "bigint",
            "supplier_name": "string",
            "city": "string",
            "phone": "string",
        },
        key=("supplier_id",),
        optional=frozenset({"city", "phone"}),
        text_limits={"supplier_name": 100, "city": 50, "phone": 30},
    ),
    "gold_types": Table(
        columns={"gold_type_id": "bigint", "gold_type_name": "string"},
        key=("gold_type_id",),
        unique=(("gold_type_name",),),
        text_limits={"gold_type_name": 30},
    ),
    "employees": Table(
        columns={
            "employee_id": "bigint",
            "employee_name": "string",
            "branch_id": "bigint",
            "job_title": "string",
            "hire_date": "date",
            "monthly_target": "decimal(12,2)",
        },
        key=("employee_id",),
        checks={"monthly_target": "monthly_target >= 0"},
        parents={"branch_id": "branches"},
        text_limits={"employee_name": 100, "job_title": 50},
    ),
    "products": Table(
        columns={
            "product_id": "bigint",
            "product_name": "string",
            "category": "string",
            "gold_type_id": "bigint",
            "weight_grams": "decimal(10,2)",
            "making_charge": "decimal(12,2)",
            "cost_price": "decimal(14,2)",
            "selling_price": "decimal(14,2)",
            "supplier_id": "bigint",
        },
        key=("product_id",),
        checks={
            "weight_grams": "weight_grams > 0",
            "making_charge": "making_charge >= 0",
            "cost_price": "cost_price > 0",
            "selling_price": "selling_price > 0",
        },
        parents={"gold_type_id": "gold_types", "supplier_id": "suppliers"},
        text_limits={"product_name": 100, "category": 50},
    ),
    "sales": Table(
        columns={
            "sale_id": "bigint",
            "customer_id": "bigint",
            "employee_id": "bigint",
            "branch_id": "bigint",
            "sale_date": "timestamp_ntz",
            "payment_method": "string",
            "discount_amount": "decimal(12,2)",
        },
        key=("sale_id",),
        optional=frozenset({"customer_id"}),
        checks={"discount_amount": "discount_amount >= 0"},
        parents={"customer_id": "customers", "employee_id": "employees", "branch_id": "branches"},
        text_limits={"payment_method": 30},
        defaults={"discount_amount": "0"},
    ),
    "sale_items": Table(
        columns={
            "sale_item_id": "string",
            "sale_id": "bigint",
            "product_id": "bigint",
            "quantity": "int",
            "unit_price": "decimal(14,2)",
        },
        key=("sale_item_id",),
        checks={"quantity": "quantity > 0", "unit_price": "unit_price > 0"},
        parents={"sale_id": "sales", "product_id": "products"},
    ),
    "inventory": Table(
        columns={
            "inventory_id": "bigint",
            "branch_id": "bigint",
            "product_id": "bigint",
            "stock_quantity": "int",
            "reorder_level": "int",
            "last_updated": "date",
        },
        key=("inventory_id",),
        unique=(("branch_id", "product_id"),),
        checks={"stock_quantity": "stock_quantity >= 0", "reorder_level": "reorder_level >= 0"},
        parents={"branch_id": "branches", "product_id": "products"},
    ),
    "gold_prices": Table(
        columns={
            "price_date": "date",
            "gold_type_id": "bigint",
            "price_per_gram": "decimal(14,2)",
        },
        key=("price_date", "gold_type_id"),
        checks={"price_per_gram": "price_per_gram > 0"},
        parents={"gold_type_id": "gold_types"},
    ),
}
