"""Declared schemas, value domains and key rules of the inventory tables (SRC2).

Money is exact: prices and salaries are decimal(12,2), header totals
decimal(14,2), computed order totals decimal(18,2). Quantities and ids are
longs (the source declares unsigned ints; long avoids ANSI overflow in sums).
"""

from __future__ import annotations

from pyspark.sql.types import (DateType, DecimalType, IntegerType, LongType,
                               StringType, StructField, StructType, TimestampType)

MONEY = DecimalType(12, 2)
HEADER_TOTAL = DecimalType(14, 2)
ORDER_TOTAL = DecimalType(18, 2)


def _s(*fields):
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


L, I, S, D, TS = LongType(), IntegerType(), StringType(), DateType(), TimestampType()

SCHEMAS: dict[str, StructType] = {
    "warehouse": _s(("warehouse_id", L, False), ("name", S, False), ("address", S, True),
                    ("city", S, True), ("state", S, True), ("zip", S, True),
                    ("capacity", L, True), ("manager_id", L, True)),
    "employee": _s(("emp_id", L, False), ("name", S, False), ("role", S, False),
                   ("contact", S, True), ("warehouse_id", L, True),
                   ("monthly_salary", MONEY, False)),
    "item": _s(("item_id", L, False), ("name", S, False), ("category", S, True),
               ("unit_of_measure", S, False), ("price", MONEY, False),
               ("reorder_level", L, False)),
    "customer": _s(("customer_id", L, False), ("name", S, False), ("email", S, True),
                   ("phone", S, True), ("address", S, True)),
    "supplier": _s(("supplier_id", L, False), ("name", S, False), ("contact", S, True),
                   ("email", S, True), ("phone", S, True), ("address", S, True)),
    "stock": _s(("stock_id", L, False), ("warehouse_id", L, False), ("item_id", L, False),
                ("quantity", L, False), ("last_updated", TS, True)),
    "transaction_log": _s(("log_id", L, False), ("warehouse_id", L, False), ("item_id", L, False),
                          ("change_type", S, False), ("delta_qty", L, False),
                          ("ref_type", S, False), ("ref_id", L, True), ("emp_id", L, True),
                          ("logged_at", TS, False)),
    "reorder_alerts": _s(("alert_id", L, False), ("warehouse_id", L, False), ("item_id", L, False),
                         ("current_quantity", L, False), ("reorder_level", L, False),
                         ("expected_quantity", L, True), ("alert_date", TS, False),
                         ("status", S, False)),
    "purchase_order": _s(("po_id", L, False), ("supplier_id", L, False), ("warehouse_id", L, False),
                         ("po_date", D, False), ("status", S, False),
                         ("total_amount", HEADER_TOTAL, False)),
    "purchase_order_details": _s(("po_detail_id", L, False), ("po_id", L, False),
                                 ("item_id", L, False), ("quantity", L, False),
                                 ("price", MONEY, False)),
    "sales_order": _s(("so_id", L, False), ("customer_id", L, False), ("warehouse_id", L, False),
                      ("so_date", D, False), ("status", S, False),
                      ("total_amount", HEADER_TOTAL, False)),
    "sales_order_details": _s(("so_detail_id", L, False), ("so_id", L, False),
                              ("item_id", L, False), ("quantity", L, False),
                              ("price", MONEY, False)),
}

# Enumerated domains of the source DDL. The ledger's ref_type
# domain is extended with the two return kinds (decision D-2).
DOMAINS: dict[tuple[str, str], tuple[str, ...]] = {
    ("employee", "role"): ("manager", "staff", "picker", "packer", "driver", "admin"),
    ("transaction_log", "change_type"): ("IN", "OUT", "ADJUST"),
    ("transaction_log", "ref_type"): ("PO", "SO", "MANUAL", "RETURN_CUST", "RETURN_SUPP"),
    ("reorder_alerts", "status"): ("OPEN", "ACK", "RESOLVED"),
    ("purchase_order", "status"): ("CREATED", "APPROVED", "RECEIVED", "CANCELLED"),
    ("sales_order", "status"): ("NEW", "CONFIRMED", "SHIPPED", "CANCELLED"),
}
# The ref_type domain as originally declared, before the return kinds.
LEDGER_REF_TYPES_DECLARED = ("PO", "SO", "MANUAL")

# Declared string lengths.
MAX_LENGTHS: dict[str, dict[str, int]] = {
    "warehouse": {"name": 120, "address": 255, "city": 80, "state": 80, "zip": 20},
    "employee": {"name": 120, "contact": 120},
    "item": {"name": 150, "category": 120, "unit_of_measure": 40},
    "customer": {"name": 150, "email": 150, "phone": 40, "address": 255},
    "supplier": {"name": 150, "contact": 100, "email": 150, "phone": 40, "address": 255},
}

# Unique keys (besides the primary key). Names compare case/accent-insensitively.
UNIQUE_KEYS: dict[str, list[tuple[str, ...]]] = {
    "warehouse": [("warehouse_id",), ("name",)],
    "employee": [("emp_id",)],
    "item": [("item_id",), ("name",)],
    "customer": [("customer_id",), ("email",)],
    "supplier": [("supplier_id",), ("name",)],
    "stock": [("stock_id",), ("warehouse_id", "item_id")],
    "reorder_alerts": [("alert_id",), ("warehouse_id", "item_id", "status")],
    "purchase_order": [("po_id",)],
    "purchase_order_details": [("po_detail_id",), ("po_id", "item_id")],
    "sales_order": [("so_id",)],
    "sales_order_details": [("so_detail_id",), ("so_id", "item_id")],
}
COLLATED_KEYS = {("warehouse", "name"), ("item", "name"), ("supplier", "name"), ("customer", "email")}

# Foreign keys: child table, child columns, parent table, parent columns, delete rule.
FOREIGN_KEYS: list[tuple[str, tuple[str, ...], str, tuple[str, ...], str]] = [
    ("warehouse", ("manager_id",), "employee", ("emp_id",), "SET NULL"),
    ("employee", ("warehouse_id",), "warehouse", ("warehouse_id",), "SET NULL"),
    ("stock", ("warehouse_id",), "warehouse", ("warehouse_id",), "CASCADE"),
    ("stock", ("item_id",), "item", ("item_id",), "RESTRICT"),
    ("transaction_log", ("warehouse_id",), "warehouse", ("warehouse_id",), "CASCADE"),
    ("transaction_log", ("item_id",), "item", ("item_id",), "RESTRICT"),
    ("transaction_log", ("emp_id",), "employee", ("emp_id",), "SET NULL"),
    ("reorder_alerts", ("warehouse_id",), "warehouse", ("warehouse_id",), "CASCADE"),
    ("reorder_alerts", ("item_id",), "item", ("item_id",), "RESTRICT"),
    ("purchase_order", ("supplier_id",), "supplier", ("supplier_id",), "RESTRICT"),
    ("purchase_order", ("warehouse_id",), "warehouse", ("warehouse_id",), "RESTRICT"),
    ("purchase_order_details", ("po_id",), "purchase_order", ("po_id",), "CASCADE"),
    ("purchase_order_details", ("item_id",), "item", ("item_id",), "RESTRICT"),
    ("sales_order", ("customer_id",), "customer", ("customer_id",), "RESTRICT"),
    ("sales_order", ("warehouse_id",), "warehouse", ("warehouse_id",), "RESTRICT"),
    ("sales_order_details", ("so_id",), "sales_order", ("so_id",), "CASCADE"),
    ("sales_order_details", ("item_id",), "item", ("item_id",), "RESTRICT"),
]

# CHECK rules as SQL expressions that must hold.
CHECKS: dict[str, dict[str, str]] = {
    "stock": {"ck_stock_nonneg": "quantity >= 0"},
    "purchase_order_details": {"ck_pod_qty": "quantity > 0", "ck_pod_price": "price >= 0"},
    "sales_order_details": {"ck_sod_qty": "quantity > 0", "ck_sod_price": "price >= 0"},
    "warehouse": {"ck_capacity_unsigned": "capacity IS NULL OR capacity >= 0"},
    "item": {"ck_reorder_unsigned": "reorder_level >= 0"},
}

NOT_NULL: dict[str, tuple[str, ...]] = {
    name: tuple(f.name for f in schema.fields if not f.nullable) for name, schema in SCHEMAS.items()
}

# Defaults used when rows are appended without a value.
DEFAULTS: dict[str, dict[str, object]] = {
    "employee": {"role": "staff", "monthly_salary": 0},
    "item": {"unit_of_measure": "pcs", "price": 0, "reorder_level": 0},
    "supplier": {"contact": ""},
    "purchase_order": {"status": "CREATED", "total_amount": 0},
    "sales_order": {"status": "NEW", "total_amount": 0},
    "reorder_alerts": {"status": "OPEN"},
    "transaction_log": {"ref_type": "MANUAL"},
}
