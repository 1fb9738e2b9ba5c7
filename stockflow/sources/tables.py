"""Table sources: declared-schema loads, the seed fixture, ad-hoc SQL (SRC1, SRC3, SRC4)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.schemas import SCHEMAS


def load_table(spark: SparkSession, source: str, name: str, fmt: str = "parquet",
               options: dict | None = None, columns: list[str] | None = None,
               where: str | Column | None = None, args: dict | None = None) -> DataFrame:
    """SRC1: read one inventory table with its declared schema.

    ``fmt`` is any Spark source (parquet, orc, csv, json, jdbc). ``columns``
    and ``where`` (a predicate) reach the scan. Values typed by users go in
    ``args``, by the names of the ``:name`` markers in ``where``; they are
    bound as literals, so nothing in them is read as SQL. For JDBC, ``options`` should
    carry ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions``
    so the read is split across executors; its columns are cast to the
    declared types, and a declared column that is missing is an error.
    """
    schema = SCHEMAS[name]
    if fmt == "jdbc":
        opts = {"url": source, "dbtable": name, **(options or {})}
        raw = spark.read.format("jdbc").options(**opts).load()
        df = raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    else:
        reader = spark.read.schema(schema).options(**(options or {}))
        whole = fmt == "parquet" and source.endswith(".parquet")
        df = reader.format(fmt).load(source if whole else f"{source.rstrip('/')}/{name}")
    if args:
        df = sql_view(spark, {}, "SELECT * FROM {_source} WHERE " + where.replace("{", "{{").replace("}", "}}"), args, _source=df)
    elif where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def sql_view(spark: SparkSession, tables: dict[str, DataFrame], query: str, args: dict | list | None = None,
             **frames: DataFrame) -> DataFrame:
    """SRC4: run a read-only SELECT over the given tables as temp views.

    ``args`` binds parameter markers (``:name`` from a dict, ``?`` from a list)
    to literals: a value is never parsed as SQL, and Catalyst pushes the
    filter to the scan as it would a constant. ``frames`` are DataFrames
    named in braces in the query, without a view."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query, args=args, **frames) if args or frames else spark.sql(query)


# The reference's seed rows (four per table), ids 1-4 in insert
# order. Columns the seed leaves to defaults: supplier.contact (added later,
# null until backfilled), employee.monthly_salary (added later, 0.00),
# timestamps (fixed here instead of "now"), transaction_log.ref_id (null).
_TS = dt.datetime(2025, 10, 1, 9, 0, 0)
_Z = Decimal("0.00")
SEED_ROWS: dict[str, list[tuple]] = {
    "warehouse": [
        (1, "Central Warehouse", "123 Main St", "Bengaluru", "KA", "560001", 100000, None),
        (2, "North Warehouse", "12 Industrial Rd", "Delhi", "DL", "110001", 80000, None),
        (3, "South Warehouse", "88 Ring Rd", "Chennai", "TN", "600001", 70000, None),
        (4, "East Warehouse", "45 MG Rd", "Kolkata", "WB", "700001", 60000, None),
    ],
    "employee": [
        (1, "Rahul Mehta", "manager", "rahul@warehouse.com", 1, _Z),
        (2, "Ananya Sharma", "staff", "ananya@warehouse.com", 1, _Z),
        (3, "Vikram Rao", "picker", "vikram@warehouse.com", 2, _Z),
        (4, "Priya Iyer", "staff", "priya@warehouse.com", 3, _Z),
    ],
    "item": [
        (1, "Widget A", "Widgets", "pcs", Decimal("50.00"), 20),
        (2, "Widget B", "Widgets", "pcs", Decimal("75.00"), 30),
        (3, "Gear Box", "Mechanical", "pcs", Decimal("120.00"), 15),
        (4, "Bearing Set", "Mechanical", "pcs", Decimal("40.00"), 25),
    ],
    "customer": [
        (1, "Contoso Pvt Ltd", "sales@contoso.com", "9998887771", "Plot 12, Peenya, Bengaluru"),
        (2, "TechNova Inc", "orders@technova.com", "8887776662", "Sector 18, Gurugram"),
        (3, "Innova Parts", "info@innova.com", "7776665553", "Maraimalai Nagar, Chennai"),
        (4, "SmartSupply LLP", "hello@smartsupply.com", "6665554444", "Salt Lake, Kolkata"),
    ],
    "supplier": [
        (1, "Acme Supplies", None, "contact@acme.com", "9123456789", "No. 1 Industrial Estate, Bengaluru"),
        (2, "GearMax Corp", None, "info@gearmax.com", "9876543210", "Sector 5, Gurugram"),
        (3, "SteelTech Ltd", None, "sales@steeltech.com", "8765432109", "Tambaram, Chennai"),
        (4, "BearingWorks", None, "support@bearingworks.com", "7654321098", "Howrah, Kolkata"),
    ],
    "stock": [
        (1, 1, 1, 100, _TS), (2, 1, 2, 50, _TS), (3, 2, 3, 80, _TS), (4, 3, 4, 40, _TS),
    ],
    "transaction_log": [
        (1, 1, 1, "IN", 100, "PO", None, 1, _TS), (2, 1, 2, "IN", 50, "PO", None, 1, _TS),
        (3, 2, 3, "IN", 80, "PO", None, 3, _TS), (4, 3, 4, "IN", 40, "PO", None, 4, _TS),
    ],
    "reorder_alerts": [
        (1, 1, 1, 15, 20, 100, _TS, "OPEN"), (2, 1, 2, 25, 30, 80, _TS, "OPEN"),
        (3, 2, 3, 10, 15, 60, _TS, "ACK"), (4, 3, 4, 5, 25, 100, _TS, "OPEN"),
    ],
    "purchase_order": [
        (1, 1, 1, dt.date(2025, 10, 1), "RECEIVED", Decimal("5000.00")),
        (2, 2, 2, dt.date(2025, 10, 2), "CREATED", Decimal("7000.00")),
        (3, 3, 3, dt.date(2025, 10, 3), "APPROVED", Decimal("8500.00")),
        (4, 4, 4, dt.date(2025, 10, 4), "CREATED", Decimal("6000.00")),
    ],
    "purchase_order_details": [
        (1, 1, 1, 100, Decimal("50.00")), (2, 1, 2, 50, Decimal("75.00")),
        (3, 2, 3, 80, Decimal("120.00")), (4, 3, 4, 40, Decimal("40.00")),
    ],
    "sales_order": [
        (1, 1, 1, dt.date(2025, 10, 5), "SHIPPED", Decimal("4800.00")),
        (2, 2, 2, dt.date(2025, 10, 6), "CONFIRMED", Decimal("6500.00")),
        (3, 3, 3, dt.date(2025, 10, 7), "NEW", Decimal("3000.00")),
        (4, 4, 4, dt.date(2025, 10, 8), "CANCELLED", Decimal("1200.00")),
    ],
    "sales_order_details": [
        (1, 1, 1, 80, Decimal("60.00")), (2, 1, 2, 20, Decimal("80.00")),
        (3, 2, 3, 40, Decimal("130.00")), (4, 3, 4, 20, Decimal("50.00")),
    ],
}


def seed_tables(spark: SparkSession, with_trigger_totals: bool = True) -> dict[str, DataFrame]:
    """SRC3: the seed fixture as DataFrames with the declared schemas.

    With ``with_trigger_totals`` the header totals are those left by the
    detail triggers (lines present -> their sum; no lines -> typed value).
    """
    tables = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in SEED_ROWS.items()}
    if with_trigger_totals:
        from stockflow.operators.totals import refresh_totals
        for h, d, k in (("purchase_order", "purchase_order_details", "po_id"),
                        ("sales_order", "sales_order_details", "so_id")):
            tables[h] = refresh_totals(tables[h], tables[d], k, tables[d].select(k))
    return tables
