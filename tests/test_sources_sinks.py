"""Sources and sinks on the seed fixture: declared-schema load, snapshot,
dense ids, appends with defaults, keyed updates, ensure/upsert stock."""

import os
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from stockflow.operators import orders
from stockflow.schemas import SCHEMAS
from stockflow.sources import sinks
from stockflow.sources.tables import load_table


def test_snapshot_and_load_table(spark, seed):
    base = tempfile.mkdtemp(prefix="stockflow-snap-")
    sinks.snapshot(seed["item"], os.path.join(base, "item"))
    df = load_table(spark, base, "item")
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in SCHEMAS["item"]]
    some = load_table(spark, base, "item", columns=["name"], where="item_id > 2")
    assert some.columns == ["name"] and some.count() == 2
    assert sorted(r.item_id for r in df.collect()) == [1, 2, 3, 4]


def test_dense_ids_are_consecutive_in_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"))
    out = sinks.dense_ids(df, ["k"], "new_id", base=100, num_partitions=7)
    got = sorted((r.k, r.new_id) for r in out.collect())
    assert [i for _, i in got] == list(range(101, 5101))


def test_append_rows_fills_defaults(spark, seed):
    staged = spark.createDataFrame([(10, "Pulley", None, Decimal("9.50"), 5)],
                                   "staged_id long, name string, category string, price decimal(12,2), reorder_level long")
    out = sinks.append_rows(seed["item"], staged, "item_id", ["staged_id"], {"unit_of_measure": "pcs"})
    new = out.where("item_id = 5").collect()
    assert len(new) == 1 and new[0].unit_of_measure == "pcs" and new[0].name == "Pulley"


def test_add_master_rejects_duplicates_collated(spark, seed):
    staged = spark.createDataFrame([(1, "widget a"), (2, "Spring"), (3, "SPRING"), (4, "  ")],
                                   "staged_id long, name string")
    r = orders.add_master(seed["item"], staged, "item_id", "staged_id", ["name"], "name")
    assert sorted((x.staged_id, x.reason) for x in r["rejected"].collect()) == [
        (1, "DUPLICATE_NAME"), (3, "DUPLICATE_IN_BATCH"), (4, "BLANK_NAME")]


def test_update_line_qty_rejects_zero(spark, seed):
    ch = spark.createDataFrame([(2, 3, 0), (3, 4, 10)], "po_id long, item_id long, quantity long")
    r = orders.update_line_qty(seed["purchase_order_details"], ch, "po_id", seed["purchase_order"])
    assert [x.po_id for x in r["rejected"].collect()] == [2]
    tot = {x.po_id: x.total_amount for x in r["header"].collect()}
    assert tot[3] == Decimal("400.00") and tot[2] == Decimal("9600.00")


def test_ensure_and_upsert_stock(spark, seed):
    keys = spark.createDataFrame([(4, 1), (1, 1)], "warehouse_id long, item_id long")
    st = sinks.ensure_stock_rows(seed["stock"], keys)
    assert {(r.warehouse_id, r.item_id): r.quantity for r in st.collect()}[(4, 1)] == 0
    deltas = spark.createDataFrame([(1, 1, -30), (1, 1, 5), (4, 2, 7)], "warehouse_id long, item_id long, delta long")
    up = {(r.warehouse_id, r.item_id): r.quantity for r in sinks.upsert_stock(seed["stock"], deltas).collect()}
    assert up[(1, 1)] == 75 and up[(4, 2)] == 7 and up[(1, 2)] == 50


def test_ship_without_check_rejects_missing_rows(spark, seed):
    # SO 2 needs item 3 in warehouse 2 (row exists); add an order touching a key with no row.
    so = seed["sales_order"].unionByName(spark.createDataFrame(
        [(5, 1, 4, __import__("datetime").date(2025, 10, 9), "NEW", Decimal("0.00"))], SCHEMAS["sales_order"]))
    sod = seed["sales_order_details"].unionByName(spark.createDataFrame(
        [(5, 5, 1, 1, Decimal("1.00"))], SCHEMAS["sales_order_details"]))
    r = orders.ship_sos(so, sod, seed["stock"], check_stock=False)
    dec = {x.so_id: (x.shipped, x.reason) for x in r["decisions"].collect()}
    assert dec[5] == (False, "NO_STOCK_ROW") and dec[2] == (True, None) and dec[3] == (True, None)


def test_adjust_rejects_negative(spark, seed):
    import datetime as dt
    adj = spark.createDataFrame(
        [(1, 3, 4, -50, 1, "count", dt.datetime(2025, 10, 9)), (2, 3, 4, -15, 1, "count", dt.datetime(2025, 10, 10))],
        "adj_id long, warehouse_id long, item_id long, delta long, emp_id long, reason string, adjusted_at timestamp")
    r = orders.adjust_stock(seed["stock"], adj)
    assert [x.log_id for x in r["rejected"].collect()] == [1]
    assert {(x.warehouse_id, x.item_id): x.quantity for x in r["stock"].collect()}[(3, 4)] == 25
