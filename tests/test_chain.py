"""Workflows chained on the seed: one ledger, one stock shape, alerts that follow."""

import datetime as dt

from pyspark.sql import functions as F

from stockflow.operators import alerts, ledger, orders
from stockflow.schemas import SCHEMAS

AS_OF = "2026-01-01 00:00:00"


def names(df):
    return df.columns


def test_receive_adjust_return_ship_leaves_no_drift(spark, seed):
    stock, log, item = seed["stock"], seed["transaction_log"], seed["item"]
    drift0 = {(r.warehouse_id, r.item_id): r.drift for r in ledger.ledger_drift(stock, log).collect()}
    r = orders.receive_pos(seed["purchase_order"], seed["purchase_order_details"], stock,
                           seed["purchase_order"].select("po_id"), as_of=AS_OF, ledger_log=log)
    stock, log = r["stock"].cache(), r["ledger"].cache()
    adj = spark.createDataFrame([(1, 1, 1, -3, 1, "count", dt.datetime(2026, 1, 2)), (2, 1, 1, -10 ** 6, 1, "typo", dt.datetime(2026, 1, 3))],
                                "adj_id long, warehouse_id long, item_id long, delta long, emp_id long, reason string, adjusted_at timestamp")
    r = orders.adjust_stock(stock, adj, AS_OF, log)
    assert r["rejected"].count() == 1
    stock, log = r["stock_table"].cache(), r["ledger"].cache()
    ret = spark.createDataFrame([(1, 4, 2, "CUSTOMER", 5, dt.datetime(2026, 1, 4)), (2, 1, 1, "SUPPLIER", 2, dt.datetime(2026, 1, 5))],
                                "return_id long, warehouse_id long, item_id long, kind string, quantity long, returned_at timestamp")
    r = orders.process_returns(stock, ret, 1, AS_OF, log)
    stock, log = r["stock_table"].cache(), r["ledger"].cache()
    r = orders.ship_sos(seed["sales_order"], seed["sales_order_details"], stock, as_of=AS_OF, ledger_log=log)
    stock, log = r["stock"], r["ledger"].cache()
    assert names(log) == SCHEMAS["transaction_log"].fieldNames() and names(stock) == SCHEMAS["stock"].fieldNames()
    assert log.select("log_id").distinct().count() == log.count()
    assert {(x.warehouse_id, x.item_id): x.drift for x in ledger.ledger_drift(stock, log).collect()} == drift0
    assert stock.where("stock_id is null or last_updated is null").count() == 0


def test_receiving_drives_the_alerts(spark, seed):
    """Each received line is an observation; low stock opens an alert and the line that lifts it resolves it."""
    item = spark.createDataFrame([(1, 20), (2, 30)], "item_id long, reorder_level long")
    stock = spark.createDataFrame([(1, 1, 1, 5, None)], SCHEMAS["stock"])
    po = spark.createDataFrame([(k, 1, 1, dt.date(2025, 1, k), "APPROVED", 0) for k in (1, 2, 3)],
                               "po_id long, supplier_id long, warehouse_id long, po_date date, status string, total_amount int")
    lines = spark.createDataFrame([(10, 1, 1, 4, 1), (11, 1, 2, 10, 1), (20, 2, 1, 30, 1), (30, 3, 2, 5, 1)],
                                  "po_detail_id long, po_id long, item_id long, quantity long, price int")
    r = orders.receive_pos(po, lines, stock, po.select("po_id"), as_of=AS_OF)
    seen = alerts.observations(r["applied"], item)
    assert sorted((x.item_id, x.quantity) for x in seen.collect()) == [(1, 9), (1, 39), (2, 10), (2, 15)]
    none = spark.createDataFrame([], SCHEMAS["reorder_alerts"])
    got = sorted((x.item_id, x.status, x.current_quantity, x.alert_id) for x in alerts.maintain_alerts(none, seen).collect())
    assert got == [(1, "RESOLVED", 39, 10), (2, "OPEN", 10, 11)]
    assert seen.where(F.col("item_id") == 2).count() == 2  # the first row of a key that had no stock counts too
