"""What must not grow: the width of the key audit's groups, scans and shuffles of the alert queries, Python workers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stockflow.operators import alerts, ledger, orders, quality
from stockflow.plans import scan
from stockflow.sources import testdata
from stockflow.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---------------------------------------------------------------- F1
def _audited(spark):
    one = lambda rows, cols: spark.createDataFrame(rows, cols)
    return {"warehouse": one([(1,), (2,), (None,)], "warehouse_id long"),
            "item": one([(10,), (10,), (11,)], "item_id long"),
            "stock": one([(1, 10), (3, 10), (3, 12), (None, 12), (2, None)], "warehouse_id long, item_id long"),
            "transaction_log": one([(3, 12, 7), (1, 11, None)], "warehouse_id long, item_id long, emp_id long"),
            "employee": one([(8, 3)], "emp_id long, warehouse_id long")}


def test_fk_audit_finds_every_link_of_a_shared_parent(spark):
    assert _rows(quality.fk_audit(_audited(spark))) == sorted([
        ("employee", "warehouse_id", 3, 1), ("stock", "warehouse_id", 3, 2), ("stock", "item_id", 12, 2),
        ("transaction_log", "warehouse_id", 3, 1), ("transaction_log", "item_id", 12, 1), ("transaction_log", "emp_id", 7, 1)], key=str)


def test_fk_audit_keeps_two_values_for_a_group(spark):
    plan = quality.fk_audit(_audited(spark))._jdf.queryExecution().optimizedPlan()
    node = next(plan.apply(i) for i in range(50) if plan.apply(i).nodeName() == "Aggregate")
    assert node.aggregateExpressions().size() <= 4  # link, value, flag, count: no column a link


# ---------------------------------------------------------------- F2
def test_levels_of_a_repeated_item_leave_one_row_a_line(spark):
    lines = spark.createDataFrame([(1, 1, 10, 5, "IN", T0), (2, 1, 10, 2, "IN", T0), (3, 1, 12, 4, "IN", T0)],
                                  "src_id long, warehouse_id long, item_id long, delta_qty long, change_type string, logged_at timestamp")
    item = spark.createDataFrame([(10, 6), (10, 6), (10, 3), (None, 1)], "item_id long, reorder_level long")
    stock = spark.createDataFrame([(1, 10, 1)], "warehouse_id long, item_id long, quantity long")
    order = ["logged_at", "src_id"]
    before = alerts.observations(ledger.line_effects(lines, stock, order), item, 100)
    now = alerts.observations(ledger.line_effects(alerts.with_all_levels(lines, item), stock, order), id_offset=100)
    assert _rows(now) == _rows(before.select(*now.columns)) and now.count() == 6


def test_receiving_deals_lines_once_and_looks_up_lines_once(spark, monkeypatch):
    dealt = []
    cut = scan.cut_lineage
    for module in (scan, alerts):
        monkeypatch.setattr(module, "cut_lineage", lambda df: dealt.append(df) or cut(df))
    po = spark.createDataFrame([(1, 1, "APPROVED", None), (2, 1, "CANCELLED", None), (3, 1, "CREATED", None)],
                               "po_id long, warehouse_id long, status string, total_amount decimal(12,2)")
    pod = spark.createDataFrame([(11, 1, 10, 2, None), (12, 1, 11, 9, None), (13, 2, 10, 50, None)],
                                "po_detail_id long, po_id long, item_id long, quantity long, price decimal(12,2)")
    item = spark.createDataFrame([(10, 6), (11, 6)], "item_id long, reorder_level long")
    stock = spark.createDataFrame([(1, 10, 1)], "warehouse_id long, item_id long, quantity long")
    held = spark.createDataFrame([(5, 1, 11, 0, 6, None, T0, "OPEN")], "alert_id long, warehouse_id long, item_id long, "
                                 "current_quantity long, reorder_level long, expected_quantity long, alert_date timestamp, status string")
    r = orders.receive_pos(po, pod, stock, po.select("po_id"), as_of="2026-01-01 00:00:00", item=item)
    out = alerts.maintain_alerts(held, alerts.observations(r["applied"], id_offset=1000), in_order=True)
    got = sorted((x.alert_id, x.item_id, x.current_quantity, x.status) for x in out.collect())
    assert got == [(5, 11, 9, "RESOLVED"), (1011, 10, 3, "OPEN")] and len(dealt) == 1
    assert sorted((x.po_id, x.reason) for x in r["rejected"].collect()) == [(2, "BAD_STATUS:CANCELLED"), (3, "NO_LINES")]


def test_existing_alerts_scan_the_ledger_once(spark, tmp_path):
    events = [(i, T0, i % 7, "view", 3.0, f'{{"k": {i % 9}}}') for i in range(80)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, "n", "t", 5, 1.0) for i in range(9)], "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    a = testdata.TestTables(spark, str(tmp_path)).reorder_alerts
    assert a._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2  # events and part
    kinds = {}
    for x in a.collect():
        assert x.alert_id == (x.warehouse_id * 1000 + x.item_id) * 4 + {"OPEN": 1, "ACK": 2, "RESOLVED": 3}[x.status]
        kinds.setdefault((x.warehouse_id, x.item_id), set()).add(x.status)
    for (w, i), found in kinds.items():
        assert found == [{"OPEN", "RESOLVED"} if w % 2 == 0 else None, {"OPEN"}, {"ACK"}, {"OPEN", "ACK"}][i % 4]


# ---------------------------------------------------------------- F3
def test_stock_and_its_marks_come_from_one_join(spark):
    stock = spark.createDataFrame([(1, 10, 5, T0), (1, 11, 6, None), (2, 10, 7, T0)],
                                  "warehouse_id long, item_id long, quantity long, last_logged_at timestamp")
    late = T0 + dt.timedelta(days=1)
    applied = spark.createDataFrame([(1, 10, 4, T0, 1, True), (1, 10, 3, late, 2, True), (1, 12, 0, late, 3, False)],
                                    "warehouse_id long, item_id long, balance long, logged_at timestamp, log_id long, accepted boolean")
    out = ledger.stock_after(stock, applied, "last_logged_at")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert _rows(out.select("warehouse_id", "item_id", "quantity", "last_logged_at")) == sorted(
        [(1, 10, 3, late), (1, 11, 6, None), (1, 12, 0, late), (2, 10, 7, T0)], key=str)


def test_staged_steps_are_later_ranges_and_are_read_back_alone(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("k"), (F.lit(400) - F.col("id")).alias("t"))
    files = streams.stage_files(df, f"{tmp_path}/src", 4, ["t"], rows_per_file=60)
    assert files == 2
    assert _rows(spark.read.parquet(f"{tmp_path}/src")) == _rows(df)
    steps = spark.read.parquet(f"{tmp_path}/src-steps").groupBy("_step").agg(F.min("t"), F.max("t")).orderBy("_step").collect()
    assert len(steps) == 4 and all(a[2] < b[1] for a, b in zip(steps, steps[1:]))


# ---------------------------------------------------------------- F4
def test_small_tables_need_no_python_workers(spark):
    shape = StructType([StructField("a", LongType()), StructField("b", StringType())])
    t = scan._small_table(spark, [(1, "x"), (None, None), (1 << 60, "y")], shape)
    assert "LocalRelation" in t._jdf.queryExecution().optimizedPlan().toString()
    assert t.schema == shape and [tuple(r) for r in t.collect()] == [(1, "x"), (None, None), (1 << 60, "y")]
