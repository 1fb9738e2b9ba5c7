"""Intake, update and audit rules on rows that break them."""

from decimal import Decimal

from pyspark.sql import functions as F

from stockflow.functions.scalars import non_blank, valid_gmail
from stockflow.operators import orders, quality
from stockflow.sources import sinks


def test_white_space_is_blank(spark):
    df = spark.createDataFrame([("\t\n ",), ("a",), (" ",), (None,), ("\tx@gmail.com\n",)], "s string")
    assert [r[0] for r in df.select(non_blank("s")).collect()] == [False, True, False, False, True]
    assert [r[0] for r in df.select(valid_gmail("s")).collect()] == [False] * 4 + [True]


def test_accents_and_case_collide(spark):
    df = spark.createDataFrame([("José",), ("jose",), ("Jose",), ("Ana",), (None,), (None,)], "name string")
    assert [(r.name, r.n_rows) for r in quality.unique_violations(df, ["name"], ("name",)).collect()] == [("jose", 3)]


def test_unique_keys_admit_nulls(spark, seed):
    staged = spark.createDataFrame([(1, "A", None), (2, "B", None), (3, "C", "c@x.org"), (4, "D", "C@X.org")],
                                   "staged_id long, name string, email string")
    r = orders.add_master(seed["customer"], staged, "customer_id", "staged_id", ["name"], "email")
    assert [(x.staged_id, x.reason) for x in r["rejected"].collect()] == [(4, "DUPLICATE_IN_BATCH")]
    assert r["table"].count() == seed["customer"].count() + 3


def test_bad_lines_are_rejected_once_each(spark, seed):
    rows = [(1, 1, 2, 5, None), (2, 999, 1, 5, None), (3, 1, 77, 5, None), (4, 1, 3, None, None), (5, 1, 3, 0, None),
            (6, 1, 3, 2, Decimal("-4.00")), (7, 1, 4, 2, Decimal("3.00")), (8, 1, 4, 9, None)]
    staged = spark.createDataFrame(rows, "staged_id long, so_id long, item_id long, quantity long, price decimal(12,2)")
    detail = seed["sales_order_details"].where("so_id <> 1")
    r = orders.add_lines(detail, staged, seed["item"], "so_id", "so_detail_id", "staged_id", True, seed["sales_order"])
    assert {x.staged_id: x.reason for x in r["rejected"].collect()} == {
        2: "UNKNOWN_ORDER", 3: "UNKNOWN_ITEM", 4: "BAD_QUANTITY", 5: "BAD_QUANTITY", 6: "BAD_PRICE", 8: "DUPLICATE_LINE"}
    assert sorted(x.staged_id for x in r["accepted"].collect()) == [1, 7]
    total = {x.so_id: x.total_amount for x in r["header"].collect()}[1]
    assert total == Decimal("381.00")  # 5 x 75.00 (list price) + 2 x 3.00


def test_every_quantity_change_comes_out(spark, seed):
    ch = spark.createDataFrame([(2, 3, None), (99, 1, 4), (3, 4, 10), (3, 4, 12)], "po_id long, item_id long, quantity long")
    before = seed["purchase_order_details"]
    r = orders.update_line_qty(before, ch, "po_id")
    assert {(x.po_id, x.reason) for x in r["rejected"].collect()} == {(2, "BAD_QUANTITY"), (99, "UNKNOWN_LINE")}
    after = r["detail"].collect()
    assert len(after) == before.count() and [x.quantity for x in after if (x.po_id, x.item_id) == (3, 4)] == [12]


def test_keyed_update_never_adds_rows(spark, seed):
    ch = spark.createDataFrame([(1, Decimal("1.00"), 1), (1, Decimal("9.00"), 0), (50, Decimal("2.00"), 5)],
                               "item_id long, price decimal(12,2), t long")
    out = sinks.update_by_key(seed["item"], ch, ["item_id"], ["price"], ["t"])
    assert out.count() == seed["item"].count() and out.where("item_id = 1").first().price == Decimal("1.00")


def test_new_employees_get_declared_defaults(spark, seed):
    staged = spark.createDataFrame([(1, "New Person", "\tnew@gmail.com ", "Picker", 1)],
                                   "staged_id long, name string, contact string, role_label string, warehouse_id long")
    row = orders.add_employees(seed["employee"], staged, seed["warehouse"])["table"].where("name = 'New Person'").first()
    assert row.monthly_salary == 0 and row.role == "picker" and row.contact == "new@gmail.com"


def test_audits_find_planted_faults(spark, seed):
    t = dict(seed)
    t["item"] = t["item"].unionByName(t["item"].limit(1).withColumn("item_id", F.lit(90).cast("long"))
                                      .withColumn("name", F.lit("WIDGET a")).withColumn("reorder_level", F.lit(-1).cast("long")))
    t["employee"] = t["employee"].withColumn("role", F.when(F.col("emp_id") == 2, "pilot").otherwise(F.col("role")))
    t["stock"] = t["stock"].withColumn("item_id", F.when(F.col("stock_id") == 1, 5000).otherwise(F.col("item_id")).cast("long"))
    got = {(r.tbl, r.kind, r.rule): r.n_rows for r in quality.row_audit(t).collect()}
    assert got[("item", "check", "ck_reorder_unsigned")] == 1 and got[("employee", "domain", "role")] == 1
    assert [(r.tbl, r.rule) for r in quality.unique_audit(t).collect()] == [("item", "name")]
    assert ("stock", "item_id", 5000, 1) in {tuple(r) for r in quality.fk_audit(t).collect()}


def test_no_job_runs_for_tables_nobody_asks_for(spark, seed):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "receive")
    r = orders.receive_pos(seed["purchase_order"], seed["purchase_order_details"], seed["stock"],
                           seed["purchase_order"].select("po_id"))
    r["rejected"]
    assert not tracker.getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert r["stock"].count() >= seed["stock"].count()


def test_a_warehouse_delete_cascades(spark, seed):
    """Warehouse 4 has no orders: its stock, log and alerts go and its staff lose it; the others are refused."""
    t = dict(seed)
    t["purchase_order"] = t["purchase_order"].where("warehouse_id <> 4")
    t["sales_order"] = t["sales_order"].where("warehouse_id <> 4")
    t["stock"] = t["stock"].unionByName(spark.createDataFrame([(900, 4, 1, 7, None)], t["stock"].schema))
    t["employee"] = t["employee"].withColumn("warehouse_id", F.when(F.col("emp_id") == 4, 4).otherwise(F.col("warehouse_id")).cast("long"))
    used = {r.warehouse_id for n in ("purchase_order", "sales_order") for r in t[n].collect()}
    r = quality.delete_by_declared_rules(t, "warehouse", t["warehouse"].select("warehouse_id"))
    gone = {x.warehouse_id for x in r["deleted"].collect()}
    assert 4 in gone and gone == {1, 2, 3, 4} - used
    assert {x.warehouse_id for x in r["refused"].collect()} == used
    for n in ("stock", "transaction_log", "reorder_alerts"):
        assert sorted(map(str, r[n].select(t[n].columns).collect())) == sorted(
            map(str, (x for x in t[n].collect() if x.warehouse_id not in gone)))
    assert {x.emp_id: x.warehouse_id for x in r["employee"].collect()} == {
        x.emp_id: None if x.warehouse_id in gone else x.warehouse_id for x in t["employee"].collect()}
    items = quality.delete_by_declared_rules(t, "item", t["item"].select("item_id"))
    assert items["deleted"].count() == 0


def test_cancelled_order_delete_takes_its_lines(spark, seed):
    r = quality.delete_by_declared_rules(dict(seed), "sales_order", spark.createDataFrame([(1,), (77,)], "so_id long"))
    assert [x.so_id for x in r["deleted"].collect()] == [1] and r["refused"].count() == 0
    assert r["sales_order_details"].where("so_id = 1").count() == 0
    assert r["sales_order_details"].count() == seed["sales_order_details"].where("so_id <> 1").count()
