"""Parameter markers, correlated subqueries, gates and the key audit: results and plans."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from stockflow.operators import orders, quality, views
from stockflow.sources.tables import load_table, sql_view


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.fixture
def items(spark, tmp_path, seed):
    path = str(tmp_path / "inv")
    seed["item"].write.parquet(f"{path}/item")
    return path


def test_markers_are_pushed_and_never_parsed(spark, items, seed):
    df = load_table(spark, items, "item", where="item_id <= :top AND name <> :other", columns=["item_id"],
                    args={"top": 2, "other": "x' OR '1'='1"})
    assert sorted(r.item_id for r in df.collect()) == [1, 2]
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan(df))[1]
    assert "LessThanOrEqual(item_id,2)" in pushed and "x' OR '1'='1" in pushed
    assert "price" not in re.search(r"ReadSchema: struct<(.*?)>", plan(df))[1]
    got = sql_view(spark, {}, "SELECT name FROM {t} WHERE name = ?", ["x' OR '1'='1"], t=seed["item"])
    assert got.count() == 0


def test_a_brace_in_a_predicate(spark, items):
    assert load_table(spark, items, "item", where="name <> '{x}' AND item_id = :k", args={"k": 1}).count() == 1


def test_correlated_subquery_needs_one_row(spark, seed):
    stock, item, wh = seed["stock"], seed["item"], seed["warehouse"]
    want = sorted(map(tuple, views.low_stock_nested(stock, item, wh).collect()), key=str)
    assert sorted(map(tuple, views.low_stock_correlated(stock, item, wh).collect()), key=str) == want
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        views.low_stock_correlated(stock, item.unionByName(item), wh).collect()
    assert views.low_stock_correlated(stock, item.limit(0), wh).count() == 0  # no level: not low


def test_key_audit_scans_each_table_once(spark, tmp_path, seed):
    tables = {}
    for name, df in seed.items():
        df.write.parquet(str(tmp_path / name))
        tables[name] = spark.read.schema(df.schema).parquet(str(tmp_path / name))
    bad = spark.createDataFrame([(999, 77, 1, 5, dt.datetime(2025, 1, 1)), (998, 77, 88, 5, None)], tables["stock"].schema)
    tables["stock"] = tables["stock"].unionByName(bad)
    audit = quality.fk_audit(tables)
    got = sorted(tuple(r) for r in audit.collect() if r.child == "stock")
    assert got == [("stock", "item_id", 88, 1), ("stock", "warehouse_id", 77, 2)]
    assert scans(audit) == len([n for n in tables if n in tables])
    assert plan(audit).count("Join") == 0


def test_gate_shuffles_requested_orders_only(spark, seed):
    req = spark.createDataFrame([(1,), (9,)], "po_id long")
    ok, rejected = orders._gate(req, seed["purchase_order"], seed["purchase_order_details"], "po_id", orders.RECEIVABLE)
    assert {r.po_id: r.reason for r in rejected.collect()}[9] == "NOT_FOUND"
    logical = ok._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in logical


def test_add_lines_meets_only_staged_keys(spark, seed):
    detail, item = seed["sales_order_details"], seed["item"]
    old = detail.first()
    staged = spark.createDataFrame([(1, old.so_id, old.item_id, 2, None), (2, old.so_id, 10**6, 2, None)],
                                   "staged_id long, so_id long, item_id long, quantity long, price decimal(12,2)")
    r = orders.add_lines(detail, staged, item, "so_id", "so_detail_id", "staged_id", True)
    assert {x.staged_id: x.reason for x in r["rejected"].collect()} == {1: "DUPLICATE_LINE", 2: "UNKNOWN_ITEM"}
    assert "LeftSemi" in r["rejected"]._jdf.queryExecution().optimizedPlan().toString()


def test_line_views_return_the_line_id(spark, seed):
    assert views.po_lines(seed["purchase_order_details"], seed["item"]).columns[0] == "po_detail_id"
    ids = {r.so_detail_id for r in views.so_lines(seed["sales_order_details"], seed["item"]).collect()}
    assert ids == {r.so_detail_id for r in seed["sales_order_details"].select("so_detail_id").collect()}
    assert seed["sales_order_details"].where(F.col("so_detail_id").isNull()).count() == 0
