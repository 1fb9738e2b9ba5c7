"""Read views over stock, items and orders (PF10, J1-J6, J9, WF1-3, WF8, WF9, WF12, WF18).

No join carries a hint: Catalyst broadcasts a dimension (warehouse, item) only
when its size is below the threshold; otherwise AQE plans a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import collated, is_low, line_total, stock_status

RECEIVABLE_STATUSES = ("CREATED", "APPROVED", "PARTIAL")  # D-3: PARTIAL matches nothing
SHIPPABLE_STATUSES = ("NEW", "CONFIRMED")


def lookup(df: DataFrame, key: str, label: str | None = None, where: Column | None = None,
           order_by: str | None = None) -> DataFrame:
    """PF10: key -> label pairs, optionally filtered and ordered (names collated)."""
    lab = F.col(label) if label else F.col(key).cast("string")
    out = df if where is None else df.where(where)
    out = out.select(F.col(key).alias("key"), lab.alias("label"))
    if order_by:
        sort_col = F.col("label") if order_by == label else F.col(order_by)
        out = out.orderBy(collated(sort_col) if order_by == label else sort_col, F.col("key"))
    return out


def _wh_names(warehouse: DataFrame) -> DataFrame:
    return warehouse.select("warehouse_id", F.col("name").alias("warehouse_name"))


def _items(item: DataFrame, *cols: str) -> DataFrame:
    sel = ["item_id"] + [c for c in cols if c != "item_id"]
    return item.select(*[F.col(c).alias("item_name") if c == "name" else F.col(c) for c in sel])


def inventory_view(stock: DataFrame, item: DataFrame, warehouse: DataFrame,
                   warehouse_id: int | None = None) -> DataFrame:
    """WF1: stock JOIN item LEFT JOIN warehouse, with LOW/OK status."""
    s = stock if warehouse_id is None else stock.where(F.col("warehouse_id") == F.lit(warehouse_id))
    out = (s.select("warehouse_id", "item_id", "quantity")
           .join(_items(item, "name", "unit_of_measure", "price", "reorder_level"), "item_id")
           .join(_wh_names(warehouse), "warehouse_id", "left"))
    return out.select("warehouse_id", "warehouse_name", "item_id", "item_name", "quantity",
                      "unit_of_measure", "price", "reorder_level",
                      stock_status().alias("status"))


def low_stock_nested(stock: DataFrame, item: DataFrame, warehouse: DataFrame) -> DataFrame:
    """WF2/J6: rows whose quantity is below the item's reorder level, all warehouses.

    The reference writes two correlated scalar subqueries; one join on
    ``item_id`` gives the same rows (item_id is the item key).
    """
    return (stock.select("warehouse_id", "item_id", "quantity")
            .join(_items(item, "name", "reorder_level"), "item_id")
            .where(is_low())
            .join(_wh_names(warehouse), "warehouse_id", "left")
            .select("warehouse_id", "warehouse_name", "item_id", "item_name", "quantity", "reorder_level"))


def low_stock_correlated(stock: DataFrame, item: DataFrame, warehouse: DataFrame) -> DataFrame:
    """J6 as written: name and level of each stock row's item are correlated
    scalar subqueries. An item without row gives nulls (and so is not low);
    an item_id that is repeated is an error when it is met, not more rows."""
    spark = stock.sparkSession
    name = "(SELECT i.name FROM {item} i WHERE i.item_id = s.item_id)"
    level = "(SELECT i.reorder_level FROM {item} i WHERE i.item_id = s.item_id)"
    return spark.sql(
        "SELECT s.warehouse_id, (SELECT w.name FROM {warehouse} w WHERE w.warehouse_id = s.warehouse_id) AS warehouse_name, "
        f"s.item_id, {name} AS item_name, s.quantity, {level} AS reorder_level FROM {{stock}} s WHERE s.quantity < {level}",
        stock=stock, item=item, warehouse=warehouse)


def low_stock(stock: DataFrame, item: DataFrame, warehouse_id: int | None = None) -> DataFrame:
    """WF3: low rows of one (or every) warehouse, largest shortage first."""
    s = stock if warehouse_id is None else stock.where(F.col("warehouse_id") == F.lit(warehouse_id))
    return (s.select("warehouse_id", "item_id", "quantity")
            .join(_items(item, "name", "reorder_level"), "item_id")
            .where(is_low())
            .select("warehouse_id", "item_id", "item_name", "quantity", "reorder_level",
                    (F.col("reorder_level") - F.col("quantity")).alias("shortage"))
            .orderBy("warehouse_id", F.desc("shortage"), "item_id"))


def stock_qty(requests: DataFrame, stock: DataFrame, wh_col: str = "warehouse_id",
              item_col: str = "item_id", out_col: str = "on_hand") -> DataFrame:
    """J9: on-hand quantity per request row; a missing stock row counts as 0."""
    st = stock.select(F.col("warehouse_id").alias(wh_col), F.col("item_id").alias(item_col),
                      F.col("quantity").alias(out_col))
    return (requests.join(st, [wh_col, item_col], "left")
            .withColumn(out_col, F.coalesce(F.col(out_col), F.lit(0).cast("long"))))


def po_lines(pod: DataFrame, item: DataFrame) -> DataFrame:
    """WF8: purchase-order lines with their line id, item names and line totals."""
    return (pod.select("po_detail_id", "po_id", "item_id", "quantity", "price")
            .join(_items(item, "name"), "item_id")
            .select("po_detail_id", "po_id", "item_id", "item_name", "quantity", "price",
                    line_total().alias("line_total")))


def so_lines(sod: DataFrame, item: DataFrame) -> DataFrame:
    """WF8: sales-order lines with their line id and item names (no total column)."""
    return (sod.select("so_detail_id", "so_id", "item_id", "quantity", "price")
            .join(_items(item, "name"), "item_id")
            .select("so_detail_id", "so_id", "item_id", "item_name", "quantity", "price"))


def receivable(po: DataFrame) -> DataFrame:
    """WF9: purchase orders open to receiving, newest first."""
    return (po.where(F.col("status").isin(*RECEIVABLE_STATUSES))
            .select("po_id", "supplier_id", "warehouse_id", "po_date", "status")
            .orderBy(F.desc("po_id")))


def shippable(so: DataFrame) -> DataFrame:
    """WF9: sales orders open to shipping, newest first."""
    return (so.where(F.col("status").isin(*SHIPPABLE_STATUSES))
            .select("so_id", "customer_id", "warehouse_id", "so_date", "status")
            .orderBy(F.desc("so_id")))


def availability_lines(so: DataFrame, sod: DataFrame, stock: DataFrame) -> DataFrame:
    """Per order line: requested, on hand (missing row -> 0), short flag."""
    lines = (sod.select("so_id", "item_id", F.col("quantity").alias("requested"))
             .join(so.select("so_id", "warehouse_id"), "so_id"))
    return (stock_qty(lines, stock)
            .withColumn("short", F.col("on_hand") < F.col("requested")))


def availability(so: DataFrame, sod: DataFrame, stock: DataFrame) -> DataFrame:
    """WF12/J8: per order, whether any line is short against current stock."""
    return (availability_lines(so, sod, stock)
            .groupBy("so_id", "warehouse_id")
            .agg(F.count("*").alias("n_lines"),
                 F.count_if(F.col("short")).alias("n_short"),
                 F.sum("requested").alias("requested"),
                 F.bool_or("short").alias("any_short"))
            .withColumn("can_ship", ~F.col("any_short")))


def employee_directory(employee: DataFrame, warehouse: DataFrame) -> DataFrame:
    """WF18/J5: employees with their warehouse name (D-13: both names kept)."""
    return (employee.select("emp_id", "name", "role", "contact", "warehouse_id")
            .join(_wh_names(warehouse), "warehouse_id", "left")
            .select("emp_id", "name", "role", "contact", "warehouse_id", "warehouse_name")
            .orderBy("emp_id"))
