"""Order and master-data workflows over whole request sets
(WF4-WF7, WF10, WF11, WF13, WF14, WF19, WF20).

Every workflow is all-or-nothing per order (D-9) and returns new table
states plus a ``rejected`` frame with a reason, instead of raising.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import (backfill_contact_expr, collated, map_role,
                                         non_blank, strip, valid_gmail)
from stockflow.operators import ledger, totals
from stockflow.operators.alerts import with_all_levels
from stockflow.operators.allocation import allocate
from stockflow.sources.sinks import Outputs, append_rows, update_by_key, upsert_stock

KEY = ["warehouse_id", "item_id"]
RECEIVABLE = ("CREATED", "APPROVED", "PARTIAL")   # D-3
SHIPPABLE = ("NEW", "CONFIRMED")


def _gate(request: DataFrame, header: DataFrame, detail: DataFrame, key: str,
          allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Split requested orders into (accepted headers, rejected with reason)."""
    req = request.select(key).distinct()
    # only requested orders' lines are shuffled
    has_lines = detail.select(key).join(req, key, "left_semi").distinct().withColumn("_has_lines", F.lit(True))
    h = (req.join(header.select(key, "warehouse_id", "status"), key, "left")
         .join(has_lines, key, "left"))
    reason = (F.when(F.col("status").isNull(), "NOT_FOUND")
              .when(~F.col("status").isin(*allowed), F.concat(F.lit("BAD_STATUS:"), F.col("status")))
              .when(F.col("_has_lines").isNull(), "NO_LINES"))
    h = h.withColumn("reason", reason)
    return (h.where(F.col("reason").isNull()).select(key, "warehouse_id"),
            h.where(F.col("reason").isNotNull()).select(key, "reason"))


def _open_headers(request: DataFrame, header: DataFrame, key: str, allowed: tuple[str, ...]) -> DataFrame:
    """The requested orders of an allowed status: what the lines of accepted
    orders join. That an accepted order has lines need not be looked up for
    that: one without any gives the join nothing."""
    req = request.select(key).distinct()
    return (req.join(header.select(key, "warehouse_id", "status"), key)
            .where(F.col("status").isin(*allowed)).select(key, "warehouse_id"))


# ---------------------------------------------------------------- receive
def receive_pos(po: DataFrame, pod: DataFrame, stock: DataFrame, request: DataFrame,
                emp_id: int | None = None, as_of: str | None = None,
                ledger_log: DataFrame | None = None, item: DataFrame | None = None) -> dict[str, DataFrame]:
    """WF10: receive purchase orders: stock up, one ledger IN row per line,
    status RECEIVED and the header total refreshed (D-7). ``applied`` has each
    line's balance for the reorder alerts (with ``item``, and the item's levels,
    so that the observations come in the order of the scan); with
    ``ledger_log``, ``ledger`` is that ledger with the new rows posted.

    Lines of all accepted orders are pre-aggregated per (warehouse, item)
    and applied with one full outer join (SNK7) -- no per-line round trips.
    """
    ok, rejected = _gate(request, po, pod, "po_id", RECEIVABLE)
    lines = pod.join(_open_headers(request, po, "po_id", RECEIVABLE), "po_id")
    ts = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    new_stock = lambda: upsert_stock(stock, lines.select(*KEY, F.col("quantity").alias("delta")), as_of=as_of)
    log = lines.select(
        F.col("po_detail_id").alias("src_id"), *KEY, F.lit("IN").alias("change_type"),
        F.col("quantity").alias("delta_qty"), F.lit("PO").alias("ref_type"),
        F.col("po_id").alias("ref_id"), F.lit(emp_id).cast("long").alias("emp_id"), ts.alias("logged_at"))
    received = ok.select("po_id")
    new_po = totals.refresh_totals(po, pod, "po_id", received)
    new_po = update_by_key(new_po, received.withColumn("status", F.lit("RECEIVED")), ["po_id"], ["status"])
    return _with_ledger(Outputs(stock=new_stock, log=log, po=new_po, rejected=rejected, accepted=received,
                                applied=lambda: ledger.line_effects(log if item is None else with_all_levels(log, item),
                                                                    stock, ["logged_at", "src_id"])),
                        ledger_log, log, ["src_id"])


def _with_ledger(out: Outputs, ledger_log: DataFrame | None, entries: DataFrame, order: list[str]) -> Outputs:
    if ledger_log is not None:
        out["ledger"] = lambda: ledger.post(ledger_log, entries, order)
    return out


# ---------------------------------------------------------------- ship
def ship_sos(so: DataFrame, sod: DataFrame, stock: DataFrame, request: DataFrame | None = None,
             check_stock: bool = True, emp_id: int | None = None,
             as_of: str | None = None, ledger_log: DataFrame | None = None) -> dict[str, DataFrame]:
    """WF11: ship sales orders in so_id order with availability (D-8).

    With ``check_stock`` an order ships only if every line is available after
    the orders before it. Without it, an order with a line lacking a stock
    row is rejected ``NO_STOCK_ROW`` and one that would drive stock negative
    is rejected ``NEGATIVE_STOCK`` (the CHECK rule), never logged silently.
    ``applied`` and ``ledger`` as in ``receive_pos``, in so_id order.
    """
    req = request if request is not None else so.select("so_id")
    ok, rejected = _gate(req, so, sod, "so_id", SHIPPABLE)
    lines = sod.join(ok, "so_id").select("so_id", *KEY, "quantity", "so_detail_id")
    reason = "INSUFFICIENT_STOCK"
    if not check_stock:
        missing = (lines.join(stock.select(*KEY), KEY, "left_anti").select("so_id").distinct())
        rejected = rejected.unionByName(missing.withColumn("reason", F.lit("NO_STOCK_ROW")))
        lines = lines.join(missing, "so_id", "left_anti")
        reason = "NEGATIVE_STOCK"
    decisions = allocate(lines, stock, reason)
    shipped = decisions.where("shipped").select("so_id")
    out_lines = lines.join(shipped, "so_id")
    ts = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    new_stock = lambda: upsert_stock(stock, out_lines.select(*KEY, (-F.col("quantity")).alias("delta")), as_of=as_of)
    log = out_lines.select(
        F.col("so_detail_id").alias("src_id"), *KEY, F.lit("OUT").alias("change_type"),
        (-F.col("quantity")).alias("delta_qty"), F.lit("SO").alias("ref_type"),
        F.col("so_id").alias("ref_id"), F.lit(emp_id).cast("long").alias("emp_id"), ts.alias("logged_at"))
    new_so = totals.refresh_totals(so, sod, "so_id", shipped)
    new_so = update_by_key(new_so, shipped.withColumn("status", F.lit("SHIPPED")), ["so_id"], ["status"])
    all_decisions = decisions.unionByName(
        rejected.select("so_id", F.lit(False).alias("shipped"), "reason"))
    return _with_ledger(Outputs(stock=new_stock, log=log, so=new_so, decisions=all_decisions,
                                rejected=all_decisions.where(~F.col("shipped")).select("so_id", "reason"),
                                applied=lambda: ledger.line_effects(log, stock, ["ref_id", "src_id"])),
                        ledger_log, log, ["ref_id", "src_id"])


# ---------------------------------------------------------------- adjust / returns
def adjust_stock(stock: DataFrame, adjustments: DataFrame, as_of: str | None = None,
                 ledger_log: DataFrame | None = None) -> dict[str, DataFrame]:
    """WF13: signed manual adjustments in time order; one that would make stock
    negative is rejected. ``adjustments``: adj_id, warehouse_id, item_id,
    delta, emp_id, reason, adjusted_at. The reason is kept on the log row.
    ``stock_table`` is the whole stock table afterwards (ids and stamps)."""
    moves = adjustments.select(
        F.col("adj_id").alias("log_id"), *KEY, F.col("adjusted_at").alias("logged_at"),
        F.lit("ADJUST").alias("change_type"), F.col("delta").alias("delta_qty"),
        F.lit("MANUAL").alias("ref_type"), "emp_id", "reason")
    applied = ledger.apply_movements(moves, stock)
    done = applied.where("accepted")
    return _with_ledger(Outputs(applied=applied, stock=ledger.stock_after(stock, applied),
                                stock_table=lambda: _restock(stock, applied, as_of),
                                log=done.drop("accepted", "balance", "signed_qty"),
                                rejected=applied.where(~F.col("accepted")).select(
                                    "log_id", *KEY, "delta_qty", F.lit("NEGATIVE_STOCK").alias("reason"))),
                        ledger_log, done, ["logged_at", "log_id"])


def _restock(stock: DataFrame, applied: DataFrame, as_of: str | None) -> DataFrame:
    """The whole stock table after the accepted movements."""
    return upsert_stock(stock, applied.where("accepted").select(*KEY, F.col("signed_qty").alias("delta")), as_of=as_of)


def process_returns(stock: DataFrame, returns: DataFrame, emp_id: int | None = None, as_of: str | None = None,
                    ledger_log: DataFrame | None = None) -> dict[str, DataFrame]:
    """WF14: customer returns come IN, supplier returns go OUT, in return order.

    A supplier return that would drive stock negative -- including one for a
    key with no stock row -- is rejected and changes nothing; a customer
    return for a missing key creates the row. Both kinds are logged with
    their own ref types (D-2: RETURN_CUST / RETURN_SUPP).
    """
    moves = returns.select(
        F.col("return_id").alias("log_id"), *KEY, F.col("returned_at").alias("logged_at"),
        F.when(F.col("kind") == "CUSTOMER", "IN").otherwise("OUT").alias("change_type"),
        F.col("quantity").alias("delta_qty"),
        F.when(F.col("kind") == "CUSTOMER", "RETURN_CUST").otherwise("RETURN_SUPP").alias("ref_type"))
    applied = ledger.apply_movements(moves, stock)
    done = applied.where("accepted")
    return _with_ledger(Outputs(applied=applied, stock=ledger.stock_after(stock, applied),
                                stock_table=lambda: _restock(stock, applied, as_of),
                                log=done.select("log_id", *KEY, "change_type", "delta_qty", "ref_type", "logged_at")),
                        ledger_log, done.withColumn("emp_id", F.lit(emp_id).cast("long")), ["logged_at", "log_id"])


# ---------------------------------------------------------------- master data
def _first_per_name(staged: DataFrame, name: str, id_col: str) -> DataFrame:
    """Winners of in-batch name duplicates: the smallest staged id per
    collated name (aggregate, so a hot name is pre-reduced map-side)."""
    return (staged.groupBy(collated(F.col(name)).alias("_nk"))
            .agg(F.min(id_col).alias(id_col)).select(id_col))


def add_master(target: DataFrame, staged: DataFrame, id_col: str, staged_id: str,
               required: list[str], unique_name: str | None = "name",
               defaults: dict | None = None) -> dict[str, DataFrame]:
    """WF4: validated intake of suppliers / customers / items.

    Rejects blank required fields, names already in ``target`` and in-batch
    duplicates (names compare case/accent-insensitively); the rest is
    appended with new ids (SNK1) in staged-id order.
    """
    checks = [(F.when(~non_blank(F.col(c)), F.lit(f"BLANK_{c.upper()}"))) for c in required]
    s = staged.withColumn("reason", F.coalesce(*checks) if checks else F.lit(None).cast("string"))
    if unique_name:
        s = s.withColumn("_nk", collated(F.col(unique_name)))
        existing = target.select(collated(F.col(unique_name)).alias("_nk")).join(s.select("_nk"), "_nk", "left_semi").distinct()
        s = (s.join(existing.withColumn("_dup", F.lit(True)), "_nk", "left")
             .withColumn("reason", F.coalesce("reason", F.when(F.col("_dup"), F.lit("DUPLICATE_NAME"))))
             .drop("_dup"))
        named = F.col(unique_name).isNotNull()     # a unique key admits any number of nulls
        winners = _first_per_name(s.where(F.col("reason").isNull() & named), unique_name, staged_id)
        s = (s.join(winners.withColumn("_win", F.lit(True)), staged_id, "left")
             .withColumn("reason", F.coalesce("reason", F.when(F.col("_win").isNull() & named,
                                                               F.lit("DUPLICATE_IN_BATCH"))))
             .drop("_win", "_nk"))
    ok = s.where(F.col("reason").isNull()).drop("reason")
    rejected = s.where(F.col("reason").isNotNull()).select(staged_id, "reason")
    cols = [c for c in target.columns if c != id_col and c in ok.columns]
    return Outputs(table=lambda: append_rows(target, ok.select(staged_id, *cols), id_col, [staged_id], defaults),
                   accepted=ok, rejected=rejected)


def create_orders(header: DataFrame, staged: DataFrame, id_col: str, staged_id: str,
                  parents: dict[str, DataFrame], start_status: str) -> dict[str, DataFrame]:
    """WF5: new order headers with their start status (CREATED / NEW) and a
    zero total; staged rows whose foreign keys are missing are rejected."""
    s = staged.withColumn("reason", F.lit(None).cast("string"))
    for col, parent in parents.items():
        pk = parent.select(F.col(parent.columns[0]).alias(col)).withColumn("_ok_" + col, F.lit(True))  # the declared key
        s = (s.join(pk, col, "left")
             .withColumn("reason", F.coalesce("reason", F.when(F.col("_ok_" + col).isNull(),
                                                               F.lit(f"UNKNOWN_{col.upper()}"))))
             .drop("_ok_" + col))
    ok = (s.where(F.col("reason").isNull()).drop("reason")
          .withColumn("status", F.lit(start_status)).withColumn("total_amount", F.lit(0)))
    cols = [c for c in header.columns if c != id_col]
    return Outputs(table=lambda: append_rows(header, ok.select(staged_id, *cols), id_col, [staged_id]),
                   rejected=s.where(F.col("reason").isNotNull()).select(staged_id, "reason"))


def add_lines(detail: DataFrame, staged: DataFrame, item: DataFrame, order_col: str,
              detail_id: str, staged_id: str, editable_price: bool,
              header: DataFrame | None = None) -> dict[str, DataFrame]:
    """WF6: add order lines. PO lines take the item price (frozen); SO lines
    take the typed price, else the item price, else 0 (D-16). Rejected are
    unknown items, quantities that are null or not positive, negative prices,
    (order, item) pairs already present and, given the ``header`` table,
    unknown orders; then touched headers come back with refreshed totals."""
    it = item.select("item_id", F.col("price").alias("_list")).withColumn("_known", F.lit(True))
    s = staged.join(it, "item_id", "left")
    price = (F.coalesce(F.col("price"), F.col("_list"), F.lit(0)) if editable_price
             else F.coalesce(F.col("_list"), F.lit(0))).cast("decimal(12,2)")
    if header is None:
        s = s.withColumn("_order", F.lit(True))
    else:
        s = s.join(header.select(order_col).withColumn("_order", F.lit(True)), order_col, "left")  # the declared key
    existing = (detail.select(order_col, "item_id").join(staged.select(order_col, "item_id"), [order_col, "item_id"], "left_semi")
                .distinct().withColumn("_dup", F.lit(True)))
    s = (s.withColumn("price", price).join(existing, [order_col, "item_id"], "left")
         .withColumn("reason", F.when(F.col("_order").isNull(), "UNKNOWN_ORDER")
                     .when(F.col("_known").isNull(), "UNKNOWN_ITEM")
                     .when(F.col("quantity").isNull() | (F.col("quantity") <= 0), "BAD_QUANTITY")
                     .when(F.col("price") < 0, "BAD_PRICE")
                     .when(F.col("_dup"), "DUPLICATE_LINE")))
    first = s.where(F.col("reason").isNull()).groupBy(order_col, "item_id").agg(F.min(staged_id).alias(staged_id))
    s = (s.join(first.withColumn("_win", F.lit(True)), [order_col, "item_id", staged_id], "left")
         .withColumn("reason", F.coalesce("reason", F.when(F.col("_win").isNull(), F.lit("DUPLICATE_LINE")))))
    ok = s.where(F.col("reason").isNull()).select(staged_id, order_col, "item_id", "quantity", "price")
    out = Outputs(table=lambda: append_rows(detail, ok, detail_id, [staged_id]), accepted=ok,
                  rejected=s.where(F.col("reason").isNotNull()).select(staged_id, order_col, "item_id", "quantity",
                                                                       "price", "reason"))
    if header is not None:
        lines = detail.select(order_col, "quantity", "price").unionByName(ok.select(order_col, "quantity", "price"))
        out["header"] = totals.refresh_totals(header, lines, order_col, ok.select(order_col))
    return out


def update_line_qty(detail: DataFrame, changes: DataFrame, order_col: str,
                    header: DataFrame | None = None) -> dict[str, DataFrame]:
    """WF7: change line quantities; null, zero and negative quantities (D-10)
    and lines that do not exist come back rejected, so every change is either
    applied or rejected. Of several changes of one line the largest quantity
    counts. Header totals of touched orders are refreshed when a header is
    given."""
    keys = [order_col, "item_id"]
    known = detail.select(*keys).join(changes.select(*keys), keys, "left_semi").distinct().withColumn("_known", F.lit(True))
    c = changes.join(known, keys, "left").withColumn(
        "reason", F.when(F.col("quantity").isNull() | (F.col("quantity") <= 0), "BAD_QUANTITY")
        .when(F.col("_known").isNull(), "UNKNOWN_LINE"))
    good = c.where(F.col("reason").isNull()).select(*changes.columns)
    out = {"detail": update_by_key(detail, good, keys, ["quantity"]),
           "rejected": c.where(F.col("reason").isNotNull()).select(*changes.columns, "reason")}
    if header is not None:
        out["header"] = totals.refresh_totals(header, out["detail"], order_col, good.select(order_col))
    return out


def add_employees(employee: DataFrame, staged: DataFrame, warehouse: DataFrame) -> dict[str, DataFrame]:
    """WF19: employee intake: name not blank, contact a Gmail address, role
    label mapped (default staff), warehouse known or empty."""
    wh = warehouse.select("warehouse_id").withColumn("_wh", F.lit(True))
    s = (staged.join(wh, "warehouse_id", "left")
         .withColumn("role", map_role(F.col("role_label")))
         .withColumn("contact", strip("contact"))
         .withColumn("reason", F.when(~non_blank(F.col("name")), "BLANK_NAME")
                     .when(~valid_gmail(F.col("contact")), "BAD_CONTACT")
                     .when(F.col("warehouse_id").isNotNull() & F.col("_wh").isNull(), "UNKNOWN_WAREHOUSE")))
    ok = s.where(F.col("reason").isNull())
    cols = [c for c in employee.columns if c != "emp_id" and c in ok.columns]
    return Outputs(table=lambda: append_rows(employee, ok.select("staged_id", *cols), "emp_id", ["staged_id"],
                                             table="employee"),
                   accepted=ok.drop("reason", "_wh"),
                   rejected=s.where(F.col("reason").isNotNull()).select("staged_id", "reason"))


def backfill_contact(supplier: DataFrame) -> DataFrame:
    """WF20: fill missing supplier contacts from phone, else email, else ''
    (the later rule, D-15); afterwards ``contact`` is never null."""
    return supplier.withColumn("contact", backfill_contact_expr())


def employee_checks(staged: DataFrame) -> DataFrame:
    """SC6-SC8 on staged employees: trimmed contact, Gmail validity, role."""
    return staged.select("emp_id", "role_label", map_role(F.col("role_label")).alias("role"),
                         "contact", valid_gmail(F.col("contact")).alias("valid_gmail"),
                         non_blank(F.col("name")).alias("name_ok"))
