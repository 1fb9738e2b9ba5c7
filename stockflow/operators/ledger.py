"""Stock ledger: movement union, net deltas, rebuild/drift, running and
clipped balances (SO1, AG8, AG9, WN2, WN3).

Movement order is fixed everywhere: ``(logged_at, log_id)`` within a
(warehouse, item) key (section 4 rule 6). Per-key ordered work goes through
``stockflow.plans.scan`` so a hot key never lands in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import signed_qty
from stockflow.plans.scan import clipped_fold, running_sum
from stockflow.schemas import SCHEMAS
from stockflow.sources.sinks import append_rows

KEY = ["warehouse_id", "item_id"]
ORDER = ["logged_at", "log_id"]
_KIND = "_row_kind"      # 0 = opening row, 1 = movement (openings sort first)


def with_signed(log: DataFrame) -> DataFrame:
    """D-1 ledger view: ``signed_qty`` (IN +, OUT -, ADJUST as logged)."""
    return log.withColumn("signed_qty", signed_qty())


def movements(po: DataFrame, pod: DataFrame, so: DataFrame, sod: DataFrame,
              adjustments: DataFrame, returns: DataFrame) -> DataFrame:
    """SO1: one ledger from receipts, shipments, adjustments and both returns.

    Receipts are lines of RECEIVED purchase orders, shipments lines of
    SHIPPED sales orders (logged negative, as the procedure does);
    adjustments are ADJUST ledger rows; customer returns come IN and supplier
    returns go OUT (logged positive, as the app does). ``signed_qty`` applies
    D-1 so both sign conventions agree.
    """
    cols = ["warehouse_id", "item_id", "change_type", "delta_qty", "ref_type", "ref_id",
            "src_id", "logged_at"]
    rec = (pod.join(po.where(F.col("status") == "RECEIVED").select("po_id", "warehouse_id", "po_date"), "po_id")
           .select("warehouse_id", "item_id", F.lit("IN").alias("change_type"),
                   F.col("quantity").alias("delta_qty"), F.lit("PO").alias("ref_type"),
                   F.col("po_id").alias("ref_id"), F.col("po_detail_id").alias("src_id"),
                   F.col("po_date").cast("timestamp").alias("logged_at")))
    shp = (sod.join(so.where(F.col("status") == "SHIPPED").select("so_id", "warehouse_id", "so_date"), "so_id")
           .select("warehouse_id", "item_id", F.lit("OUT").alias("change_type"),
                   (-F.col("quantity")).alias("delta_qty"), F.lit("SO").alias("ref_type"),
                   F.col("so_id").alias("ref_id"), F.col("so_detail_id").alias("src_id"),
                   F.col("so_date").cast("timestamp").alias("logged_at")))
    adj = (adjustments.where(F.col("change_type") == "ADJUST")
           .select("warehouse_id", "item_id", "change_type", "delta_qty", "ref_type", "ref_id",
                   F.col("log_id").alias("src_id"), "logged_at"))
    ret = returns.select(
        "warehouse_id", "item_id",
        F.when(F.col("kind") == "CUSTOMER", "IN").otherwise("OUT").alias("change_type"),
        F.col("quantity").alias("delta_qty"),
        F.when(F.col("kind") == "CUSTOMER", "RETURN_CUST").otherwise("RETURN_SUPP").alias("ref_type"),
        F.lit(None).cast("long").alias("ref_id"), F.col("return_id").alias("src_id"),
        F.col("returned_at").alias("logged_at"))
    return (rec.select(*cols).unionByName(shp.select(*cols)).unionByName(adj.select(*cols))
            .unionByName(ret.select(*cols)).withColumn("signed_qty", signed_qty()))


def net_movements(moves: DataFrame) -> DataFrame:
    """AG8: signed delta per (warehouse, item), partial + final aggregate."""
    m = moves if "signed_qty" in moves.columns else with_signed(moves)
    return m.groupBy(*KEY).agg(F.sum("signed_qty").cast("long").alias("net_qty"),
                               F.count("*").alias("n_moves"))


def stock_from_ledger(log: DataFrame) -> DataFrame:
    """AG9: stock rebuilt from the ledger alone."""
    m = log if "signed_qty" in log.columns else with_signed(log)
    return m.groupBy(*KEY).agg(F.sum("signed_qty").cast("long").alias("quantity"),
                               F.count("*").alias("n_moves"),
                               F.max("logged_at").alias("last_logged_at"))


def ledger_drift(stock: DataFrame, log: DataFrame) -> DataFrame:
    """AG9: keys where stored stock and the ledger disagree (missing side = 0)."""
    led = stock_from_ledger(log).select(*KEY, F.col("quantity").alias("ledger_qty"))
    st = stock.select(*KEY, F.col("quantity").alias("stock_qty"))
    j = st.join(led, KEY, "full_outer")
    s = F.coalesce(F.col("stock_qty"), F.lit(0))
    l = F.coalesce(F.col("ledger_qty"), F.lit(0))
    return (j.select(*KEY, s.alias("stock_qty"), l.alias("ledger_qty"), (s - l).alias("drift"))
            .where(F.col("drift") != 0))


def _with_openings(moves: DataFrame, opening: DataFrame | None, value: str) -> DataFrame:
    m = moves.withColumn(_KIND, F.lit(1)).withColumn("_v", F.col(value).cast("long"))
    if opening is None:
        return m.withColumn("_reset", F.lit(False))
    # only keys that move: a billion resting stock rows need no fold
    o = (opening.join(moves.select(*KEY).distinct(), KEY, "left_semi")
         .select(*KEY, F.col("quantity").cast("long").alias("_v")))
    for f in m.schema.fields:
        if f.name not in o.columns:
            o = o.withColumn(f.name, F.lit(None).cast(f.dataType))
    o = o.withColumn(_KIND, F.lit(0))
    return (m.withColumn("_reset", F.lit(False))
            .unionByName(o.select(*m.columns).withColumn("_reset", F.lit(True))))


def running_balance(log: DataFrame, opening: DataFrame | None = None,
                    order: list[str] | None = None) -> DataFrame:
    """WN2: balance after each movement = opening + running signed sum."""
    m = log if "signed_qty" in log.columns else with_signed(log)
    u = _with_openings(m, opening, "signed_qty")
    r = running_sum(u, KEY, [_KIND, *(order or ORDER)], "_v", "balance")
    return r.where(F.col(_KIND) == 1).drop(_KIND, "_v", "_reset")


def apply_movements(log: DataFrame, opening: DataFrame | None = None,
                    order: list[str] | None = None) -> DataFrame:
    """WN3: apply movements in order; one that would drive stock below zero is
    rejected (CHECK quantity >= 0) and the balance stays. Every movement row
    comes back with ``accepted`` and ``balance`` (after the row)."""
    m = log if "signed_qty" in log.columns else with_signed(log)
    u = _with_openings(m, opening, "signed_qty")
    r = clipped_fold(u, KEY, [_KIND, *(order or ORDER)], "_v", "_reset")
    return r.where(F.col(_KIND) == 1).drop(_KIND, "_v", "_reset")


LEDGER = SCHEMAS["transaction_log"].fieldNames()


def post(log: DataFrame, entries: DataFrame, order: list[str]) -> DataFrame:
    """The ledger after appending ``entries`` in the declared schema, with new
    log ids in ``order``. Columns that an entry does not have are null; a null
    in a NOT NULL column is an error."""
    cols = [c for c in LEDGER if c != "log_id" and c in entries.columns]
    new = entries.select(*[F.col(c).alias("_o_" + c) for c in order], *cols)
    return append_rows(log.select(*LEDGER), new, "log_id", ["_o_" + c for c in order], table="transaction_log")


def line_effects(lines: DataFrame, stock: DataFrame, order: list[str]) -> DataFrame:
    """Order lines that are applied without a check as movements with the
    balance each leaves, in the shape ``alerts.observations`` takes: one
    observation per line (D-5), the first row of a new key included. ``lines``
    has the ledger's columns and src_id."""
    moves = lines.withColumn("log_id", F.col("src_id")).withColumn("signed_qty", signed_qty())
    return running_balance(moves, stock, order).withColumn("accepted", F.lit(True))


def stock_after(stock: DataFrame, applied: DataFrame, mark: str | None = None) -> DataFrame:
    """New stock snapshot after ``apply_movements``: last balance per key, with
    untouched stock rows kept. Keys without a row get one. ``mark`` names a
    column of ``stock`` that takes the time of the key's last movement, from
    the same aggregate and join."""
    last = (applied.groupBy(*KEY)
            .agg(F.max_by("balance", F.struct(*ORDER)).alias("new_qty"), F.max("logged_at").alias("_new_mark"),
                 F.count_if("accepted").alias("n_applied"),
                 F.count_if(~F.col("accepted")).alias("n_rejected")))
    j = stock.select(*KEY, "quantity", *([mark] if mark else [])).join(last, KEY, "full_outer")
    return j.select(*KEY, F.coalesce("new_qty", "quantity").cast("long").alias("quantity"),
                    *([F.greatest(mark, "_new_mark").alias(mark)] if mark else []),
                    F.coalesce("n_applied", F.lit(0)).alias("n_applied"),
                    F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"))
