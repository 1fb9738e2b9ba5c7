"""Registered queries over the test tables, with their DuckDB oracle SQL.

Each entry maps a name to ``(spark_fn, oracle_sql_or_None)``; ``spark_fn``
takes ``(spark, sf_dir)`` and returns a DataFrame over the whole derived
tables. Column names match between the two sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.operators import reports, totals, views
from stockflow.sources.testdata import TestTables
from stockflow.sources.testdata_sql import with_tables as W

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def T(spark: SparkSession, sf_dir: str) -> TestTables:
    return TestTables(spark, sf_dir)


ONE_WAREHOUSE = 3  # the warehouse picked in the single-warehouse views

# ---------------------------------------------------------------- views
_INV_SQL = """
SELECT s.warehouse_id, w.name AS warehouse_name, i.item_id, i.name AS item_name, s.quantity,
       i.unit_of_measure, i.price, i.reorder_level,
       CASE WHEN s.quantity < i.reorder_level THEN 'LOW' ELSE 'OK' END AS status
FROM w_stock s JOIN w_item i ON s.item_id = i.item_id
LEFT JOIN w_warehouse w ON s.warehouse_id = w.warehouse_id"""


@register("inventory_view", W("w_stock", "w_item", "w_warehouse") + _INV_SQL)
def q_inventory_view(spark, d):
    t = T(spark, d)
    return views.inventory_view(t.stock, t.item, t.warehouse)


@register("inventory_one_warehouse",
          W("w_stock", "w_item", "w_warehouse") + _INV_SQL + f"\nWHERE s.warehouse_id = {ONE_WAREHOUSE}")
def q_inventory_one(spark, d):
    t = T(spark, d)
    return views.inventory_view(t.stock, t.item, t.warehouse, warehouse_id=ONE_WAREHOUSE)


@register("low_stock_nested", W("w_stock", "w_item", "w_warehouse") + """
, low AS (SELECT stock.warehouse_id, stock.item_id, item.name AS item_name, stock.quantity, item.reorder_level
          FROM w_stock AS stock JOIN w_item AS item USING (item_id)
          WHERE item.reorder_level > stock.quantity)
SELECT low.*, place.name AS warehouse_name FROM low LEFT JOIN w_warehouse AS place USING (warehouse_id)""")
def q_low_stock_nested(spark, d):
    t = T(spark, d)
    return views.low_stock_nested(t.stock, t.item, t.warehouse)


@register("low_stock_ranked", W("w_stock", "w_item") + """
SELECT s.warehouse_id, s.item_id, i.name AS item_name, s.quantity, i.reorder_level,
       i.reorder_level - s.quantity AS shortage
FROM w_stock s JOIN w_item i ON i.item_id = s.item_id
WHERE s.quantity < i.reorder_level
ORDER BY s.warehouse_id, shortage DESC, s.item_id""")
def q_low_stock_ranked(spark, d):
    t = T(spark, d)
    return views.low_stock(t.stock, t.item)


@register("stock_qty_lookup", W("w_so", "w_sod", "w_stock") + """
SELECT d.so_id, d.item_id, h.warehouse_id, d.quantity AS requested,
       COALESCE(s.quantity, 0) AS on_hand
FROM w_sod d JOIN w_so h ON d.so_id = h.so_id
LEFT JOIN w_stock s ON s.warehouse_id = h.warehouse_id AND s.item_id = d.item_id
WHERE h.status IN ('NEW', 'CONFIRMED')""")
def q_stock_qty_lookup(spark, d):
    t = T(spark, d)
    so = t.sales_order.where(F.col("status").isin(*views.SHIPPABLE_STATUSES))
    req = (t.sales_order_details.select("so_id", "item_id", F.col("quantity").alias("requested"))
           .join(so.select("so_id", "warehouse_id"), "so_id"))
    return views.stock_qty(req, t.stock).select("so_id", "item_id", "warehouse_id", "requested", "on_hand")


@register("po_lines", W("w_pod", "w_item") + """
SELECT d.po_detail_id, d.po_id, d.item_id, i.name AS item_name, d.quantity, d.price,
       CAST(d.quantity * d.price AS DECIMAL(33,2)) AS line_total
FROM w_pod d JOIN w_item i ON d.item_id = i.item_id""")
def q_po_lines(spark, d):
    t = T(spark, d)
    return views.po_lines(t.purchase_order_details, t.item)


@register("so_lines", W("w_sod", "w_item") + """
SELECT d.so_detail_id, d.so_id, d.item_id, i.name AS item_name, d.quantity, d.price
FROM w_sod d JOIN w_item i ON d.item_id = i.item_id""")
def q_so_lines(spark, d):
    t = T(spark, d)
    return views.so_lines(t.sales_order_details, t.item)


@register("receivable_pos", W("w_po") + """
SELECT po_id, supplier_id, warehouse_id, po_date, status FROM w_po
WHERE status IN ('CREATED', 'APPROVED', 'PARTIAL') ORDER BY po_id DESC""")
def q_receivable(spark, d):
    return views.receivable(T(spark, d).purchase_order)


@register("shippable_sos", W("w_so") + """
SELECT so_id, customer_id, warehouse_id, so_date, status FROM w_so
WHERE status IN ('NEW', 'CONFIRMED') ORDER BY so_id DESC""")
def q_shippable(spark, d):
    return views.shippable(T(spark, d).sales_order)


@register("availability", W("w_so", "w_sod", "w_stock") + """
SELECT d.so_id, h.warehouse_id, count(*) AS n_lines,
       count(*) FILTER (WHERE COALESCE(s.quantity, 0) < d.quantity) AS n_short,
       CAST(sum(d.quantity) AS BIGINT) AS requested,
       bool_or(COALESCE(s.quantity, 0) < d.quantity) AS any_short,
       NOT bool_or(COALESCE(s.quantity, 0) < d.quantity) AS can_ship
FROM w_sod d JOIN w_so h ON d.so_id = h.so_id
LEFT JOIN w_stock s ON s.warehouse_id = h.warehouse_id AND s.item_id = d.item_id
WHERE h.status IN ('NEW', 'CONFIRMED')
GROUP BY d.so_id, h.warehouse_id""")
def q_availability(spark, d):
    t = T(spark, d)
    so = t.sales_order.where(F.col("status").isin(*views.SHIPPABLE_STATUSES))
    return views.availability(so, t.sales_order_details, t.stock)


@register("employee_directory", W("w_employee", "w_warehouse") + """
SELECT e.emp_id, e.name, e.role, e.contact, e.warehouse_id, w.name AS warehouse_name
FROM w_employee e LEFT JOIN w_warehouse w ON e.warehouse_id = w.warehouse_id
ORDER BY e.emp_id""")
def q_employee_directory(spark, d):
    t = T(spark, d)
    return views.employee_directory(t.employee, t.warehouse)


@register("lookup_items", W("w_item") + """
SELECT item_id AS key, name AS label FROM w_item ORDER BY lower(name), item_id""")
def q_lookup_items(spark, d):
    return views.lookup(T(spark, d).item, "item_id", "name", order_by="name")


# ---------------------------------------------------------------- totals
@register("po_totals", W("w_po", "w_pod") + """
SELECT h.po_id, CAST(COALESCE(sum(d.quantity * d.price), 0) AS DECIMAL(18,2)) AS po_total
FROM w_po h LEFT JOIN w_pod d ON d.po_id = h.po_id GROUP BY h.po_id""")
def q_po_totals(spark, d):
    t = T(spark, d)
    return totals.po_totals(t.purchase_order, t.purchase_order_details)


@register("so_totals", W("w_so", "w_sod") + """
SELECT h.so_id, CAST(COALESCE(sum(d.quantity * d.price), 0) AS DECIMAL(18,2)) AS so_total
FROM w_so h LEFT JOIN w_sod d ON d.so_id = h.so_id GROUP BY h.so_id""")
def q_so_totals(spark, d):
    t = T(spark, d)
    return totals.so_totals(t.sales_order, t.sales_order_details)


@register("total_drift", W("w_po", "w_pod", "w_so", "w_sod") + """
SELECT * FROM (
  SELECT 'PO' AS kind, h.po_id AS order_id, CAST(h.total_amount AS DECIMAL(18,2)) AS stored_total,
         CAST(COALESCE(sum(d.quantity * d.price), 0) AS DECIMAL(18,2)) AS computed_total
  FROM w_po h LEFT JOIN w_pod d ON d.po_id = h.po_id GROUP BY h.po_id, h.total_amount
  UNION ALL
  SELECT 'SO', h.so_id, CAST(h.total_amount AS DECIMAL(18,2)),
         CAST(COALESCE(sum(d.quantity * d.price), 0) AS DECIMAL(18,2))
  FROM w_so h LEFT JOIN w_sod d ON d.so_id = h.so_id GROUP BY h.so_id, h.total_amount)
WHERE stored_total <> computed_total""")
def q_total_drift(spark, d):
    t = T(spark, d)
    po = totals.total_drift(t.purchase_order, t.purchase_order_details, "po_id")
    so = totals.total_drift(t.sales_order, t.sales_order_details, "so_id")
    return (po.select(F.lit("PO").alias("kind"), F.col("po_id").alias("order_id"), "stored_total", "computed_total")
            .unionByName(so.select(F.lit("SO").alias("kind"), F.col("so_id").alias("order_id"),
                                   "stored_total", "computed_total")))


@register("refresh_totals", W("w_po", "w_pod") + """
SELECT h.po_id, h.status,
       CASE WHEN h.status IN ('CREATED', 'APPROVED')
            THEN CAST(COALESCE((SELECT sum(d.quantity * d.price) FROM w_pod d WHERE d.po_id = h.po_id), 0) AS DECIMAL(14,2))
            ELSE h.total_amount END AS total_amount
FROM w_po h""")
def q_refresh_totals(spark, d):
    t = T(spark, d)
    po = t.purchase_order
    changed = po.where(F.col("status").isin("CREATED", "APPROVED")).select("po_id")
    return (totals.refresh_totals(po, t.purchase_order_details, "po_id", changed)
            .select("po_id", "status", "total_amount"))


# ---------------------------------------------------------------- reports
_LINE_SUMS = """
  SELECT {k}, sum(quantity * price) AS s FROM {d} GROUP BY {k}"""


@register("month_purchases", W("w_po", "w_pod") + """
SELECT strftime(h.po_date, '%Y-%m') AS month, CAST(sum(d.quantity * d.price) AS DECIMAL(38,2)) AS total_purchases
FROM w_po h JOIN w_pod d ON d.po_id = h.po_id GROUP BY 1""")
def q_month_purchases(spark, d):
    t = T(spark, d)
    return reports.monthly_purchases(t.purchase_order, t.purchase_order_details)


@register("month_sales", W("w_so", "w_sod") + """
SELECT strftime(h.so_date, '%Y-%m') AS month, CAST(sum(d.quantity * d.price) AS DECIMAL(38,2)) AS total_sales
FROM w_so h JOIN w_sod d ON d.so_id = h.so_id GROUP BY 1""")
def q_month_sales(spark, d):
    t = T(spark, d)
    return reports.monthly_sales(t.sales_order, t.sales_order_details)


@register("monthly_pnl", W("w_po", "w_pod", "w_so", "w_sod") + """
, p AS (SELECT strftime(h.po_date, '%Y-%m') AS month, sum(d.quantity * d.price) AS v
        FROM w_po h JOIN w_pod d ON d.po_id = h.po_id GROUP BY 1),
  s AS (SELECT strftime(h.so_date, '%Y-%m') AS month, sum(d.quantity * d.price) AS v
        FROM w_so h JOIN w_sod d ON d.so_id = h.so_id GROUP BY 1)
SELECT COALESCE(p.month, s.month) AS month,
       CAST(COALESCE(p.v, 0) AS DECIMAL(38,2)) AS total_purchases,
       CAST(COALESCE(s.v, 0) AS DECIMAL(38,2)) AS total_sales,
       CAST(0 AS DECIMAL(38,2)) AS salaries,
       CAST(COALESCE(s.v, 0) - COALESCE(p.v, 0) AS DECIMAL(38,2)) AS profit_loss
FROM p FULL OUTER JOIN s ON p.month = s.month""")
def q_monthly_pnl(spark, d):
    t = T(spark, d)
    return reports.monthly_pnl(t.purchase_order, t.purchase_order_details,
                               t.sales_order, t.sales_order_details)


@register("monthly_pnl_with_salaries", W("w_po", "w_pod", "w_so", "w_sod", "w_employee") + """
, p AS (SELECT strftime(h.po_date, '%Y-%m') AS month, sum(d.quantity * d.price) AS v
        FROM w_po h JOIN w_pod d ON d.po_id = h.po_id WHERE h.status <> 'CANCELLED' GROUP BY 1),
  s AS (SELECT strftime(h.so_date, '%Y-%m') AS month, sum(d.quantity * d.price) AS v
        FROM w_so h JOIN w_sod d ON d.so_id = h.so_id WHERE h.status <> 'CANCELLED' GROUP BY 1)
SELECT COALESCE(p.month, s.month) AS month,
       CAST(COALESCE(p.v, 0) AS DECIMAL(38,2)) AS total_purchases,
       CAST(COALESCE(s.v, 0) AS DECIMAL(38,2)) AS total_sales,
       CAST((SELECT sum(monthly_salary) FROM w_employee) AS DECIMAL(38,2)) AS salaries,
       CAST(COALESCE(s.v, 0) - COALESCE(p.v, 0) - (SELECT sum(monthly_salary) FROM w_employee) AS DECIMAL(38,2)) AS profit_loss
FROM p FULL OUTER JOIN s ON p.month = s.month""")
def q_monthly_pnl_salaries(spark, d):
    """D-12 options: cancelled orders excluded, payroll from employee salaries."""
    t = T(spark, d)
    st = {"po": ("CREATED", "APPROVED", "RECEIVED"), "so": ("NEW", "CONFIRMED", "SHIPPED")}
    payroll = t.employee.agg(F.sum("monthly_salary")).scalar()  # scalar subquery
    return reports.monthly_pnl(t.purchase_order, t.purchase_order_details, t.sales_order,
                               t.sales_order_details, salaries=payroll, statuses=st)


@register("month_po_list", W("w_po") + """
SELECT po_id, supplier_id, warehouse_id, po_date, status, strftime(po_date, '%Y-%m') AS month FROM w_po""")
def q_month_po_list(spark, d):
    return reports.month_po_list(T(spark, d).purchase_order)


@register("month_so_list", W("w_so") + """
SELECT so_id, customer_id, warehouse_id, so_date, status, strftime(so_date, '%Y-%m') AS month FROM w_so""")
def q_month_so_list(spark, d):
    return reports.month_so_list(T(spark, d).sales_order)


REPORT_MONTH = "1996-03"


@register("month_report_one", W("w_po", "w_pod", "w_so", "w_sod") + f"""
SELECT month, total_purchases, total_sales, salaries,
       CAST(total_sales - total_purchases - salaries AS DECIMAL(38,2)) AS profit_loss
FROM (SELECT '{REPORT_MONTH}' AS month,
  CAST(COALESCE((SELECT sum(d.quantity * d.price) FROM w_po h JOIN w_pod d ON h.po_id = d.po_id
                 WHERE h.po_date >= DATE '{REPORT_MONTH}-01' AND h.po_date < DATE '{REPORT_MONTH}-01' + INTERVAL 1 MONTH), 0) AS DECIMAL(38,2)) AS total_purchases,
  CAST(COALESCE((SELECT sum(d.quantity * d.price) FROM w_so h JOIN w_sod d ON h.so_id = d.so_id
                 WHERE h.so_date >= DATE '{REPORT_MONTH}-01' AND h.so_date < DATE '{REPORT_MONTH}-01' + INTERVAL 1 MONTH), 0) AS DECIMAL(38,2)) AS total_sales,
  CAST(0 AS DECIMAL(38,2)) AS salaries)""")
def q_month_report_one(spark, d):
    """The reference's report: one month's totals (the month is the parameter)."""
    t = T(spark, d)
    return reports.monthly_report(t.purchase_order, t.purchase_order_details,
                                  t.sales_order, t.sales_order_details, REPORT_MONTH)["pnl"]


# ---------------------------------------------------------------- ledger
from stockflow.operators import ledger  # noqa: E402

_SIGNED = ("w_log_signed", """
  SELECT *, CAST(CASE change_type WHEN 'IN' THEN abs(delta_qty) WHEN 'OUT' THEN -abs(delta_qty)
                 ELSE delta_qty END AS BIGINT) AS signed_qty FROM w_log""")

_MOVES = ("w_moves", """
  SELECT *, CAST(CASE change_type WHEN 'IN' THEN abs(delta_qty) WHEN 'OUT' THEN -abs(delta_qty)
                 ELSE delta_qty END AS BIGINT) AS signed_qty FROM (
    SELECT h.warehouse_id, d.item_id, 'IN' AS change_type, d.quantity AS delta_qty, 'PO' AS ref_type,
           h.po_id AS ref_id, d.po_detail_id AS src_id, CAST(h.po_date AS TIMESTAMP) AS logged_at
    FROM w_pod d JOIN w_po h ON d.po_id = h.po_id WHERE h.status = 'RECEIVED'
    UNION ALL
    SELECT h.warehouse_id, d.item_id, 'OUT', -d.quantity, 'SO', h.so_id, d.so_detail_id, CAST(h.so_date AS TIMESTAMP)
    FROM w_sod d JOIN w_so h ON d.so_id = h.so_id WHERE h.status = 'SHIPPED'
    UNION ALL
    SELECT warehouse_id, item_id, change_type, delta_qty, ref_type, ref_id, log_id, logged_at
    FROM w_log WHERE change_type = 'ADJUST'
    UNION ALL
    SELECT warehouse_id, item_id, CASE WHEN kind = 'CUSTOMER' THEN 'IN' ELSE 'OUT' END, quantity,
           CASE WHEN kind = 'CUSTOMER' THEN 'RETURN_CUST' ELSE 'RETURN_SUPP' END, CAST(NULL AS BIGINT),
           return_id, returned_at
    FROM w_returns)""")


def _clip(src: str) -> list[tuple[str, str]]:
    """DuckDB recursive fold: reject a movement that would go below zero."""
    return [
        ("cm", f"""SELECT *, row_number() OVER (PARTITION BY warehouse_id, item_id ORDER BY logged_at, log_id) AS rn
                  FROM {src}"""),
        ("co", """SELECT k.warehouse_id, k.item_id, COALESCE(s.quantity, 0) AS q
                  FROM (SELECT DISTINCT warehouse_id, item_id FROM cm) k
                  LEFT JOIN w_stock s ON s.warehouse_id = k.warehouse_id AND s.item_id = k.item_id"""),
        ("cf(warehouse_id, item_id, rn, balance, accepted)", """
           SELECT warehouse_id, item_id, CAST(0 AS BIGINT), CAST(q AS BIGINT), CAST(NULL AS BOOLEAN) FROM co
           UNION ALL
           SELECT m.warehouse_id, m.item_id, m.rn,
                  CAST(CASE WHEN f.balance + m.signed_qty >= 0 THEN f.balance + m.signed_qty ELSE f.balance END AS BIGINT),
                  f.balance + m.signed_qty >= 0
           FROM cf f JOIN cm m ON m.warehouse_id = f.warehouse_id AND m.item_id = f.item_id AND m.rn = f.rn + 1"""),
    ]


_LOG_COLS = "m.log_id, m.warehouse_id, m.item_id, m.change_type, m.delta_qty, m.ref_type, m.ref_id, m.emp_id, m.logged_at, m.signed_qty"


@register("movements", W("w_po", "w_pod", "w_so", "w_sod", "w_log", "w_returns", extra=[_MOVES]) + """
SELECT * FROM w_moves""")
def q_movements(spark, d):
    t = T(spark, d)
    return ledger.movements(t.purchase_order, t.purchase_order_details, t.sales_order,
                            t.sales_order_details, t.transaction_log, t.returns)


@register("net_movements", W("w_po", "w_pod", "w_so", "w_sod", "w_log", "w_returns", extra=[_MOVES]) + """
SELECT warehouse_id, item_id, CAST(sum(signed_qty) AS BIGINT) AS net_qty, count(*) AS n_moves
FROM w_moves GROUP BY warehouse_id, item_id""")
def q_net_movements(spark, d):
    return ledger.net_movements(q_movements(spark, d))


@register("stock_from_ledger", W("w_log", extra=[_SIGNED]) + """
SELECT warehouse_id, item_id, CAST(sum(signed_qty) AS BIGINT) AS quantity, count(*) AS n_moves,
       max(logged_at) AS last_logged_at
FROM w_log_signed GROUP BY warehouse_id, item_id""")
def q_stock_from_ledger(spark, d):
    return ledger.stock_from_ledger(T(spark, d).transaction_log)


@register("ledger_drift", W("w_po", "w_pod", "w_so", "w_sod", "w_log", "w_returns", "w_stock", extra=[_MOVES]) + """
SELECT * FROM (
  SELECT COALESCE(s.warehouse_id, l.warehouse_id) AS warehouse_id, COALESCE(s.item_id, l.item_id) AS item_id,
         COALESCE(s.quantity, 0) AS stock_qty, COALESCE(l.q, 0) AS ledger_qty,
         COALESCE(s.quantity, 0) - COALESCE(l.q, 0) AS drift
  FROM w_stock s FULL OUTER JOIN
       (SELECT warehouse_id, item_id, CAST(sum(signed_qty) AS BIGINT) AS q FROM w_moves GROUP BY ALL) l
    ON s.warehouse_id = l.warehouse_id AND s.item_id = l.item_id)
WHERE drift <> 0""")
def q_ledger_drift(spark, d):
    t = T(spark, d)
    return ledger.ledger_drift(t.stock, q_movements(spark, d))


@register("running_balance", W("w_log", "w_po", "w_pod", "w_stock", extra=[_SIGNED]) + f"""
SELECT {_LOG_COLS},
       CAST(COALESCE(s.quantity, 0) + sum(m.signed_qty) OVER (
            PARTITION BY m.warehouse_id, m.item_id ORDER BY m.logged_at, m.log_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS balance
FROM w_log_signed m LEFT JOIN w_stock s ON s.warehouse_id = m.warehouse_id AND s.item_id = m.item_id""")
def q_running_balance(spark, d):
    t = T(spark, d)
    return ledger.running_balance(t.transaction_log, t.stock)


@register("clipped_balance", W("w_log", "w_po", "w_pod", "w_stock", extra=[_SIGNED, *_clip("w_log_signed")]) + f"""
SELECT {_LOG_COLS}, f.balance, f.accepted
FROM cm m JOIN cf f ON f.warehouse_id = m.warehouse_id AND f.item_id = m.item_id AND f.rn = m.rn""")
def q_clipped_balance(spark, d):
    t = T(spark, d)
    return ledger.apply_movements(t.transaction_log, t.stock)


def _stock_after_sql(fold_rows: str) -> str:
    return f"""
, last AS (SELECT warehouse_id, item_id, arg_max(balance, rn) AS new_qty,
                  count(*) FILTER (WHERE accepted) AS n_applied, count(*) FILTER (WHERE NOT accepted) AS n_rejected
           FROM {fold_rows} WHERE rn > 0 GROUP BY warehouse_id, item_id)
SELECT COALESCE(s.warehouse_id, l.warehouse_id) AS warehouse_id, COALESCE(s.item_id, l.item_id) AS item_id,
       CAST(COALESCE(l.new_qty, s.quantity) AS BIGINT) AS quantity,
       COALESCE(l.n_applied, 0) AS n_applied, COALESCE(l.n_rejected, 0) AS n_rejected
FROM w_stock s FULL OUTER JOIN last l ON s.warehouse_id = l.warehouse_id AND s.item_id = l.item_id"""


@register("adjust_result", W("w_log", "w_po", "w_pod", "w_stock", extra=[
    ("w_adj", "SELECT *, delta_qty AS signed_qty FROM w_log WHERE change_type = 'ADJUST'"),
    *_clip("w_adj")]) + _stock_after_sql("cf"))
def q_adjust_result(spark, d):
    """WF13: manual signed adjustments applied with the non-negative rule."""
    from stockflow.operators.orders import adjust_stock
    t = T(spark, d)
    adj = t.transaction_log.where(F.col("change_type") == "ADJUST").select(
        F.col("log_id").alias("adj_id"), "warehouse_id", "item_id", F.col("delta_qty").alias("delta"),
        "emp_id", F.lit("cycle count").alias("reason"), F.col("logged_at").alias("adjusted_at"))
    return adjust_stock(t.stock, adj)["stock"]


@register("returns_result", W("w_returns", "w_po", "w_pod", "w_stock", extra=[
    ("w_ret", """SELECT return_id AS log_id, warehouse_id, item_id, returned_at AS logged_at,
                        CASE WHEN kind = 'CUSTOMER' THEN quantity ELSE -quantity END AS signed_qty FROM w_returns"""),
    *_clip("w_ret")]) + _stock_after_sql("cf"))
def q_returns_result(spark, d):
    """WF14: customer returns IN, supplier returns OUT; an OUT never drives
    stock negative (and never creates a negative row)."""
    from stockflow.operators.orders import process_returns
    t = T(spark, d)
    return process_returns(t.stock, t.returns)["stock"]


@register("upsert_stock", W("w_log", "w_po", "w_pod", "w_stock", extra=[_SIGNED]) + """
SELECT COALESCE(s.warehouse_id, d.warehouse_id) AS warehouse_id, COALESCE(s.item_id, d.item_id) AS item_id,
       CAST(COALESCE(s.quantity, 0) + COALESCE(d.q, 0) AS BIGINT) AS quantity
FROM w_stock s FULL OUTER JOIN
     (SELECT warehouse_id, item_id, sum(signed_qty) AS q FROM w_log_signed GROUP BY ALL) d
  ON s.warehouse_id = d.warehouse_id AND s.item_id = d.item_id""")
def q_upsert_stock(spark, d):
    from stockflow.sources.sinks import upsert_stock
    t = T(spark, d)
    deltas = ledger.with_signed(t.transaction_log).select("warehouse_id", "item_id", F.col("signed_qty").alias("delta"))
    return upsert_stock(t.stock, deltas).select("warehouse_id", "item_id", "quantity")


# ---------------------------------------------------------------- alerts
from stockflow.operators import alerts as alerts_op  # noqa: E402

NEW_ALERT_ID_OFFSET = 1_000_000_000


_FOLD_OBS = f"""SELECT m.warehouse_id, m.item_id, f.balance AS q, i.reorder_level AS lvl, m.logged_at AS ts,
                           m.log_id + {NEW_ALERT_ID_OFFSET} AS nid,
                           row_number() OVER (PARTITION BY m.warehouse_id, m.item_id ORDER BY m.logged_at, m.log_id) AS orn
                    FROM cm m JOIN cf f ON f.warehouse_id = m.warehouse_id AND f.item_id = m.item_id AND f.rn = m.rn
                    JOIN w_item i ON i.item_id = m.item_id
                    WHERE f.accepted"""


def _alert_sim(initial_sql: str, before: list | None = None, obs: str = _FOLD_OBS) -> list[tuple[str, str]]:
    """DuckDB oracle: the stock trigger simulated observation by observation. ``obs`` lists the
    observations, by default those of the clipped ledger; ``before`` are the tables it reads."""
    slot = ("{{'alert_id': {i}, 'current_quantity': {q}, 'reorder_level': {l}, "
            "'expected_quantity': {e}, 'alert_date': {d}}}")
    o_newer = ("(s.o IS NOT NULL AND (s.a IS NULL OR s.o.alert_date > s.a.alert_date OR "
               "(s.o.alert_date = s.a.alert_date AND s.o.alert_id > s.a.alert_id)))")
    low = "(m.q < m.lvl)"

    def pick(status):
        return (f"(SELECT {slot.format(i='alert_id', q='current_quantity', l='reorder_level', e='expected_quantity', d='alert_date')} "
                f"FROM a0 WHERE a0.warehouse_id = k.warehouse_id AND a0.item_id = k.item_id AND a0.status = '{status}')")

    def resolved_from(x):
        return slot.format(i=f"s.{x}.alert_id", q="m.q", l=f"s.{x}.reorder_level",
                           e=f"s.{x}.expected_quantity", d=f"s.{x}.alert_date")

    step = f"""
      SELECT k.warehouse_id, k.item_id, CAST(0 AS BIGINT), {pick('OPEN')}, {pick('ACK')}, {pick('RESOLVED')} FROM k0 k
      UNION ALL
      SELECT s.warehouse_id, s.item_id, s.rn + 1,
        CASE WHEN {low} AND s.o IS NULL AND s.a IS NULL
               THEN {slot.format(i='m.nid', q='m.q', l='m.lvl', e='CAST(NULL AS BIGINT)', d='m.ts')}
             WHEN NOT {low} AND (s.r IS NOT NULL OR {o_newer}) THEN NULL
             ELSE s.o END,
        CASE WHEN NOT {low} AND (s.r IS NOT NULL OR (s.a IS NOT NULL AND NOT {o_newer})) THEN NULL
             ELSE s.a END,
        CASE WHEN NOT {low} AND s.r IS NULL AND {o_newer} THEN {resolved_from('o')}
             WHEN NOT {low} AND s.r IS NULL AND s.a IS NOT NULL THEN {resolved_from('a')}
             ELSE s.r END
      FROM st s JOIN obs m ON m.warehouse_id = s.warehouse_id AND m.item_id = s.item_id AND m.orn = s.rn + 1"""
    return [
        *([_SIGNED, *_clip("w_log_signed")] if before is None else before),
        ("obs", obs),
        ("a0", initial_sql),
        ("k0", "SELECT warehouse_id, item_id FROM obs UNION SELECT warehouse_id, item_id FROM a0"),
        ("st(warehouse_id, item_id, rn, o, a, r)", step),
        ("fin", "SELECT * FROM st QUALIFY rn = max(rn) OVER (PARTITION BY warehouse_id, item_id)"),
    ]


_ALERT_OUT = """
SELECT x.alert_id, warehouse_id, item_id, x.current_quantity, x.reorder_level, x.expected_quantity, x.alert_date, status
FROM (SELECT warehouse_id, item_id, o AS x, 'OPEN' AS status FROM fin WHERE o IS NOT NULL
      UNION ALL SELECT warehouse_id, item_id, a, 'ACK' FROM fin WHERE a IS NOT NULL
      UNION ALL SELECT warehouse_id, item_id, r, 'RESOLVED' FROM fin WHERE r IS NOT NULL)"""


def _alerts(spark, d, initial):
    t = T(spark, d)
    applied = ledger.apply_movements(alerts_op.with_levels(t.transaction_log, t.item), t.stock)
    obs = alerts_op.observations(applied, id_offset=NEW_ALERT_ID_OFFSET)
    return alerts_op.maintain_alerts(initial(t), obs, in_order=True)


@register("alerts_final", W("w_log", "w_po", "w_pod", "w_stock", "w_item", "w_alerts0", extra=_alert_sim(
    "SELECT * FROM w_alerts0 WHERE false")) + _ALERT_OUT)
def q_alerts_final(spark, d):
    """WN4: alerts produced by the ledger's applied movements from an empty alert table."""
    return _alerts(spark, d, lambda t: t.reorder_alerts.where(F.lit(False)))


@register("alerts_with_history", W("w_log", "w_po", "w_pod", "w_stock", "w_item", "w_alerts0",
                                   extra=_alert_sim("SELECT * FROM w_alerts0")) + _ALERT_OUT)
def q_alerts_with_history(spark, d):
    """WF15: alert maintenance over existing OPEN/ACK/RESOLVED alerts."""
    return _alerts(spark, d, lambda t: t.reorder_alerts)


@register("latest_alert_per_key", W("w_log", "w_item", "w_alerts0") + """
SELECT warehouse_id, item_id, arg_max(alert_id, (alert_date, alert_id)) AS alert_id,
       arg_max(current_quantity, (alert_date, alert_id)) AS current_quantity,
       arg_max(reorder_level, (alert_date, alert_id)) AS reorder_level,
       arg_max(expected_quantity, (alert_date, alert_id)) AS expected_quantity,
       max(alert_date) AS alert_date,
       arg_max(status, (alert_date, alert_id)) AS status
FROM w_alerts0 WHERE status IN ('OPEN', 'ACK') GROUP BY warehouse_id, item_id""")
def q_latest_alert(spark, d):
    """WN1: the newest OPEN/ACK alert per key (the row the trigger would resolve)."""
    a = T(spark, d).reorder_alerts.where(F.col("status").isin("OPEN", "ACK"))
    return alerts_op.latest_per_key(a, ["warehouse_id", "item_id"], ["alert_date", "alert_id"])


# ---------------------------------------------------------------- order workflows
from stockflow.functions import scalars as sc  # noqa: E402
from stockflow.operators import orders  # noqa: E402


@register("receive_stock", W("w_po", "w_pod", "w_stock") + """
SELECT COALESCE(s.warehouse_id, d.warehouse_id) AS warehouse_id, COALESCE(s.item_id, d.item_id) AS item_id,
       CAST(COALESCE(s.quantity, 0) + COALESCE(d.q, 0) AS BIGINT) AS quantity
FROM w_stock s FULL OUTER JOIN
     (SELECT h.warehouse_id, l.item_id, sum(l.quantity) AS q
      FROM w_pod l JOIN w_po h ON h.po_id = l.po_id
      WHERE h.status IN ('CREATED', 'APPROVED', 'PARTIAL') GROUP BY ALL) d
  ON s.warehouse_id = d.warehouse_id AND s.item_id = d.item_id""")
def q_receive_stock(spark, d):
    """WF10: every purchase order requested; receivable ones add their lines."""
    t = T(spark, d)
    r = orders.receive_pos(t.purchase_order, t.purchase_order_details, t.stock,
                           t.purchase_order.select("po_id"), as_of="2026-01-01 00:00:00")
    return r["stock"].select("warehouse_id", "item_id", "quantity")


@register("receive_rejects", W("w_po", "w_pod") + """
SELECT po_id, CASE WHEN status NOT IN ('CREATED', 'APPROVED', 'PARTIAL') THEN 'BAD_STATUS:' || status
                   ELSE 'NO_LINES' END AS reason
FROM w_po h
WHERE status NOT IN ('CREATED', 'APPROVED', 'PARTIAL')
   OR NOT EXISTS (SELECT 1 FROM w_pod l WHERE l.po_id = h.po_id)""")
def q_receive_rejects(spark, d):
    t = T(spark, d)
    r = orders.receive_pos(t.purchase_order, t.purchase_order_details, t.stock, t.purchase_order.select("po_id"))
    return r["rejected"]


@register("receive_headers", W("w_po", "w_pod") + """
SELECT h.po_id,
       CASE WHEN h.status IN ('CREATED', 'APPROVED') THEN 'RECEIVED' ELSE h.status END AS status,
       CASE WHEN h.status IN ('CREATED', 'APPROVED')
            THEN CAST(COALESCE((SELECT sum(l.quantity * l.price) FROM w_pod l WHERE l.po_id = h.po_id), 0) AS DECIMAL(14,2))
            ELSE h.total_amount END AS total_amount
FROM w_po h""")
def q_receive_headers(spark, d):
    t = T(spark, d)
    r = orders.receive_pos(t.purchase_order, t.purchase_order_details, t.stock, t.purchase_order.select("po_id"))
    return r["po"].select("po_id", "status", "total_amount")


# One step for each order and warehouse: ``free`` is the stock left of the keys on which open orders compete.
_SHIP_STEPS = """,
gate AS (SELECT h.so_id, h.warehouse_id,
                CASE WHEN h.status NOT IN ('NEW', 'CONFIRMED') THEN 'BAD_STATUS:' || h.status
                     WHEN NOT EXISTS (SELECT 1 FROM w_sod d WHERE d.so_id = h.so_id) THEN 'NO_LINES' END AS reason
         FROM w_so h),
asked AS (SELECT g.so_id, g.warehouse_id, d.item_id, sum(d.quantity) AS q, coalesce(min(s.quantity), 0) AS free
          FROM gate g JOIN w_sod d USING (so_id) LEFT JOIN w_stock s ON s.warehouse_id = g.warehouse_id AND s.item_id = d.item_id
          WHERE g.reason IS NULL GROUP BY ALL),
hopeless AS (SELECT DISTINCT so_id FROM asked WHERE q > free),
open_ AS (SELECT * FROM asked WHERE so_id NOT IN (SELECT so_id FROM hopeless)),
slot AS (SELECT warehouse_id, item_id, min(free) AS free, row_number() OVER (PARTITION BY warehouse_id ORDER BY item_id) AS i
         FROM open_ GROUP BY warehouse_id, item_id HAVING sum(q) > min(free)),
step AS (SELECT o.warehouse_id, o.so_id, list(i) FILTER (i IS NOT NULL) AS at_, list(q) FILTER (i IS NOT NULL) AS q,
                row_number() OVER (PARTITION BY o.warehouse_id ORDER BY o.so_id) AS n
         FROM open_ o LEFT JOIN slot s ON s.warehouse_id = o.warehouse_id AND s.item_id = o.item_id GROUP BY o.warehouse_id, o.so_id),
walk AS (SELECT warehouse_id, 0::BIGINT AS n, NULL::BIGINT AS so_id, NULL::BOOLEAN AS shipped,
                coalesce((SELECT list(free ORDER BY i) FROM slot s WHERE s.warehouse_id = w.warehouse_id), []) AS free
         FROM (SELECT DISTINCT warehouse_id FROM step) w
         UNION ALL
         SELECT w.warehouse_id, s.n, s.so_id, fits,
                CASE WHEN fits THEN list_transform(w.free, lambda x, i: x - coalesce(s.q[list_position(s.at_, i)], 0)) ELSE w.free END
         FROM walk w JOIN step s ON s.warehouse_id = w.warehouse_id AND s.n = w.n + 1,
              LATERAL (SELECT coalesce(list_bool_and(list_transform(s.at_, lambda a, k: w.free[a] >= s.q[k])), true) AS fits) f),
decided AS (SELECT so_id, shipped, CASE WHEN NOT shipped THEN 'INSUFFICIENT_STOCK' END AS reason FROM walk WHERE n > 0
            UNION ALL SELECT so_id, false, 'INSUFFICIENT_STOCK' FROM hopeless
            UNION ALL SELECT so_id, false, reason FROM gate WHERE reason IS NOT NULL)"""
_SHIP_SQL = W("w_so", "w_sod", "w_stock") + _SHIP_STEPS
AS_OF = "2026-01-01 00:00:00"


@register("ship_result", _SHIP_SQL + """
SELECT so_id, shipped, reason FROM decided""")
def q_ship_result(spark, d):
    """WF11: every sales order requested; shippable ones ship in so_id order
    when all their lines are available."""
    t = T(spark, d)
    return orders.ship_sos(t.sales_order, t.sales_order_details, t.stock)["decisions"]


_SHIPPED_STEPS = _SHIP_STEPS + """,
gone AS (SELECT h.so_id, h.warehouse_id, d.item_id, d.quantity, d.so_detail_id
         FROM decided x JOIN w_so h ON h.so_id = x.so_id JOIN w_sod d ON d.so_id = x.so_id WHERE x.shipped)"""
_SHIPPED_SQL = W("w_so", "w_sod", "w_stock") + _SHIPPED_STEPS


@register("ship_stock", _SHIPPED_SQL + """
SELECT s.warehouse_id, s.item_id, CAST(s.quantity - COALESCE(g.q, 0) AS BIGINT) AS quantity
FROM w_stock s LEFT JOIN (SELECT warehouse_id, item_id, sum(quantity) AS q FROM gone GROUP BY ALL) g
  ON g.warehouse_id = s.warehouse_id AND g.item_id = s.item_id""")
def q_ship_stock(spark, d):
    """WF11: stock after shipping every shippable order that fits."""
    t = T(spark, d)
    r = orders.ship_sos(t.sales_order, t.sales_order_details, t.stock, as_of=AS_OF)
    return r["stock"].select("warehouse_id", "item_id", "quantity")


@register("ship_unchecked", _SHIP_SQL + """
SELECT so_id, shipped, CASE WHEN reason <> 'INSUFFICIENT_STOCK' THEN reason
                            WHEN so_id IN (SELECT a.so_id FROM asked a LEFT JOIN w_stock s
                                             ON s.warehouse_id = a.warehouse_id AND s.item_id = a.item_id
                                           WHERE s.item_id IS NULL) THEN 'NO_STOCK_ROW'
                            WHEN reason IS NOT NULL THEN 'NEGATIVE_STOCK' END AS reason
FROM decided""")
def q_ship_unchecked(spark, d):
    """WF11 with the availability check off (D-8): orders touching a key with
    no stock row are rejected NO_STOCK_ROW, orders that would drive stock
    negative NEGATIVE_STOCK; the rest ship in so_id order."""
    t = T(spark, d)
    return orders.ship_sos(t.sales_order, t.sales_order_details, t.stock, check_stock=False)["decisions"]


@register("add_items", W("w_item", "w_item_intake") + """
SELECT staged_id,
       CASE WHEN name IS NULL OR length(trim(name)) = 0 THEN 'BLANK_NAME'
            WHEN lower(name) IN (SELECT lower(name) FROM w_item) THEN 'DUPLICATE_NAME'
            WHEN staged_id <> min(staged_id) OVER (PARTITION BY lower(name)) THEN 'DUPLICATE_IN_BATCH'
       END AS reason
FROM w_item_intake""")
def q_add_items(spark, d):
    """WF4: staged items (raw part names, which repeat) against the item master."""
    t = T(spark, d)
    r = orders.add_master(t.item, t.item_intake, "item_id", "staged_id", ["name"], "name",
                          {"unit_of_measure": "pcs"})
    return (r["accepted"].select("staged_id", F.lit(None).cast("string").alias("reason"))
            .unionByName(r["rejected"]))


@register("add_items_table", W("w_item", "w_item_intake") + """
SELECT name, category, COALESCE(unit_of_measure, 'pcs') AS unit_of_measure, price, reorder_level
FROM w_item
UNION ALL
SELECT name, category, 'pcs', price, reorder_level FROM w_item_intake
QUALIFY staged_id = min(staged_id) OVER (PARTITION BY lower(name))""")
def q_add_items_table(spark, d):
    """WF4 + SNK1: the item master after the intake (new ids follow the max)."""
    t = T(spark, d)
    r = orders.add_master(t.item, t.item_intake, "item_id", "staged_id", ["name"], "name",
                          {"unit_of_measure": "pcs"})
    return r["table"].select("name", "category", "unit_of_measure", "price", "reorder_level")


@register("create_pos", W("w_po_intake", "w_supplier", "w_warehouse") + """
SELECT staged_id,
       CASE WHEN supplier_id NOT IN (SELECT supplier_id FROM w_supplier) THEN 'UNKNOWN_SUPPLIER_ID'
            WHEN warehouse_id NOT IN (SELECT warehouse_id FROM w_warehouse) THEN 'UNKNOWN_WAREHOUSE_ID' END AS reason
FROM w_po_intake""")
def q_create_pos(spark, d):
    """WF5: staged purchase orders; unknown suppliers are rejected, the rest
    get status CREATED, total 0 and new ids."""
    t = T(spark, d)
    r = orders.create_orders(t.purchase_order, t.po_intake, "po_id", "staged_id",
                             {"supplier_id": t.supplier, "warehouse_id": t.warehouse}, "CREATED")
    acc = t.po_intake.join(r["rejected"], "staged_id", "left_anti").select(
        "staged_id", F.lit(None).cast("string").alias("reason"))
    return acc.unionByName(r["rejected"])


@register("create_pos_table", W("w_po", "w_po_intake", "w_supplier") + """
SELECT po_id, supplier_id, warehouse_id, po_date, status, total_amount FROM w_po
UNION ALL
SELECT (SELECT max(po_id) FROM w_po) + row_number() OVER (ORDER BY staged_id), supplier_id, warehouse_id, po_date,
       'CREATED', CAST(0 AS DECIMAL(14,2))
FROM w_po_intake WHERE supplier_id IN (SELECT supplier_id FROM w_supplier)""")
def q_create_pos_table(spark, d):
    """WF5 + SNK1: the purchase-order table after the intake."""
    t = T(spark, d)
    r = orders.create_orders(t.purchase_order, t.po_intake, "po_id", "staged_id",
                             {"supplier_id": t.supplier, "warehouse_id": t.warehouse}, "CREATED")
    return r["table"]


@register("add_so_lines", W("w_sod", "w_item", "w_sol_intake") + """
SELECT staged_id, so_id, item_id, price, reason FROM (
  SELECT x.*, CASE WHEN x.list IS NULL THEN 'UNKNOWN_ITEM' WHEN x.quantity <= 0 THEN 'BAD_QUANTITY'
                   WHEN x.dup THEN 'DUPLICATE_LINE'
                   WHEN x.staged_id <> min(x.staged_id) OVER (PARTITION BY x.so_id, x.item_id) THEN 'DUPLICATE_LINE' END AS reason
  FROM (SELECT s.staged_id, s.so_id, s.item_id, s.quantity, i.price AS list,
               CAST(COALESCE(s.price, i.price, 0) AS DECIMAL(12,2)) AS price,
               EXISTS (SELECT 1 FROM w_sod d WHERE d.so_id = s.so_id AND d.item_id = s.item_id) AS dup
        FROM w_sol_intake s LEFT JOIN w_item i ON i.item_id = s.item_id) x)""")
def q_add_so_lines(spark, d):
    """WF6: staged sales-order lines: price typed, else item price (D-16);
    duplicates of existing or earlier staged (order, item) pairs rejected."""
    t = T(spark, d)
    r = orders.add_lines(t.sales_order_details, t.so_line_intake, t.item, "so_id", "so_detail_id",
                         "staged_id", editable_price=True)
    acc = r["accepted"].select("staged_id", "so_id", "item_id", "price", F.lit(None).cast("string").alias("reason"))
    return acc.unionByName(r["rejected"].select("staged_id", "so_id", "item_id", "price", "reason"))


@register("update_line_qty", W("w_po", "w_pod") + """
, ch AS (SELECT d.po_id, d.item_id, d.quantity - 5 AS quantity FROM w_pod d JOIN w_po h ON h.po_id = d.po_id
         WHERE h.status = 'APPROVED'),
  nd AS (SELECT d.po_id, d.item_id, COALESCE(CASE WHEN c.quantity > 0 THEN c.quantity END, d.quantity) AS quantity, d.price
         FROM w_pod d LEFT JOIN ch c ON c.po_id = d.po_id AND c.item_id = d.item_id)
SELECT h.po_id,
       CASE WHEN h.po_id IN (SELECT po_id FROM ch WHERE quantity > 0)
            THEN CAST(COALESCE((SELECT sum(n.quantity * n.price) FROM nd n WHERE n.po_id = h.po_id), 0) AS DECIMAL(14,2))
            ELSE h.total_amount END AS total_amount,
       (SELECT CAST(sum(n.quantity) AS BIGINT) FROM nd n WHERE n.po_id = h.po_id) AS total_quantity
FROM w_po h""")
def q_update_line_qty(spark, d):
    """WF7: every line of an APPROVED purchase order reduced by 5 (results <= 0
    rejected); touched headers get refreshed totals."""
    t = T(spark, d)
    ch = (t.purchase_order_details.join(t.purchase_order.where(F.col("status") == "APPROVED").select("po_id"), "po_id")
          .select("po_id", "item_id", (F.col("quantity") - 5).alias("quantity")))
    r = orders.update_line_qty(t.purchase_order_details, ch, "po_id", t.purchase_order)
    qty = r["detail"].groupBy("po_id").agg(F.sum("quantity").cast("long").alias("total_quantity"))
    return r["header"].select("po_id", "total_amount").join(qty, "po_id", "left")


# Role labels and the roles they are stored as.
_ROLE_SQL = """COALESCE(CASE role_label WHEN 'Warehouse Manager' THEN 'manager' WHEN 'Receiver' THEN 'staff'
                  WHEN 'Picker' THEN 'picker' WHEN 'Admin' THEN 'admin' WHEN 'Clerk' THEN 'staff'
                  WHEN 'Auditor' THEN 'staff' WHEN 'Supervisor' THEN 'staff' END, 'staff')"""


@register("add_employees", W("w_employee_intake", "w_warehouse") + """
SELECT emp_id AS staged_id,
       """ + _ROLE_SQL + """ AS role,
       CASE WHEN name IS NULL OR length(trim(name)) = 0 THEN 'BLANK_NAME'
            WHEN NOT COALESCE(regexp_full_match(trim(contact), '[a-zA-Z0-9._%+-]+@gmail\\.com'), false) THEN 'BAD_CONTACT'
            WHEN warehouse_id IS NOT NULL AND warehouse_id NOT IN (SELECT warehouse_id FROM w_warehouse) THEN 'UNKNOWN_WAREHOUSE'
       END AS reason
FROM w_employee_intake""")
def q_add_employees(spark, d):
    """WF19: employee intake with Gmail contact, role mapping and warehouse check."""
    t = T(spark, d)
    staged = t.employee_intake.withColumnRenamed("emp_id", "staged_id")
    empty = t.employee.where(F.lit(False))
    r = orders.add_employees(empty, staged, t.warehouse)
    acc = r["accepted"].select("staged_id", "role", F.lit(None).cast("string").alias("reason"))
    rej = (r["rejected"].join(staged.select("staged_id", sc.map_role(F.col("role_label")).alias("role")), "staged_id"))
    return acc.unionByName(rej.select("staged_id", "role", "reason"))


@register("contact_backfill", W("w_supplier") + """
SELECT supplier_id, name,
       CASE WHEN contact IS NULL THEN COALESCE(NULLIF(phone, ''), NULLIF(email, ''), '') ELSE contact END AS contact
FROM w_supplier""")
def q_contact_backfill(spark, d):
    """WF20/SC2: supplier contacts filled by the later rule."""
    return orders.backfill_contact(T(spark, d).supplier).select("supplier_id", "name", "contact")


@register("gmail_filter", W("w_employee_intake") + """
SELECT emp_id, contact, COALESCE(regexp_full_match(trim(contact), '[a-zA-Z0-9._%+-]+@gmail\\.com'), false) AS valid_gmail,
       COALESCE(length(trim(name)) > 0, false) AS name_ok
FROM w_employee_intake""")
def q_gmail_filter(spark, d):
    """SC6/SC7: Gmail and non-blank checks on staged employees."""
    return orders.employee_checks(T(spark, d).employee_intake).select("emp_id", "contact", "valid_gmail", "name_ok")


@register("role_mapping", W("w_employee_intake") + """
SELECT emp_id, role_label,
       """ + _ROLE_SQL + """ AS role
FROM w_employee_intake""")
def q_role_mapping(spark, d):
    """SC8: UI role label -> stored role."""
    return orders.employee_checks(T(spark, d).employee_intake).select("emp_id", "role_label", "role")


@register("choice_parse", W("w_item") + """
SELECT item_id, CAST(item_id AS VARCHAR) || ' - ' || name AS choice, item_id AS parsed_id FROM w_item""")
def q_choice_parse(spark, d):
    """SC9: compose 'id - name' choices and parse the id back."""
    it = T(spark, d).item.select("item_id", sc.compose_choice(F.col("item_id"), F.col("name")).alias("choice"))
    return it.select("item_id", "choice", sc.parse_choice("choice").alias("parsed_id"))


@register("digest", W("w_employee") + """
SELECT emp_id, sha256(name) AS name_digest FROM w_employee""")
def q_digest(spark, d):
    """SC11: SHA-256 hex digests."""
    return T(spark, d).employee.select("emp_id", sc.sha256_hex(F.col("name")).alias("name_digest"))


@register("amount_text", W("w_po", "w_pod") + """
SELECT h.po_id, printf('%.2f', CAST(COALESCE(sum(d.quantity * d.price), 0) AS DECIMAL(18,2))) AS po_total_text
FROM w_po h LEFT JOIN w_pod d ON d.po_id = h.po_id GROUP BY h.po_id""")
def q_amount_text(spark, d):
    """SC10: two-decimal text of exact order totals."""
    t = T(spark, d)
    return totals.po_totals(t.purchase_order, t.purchase_order_details).select(
        "po_id", sc.format_amount(F.col("po_total")).alias("po_total_text"))


# ---------------------------------------------------------------- data quality
from stockflow.operators import quality  # noqa: E402
from stockflow.schemas import (CHECKS, COLLATED_KEYS, DOMAINS, FOREIGN_KEYS, LEDGER_REF_TYPES_DECLARED,  # noqa: E402
                               MAX_LENGTHS, NOT_NULL, UNIQUE_KEYS)


@register("unique_violations", W("w_item_intake") + """
SELECT lower(name) AS name, count(*) AS n_rows FROM w_item_intake WHERE name IS NOT NULL
GROUP BY lower(name) HAVING count(*) > 1""")
def q_unique_violations(spark, d):
    """DQ1: staged item names that collide (case/accent-insensitive)."""
    return quality.unique_violations(T(spark, d).item_intake, ["name"], collate=("name",))


@register("unique_violations_lines", W("w_item") + """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q_unique_violations_lines(spark, d):
    """DQ1 on the raw order lines: (order, line number) is not a key."""
    li = T(spark, d).raw("lineitem")
    return quality.unique_violations(li, ["l_orderkey", "l_linenumber"])


# Declared table -> its CTE in the oracle SQL.
_CTE = {"warehouse": "w_warehouse", "employee": "w_employee", "item": "w_item", "customer": "w_customer",
        "supplier": "w_supplier", "stock": "w_stock", "transaction_log": "w_log", "reorder_alerts": "w_alerts0",
        "purchase_order": "w_po", "purchase_order_details": "w_pod", "sales_order": "w_so",
        "sales_order_details": "w_sod"}


def _tables(spark, d) -> dict[str, DataFrame]:
    t = T(spark, d)
    return {n: getattr(t, n) for n in _CTE}


def _orphans(child: str, cte: str, fk: str, parent: str, pk: str) -> str:
    return (f"SELECT '{child}' AS child, '{fk}' AS fk, CAST(c.{fk} AS BIGINT) AS fk_value, count(*) AS n_rows FROM {cte} c "
            f"WHERE c.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{fk}) GROUP BY c.{fk}")


@register("fk_orphans", W("w_po_intake", *_CTE.values()) + " UNION ALL ".join(
    [_orphans("po_intake", "w_po_intake", "supplier_id", "w_supplier", "supplier_id")]
    + [_orphans(c, _CTE[c], f[0], _CTE[p], k[0]) for c, f, p, k, _ in FOREIGN_KEYS if f[0] != "manager_id"]))
def q_fk_orphans(spark, d):
    """DQ2: orphans of all declared foreign keys, and of staged purchase
    orders (no stand-in warehouse has a manager, so that link has none)."""
    v = quality.fk_violations(T(spark, d).po_intake, T(spark, d).supplier, ["supplier_id"])
    staged = v.groupBy(F.col("supplier_id").cast("long").alias("fk_value")).agg(F.count("*").alias("n_rows")).select(
        F.lit("po_intake").alias("child"), F.lit("supplier_id").alias("fk"), "fk_value", "n_rows")
    return quality.fk_audit(_tables(spark, d)).unionByName(staged)


def _broken(tbl: str, kind: str, rule: str, holds: str) -> str:
    return (f"SELECT '{tbl}' AS tbl, '{kind}' AS kind, '{rule}' AS rule, count(*) AS n_rows FROM {_CTE[tbl]} "
            f"WHERE NOT ({holds}) HAVING count(*) > 0")


# Columns the oracle's stand-in tables do not spell out; the Spark ones hold nothing that breaks a rule there.
_PLAIN = {"warehouse": {"warehouse_id", "name"}, "customer": {"customer_id", "name"}}


def _row_rules() -> list[str]:
    out = []
    for t in _CTE:
        seen = lambda c, t=t: c in _PLAIN.get(t, {c})
        out += [_broken(t, "not null", c, f"{c} IS NOT NULL") for c in NOT_NULL[t] if seen(c)]
        out += [_broken(t, "check", n, f"coalesce({e}, true)") for n, e in CHECKS.get(t, {}).items() if t != "warehouse"]
        out += [_broken(t, "domain", c, f"coalesce({c} IN {v}, true)") for (n, c), v in DOMAINS.items() if n == t]
        out += [_broken(t, "length", c, f"coalesce(length({c}) <= {n}, true)") for c, n in MAX_LENGTHS.get(t, {}).items()
                if seen(c) and (t, c) != ("supplier", "address")]
    return out


@register("row_audit", W("w_returns", *_CTE.values(), extra=[("w_early", "SELECT * FROM w_supplier")])
          + " UNION ALL ".join(_row_rules() + [
              "SELECT 'staged_supplier', 'not null', 'contact', count(*) FROM w_early WHERE contact IS NULL HAVING count(*) > 0"]))
def q_row_audit(spark, d):
    """DQ3-DQ5, DQ7: all declared row rules of all tables, and supplier.contact
    as NOT NULL before its backfill."""
    t = T(spark, d)
    early = (quality.null_violations(t.supplier, ["contact"]).groupBy("column").agg(F.count("*").alias("n_rows"))
             .select(F.lit("staged_supplier").alias("tbl"), F.lit("not null").alias("kind"), F.col("column").alias("rule"), "n_rows"))
    return quality.row_audit(_tables(spark, d)).unionByName(early)


@register("unique_audit", W(*_CTE.values()) + " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, '{','.join(k)}' AS rule, count(*) AS n_rows FROM (SELECT 1 FROM {_CTE[t]} GROUP BY "
    + ", ".join(f"lower({c})" if (t, c) in COLLATED_KEYS else c for c in k)
    + " HAVING count(*) > 1 AND " + " AND ".join(f"count({c}) = count(*)" for c in k) + ") x HAVING count(*) > 0"
    for t, ks in UNIQUE_KEYS.items() for k in ks if k != ("email",)))
def q_unique_audit(spark, d):
    """DQ1: all declared unique keys (stand-in customers have no e-mail twice)."""
    return quality.unique_audit(_tables(spark, d))


@register("null_violations", W("w_supplier") + """
SELECT supplier_id, 'contact' AS "column" FROM w_supplier WHERE contact IS NULL""")
def q_null_violations(spark, d):
    """DQ3: supplier.contact made NOT NULL before the backfill."""
    return quality.null_violations(T(spark, d).supplier, ["contact"]).select("supplier_id", "column")


@register("check_violations", W("w_log", "w_po", "w_pod", "w_stock", extra=[_SIGNED]) + """
SELECT * FROM (
  SELECT COALESCE(s.warehouse_id, d.warehouse_id) AS warehouse_id, COALESCE(s.item_id, d.item_id) AS item_id,
         CAST(COALESCE(s.quantity, 0) + COALESCE(d.q, 0) AS BIGINT) AS quantity, 'ck_stock_nonneg' AS rule
  FROM w_stock s FULL OUTER JOIN
       (SELECT warehouse_id, item_id, sum(signed_qty) AS q FROM w_log_signed GROUP BY ALL) d
    ON s.warehouse_id = d.warehouse_id AND s.item_id = d.item_id)
WHERE quantity < 0""")
def q_check_violations(spark, d):
    """DQ4: the unchecked upsert of every ledger delta breaks quantity >= 0."""
    new_stock = q_upsert_stock(spark, d)
    return (quality.check_violations(new_stock, CHECKS["stock"])
            .select("warehouse_id", "item_id", "quantity", "rule"))


@register("domain_violations", W("w_po", "w_pod", "w_so", "w_sod", "w_log", "w_returns", extra=[_MOVES]) + """
SELECT ref_type, count(*) AS n_rows FROM w_moves
WHERE ref_type NOT IN ('PO', 'SO', 'MANUAL') GROUP BY ref_type""")
def q_domain_violations(spark, d):
    """DQ5: ledger ref types outside the originally declared domain (D-2)."""
    m = q_movements(spark, d)
    return (quality.domain_violations(m, "ref_type", LEDGER_REF_TYPES_DECLARED)
            .groupBy("ref_type").agg(F.count("*").alias("n_rows")))


@register("status_domain", W("w_po", "w_so") + """
SELECT 'purchase_order' AS tbl, count(*) FILTER (WHERE status NOT IN ('CREATED','APPROVED','RECEIVED','CANCELLED')) AS n_bad FROM w_po
UNION ALL
SELECT 'sales_order', count(*) FILTER (WHERE status NOT IN ('NEW','CONFIRMED','SHIPPED','CANCELLED')) FROM w_so""")
def q_status_domain(spark, d):
    """DQ5: header statuses inside their ENUM domains."""
    t = T(spark, d)
    po = quality.domain_violations(t.purchase_order, "status", DOMAINS[("purchase_order", "status")])
    so = quality.domain_violations(t.sales_order, "status", DOMAINS[("sales_order", "status")])
    return (po.agg(F.count("*").alias("n_bad")).select(F.lit("purchase_order").alias("tbl"), "n_bad")
            .unionByName(so.agg(F.count("*").alias("n_bad")).select(F.lit("sales_order").alias("tbl"), "n_bad")))


@register("delete_cascade", W("w_warehouse", "w_po", "w_so") + """
SELECT warehouse_id, blocked_by, n_refs FROM (
  SELECT warehouse_id, 'purchase_order' AS blocked_by, count(*) AS n_refs FROM w_po GROUP BY warehouse_id
  UNION ALL
  SELECT warehouse_id, 'sales_order', count(*) FROM w_so GROUP BY warehouse_id)
WHERE warehouse_id IN (SELECT warehouse_id FROM w_warehouse)""")
def q_delete_cascade(spark, d):
    """DQ6: deleting every warehouse; order headers RESTRICT it (stock would
    CASCADE and employees SET NULL had a warehouse been free)."""
    t = T(spark, d)
    r = quality.delete_with_rules(
        t.warehouse, "warehouse_id", t.warehouse.select("warehouse_id"),
        cascade={"stock": (t.stock, "warehouse_id")},
        set_null={"employee": (t.employee, "warehouse_id")},
        restrict={"purchase_order": (t.purchase_order, "warehouse_id"),
                  "sales_order": (t.sales_order, "warehouse_id")})
    return r["rejected"].select("warehouse_id", "blocked_by", "n_refs")


@register("delete_cancelled_sos", W("w_so", "w_sod") + """
SELECT d.so_detail_id, d.so_id, d.item_id FROM w_sod d
WHERE d.so_id NOT IN (SELECT so_id FROM w_so WHERE status = 'CANCELLED')""")
def q_delete_cancelled_sos(spark, d):
    """DQ6 CASCADE / SNK4: removing cancelled sales orders takes their lines."""
    t = T(spark, d)
    keys = t.sales_order.where(F.col("status") == "CANCELLED").select("so_id")
    r = quality.delete_with_rules(t.sales_order, "so_id", keys,
                                  cascade={"sales_order_details": (t.sales_order_details, "so_id")})
    return r["sales_order_details"].select("so_detail_id", "so_id", "item_id")


@register("delete_staff_set_null", W("w_employee", "w_log") + """
SELECT log_id, CASE WHEN emp_id IN (SELECT emp_id FROM w_employee WHERE role = 'staff') THEN NULL ELSE emp_id END AS emp_id
FROM w_log""")
def q_delete_staff(spark, d):
    """DQ6 SET NULL: removing staff employees nulls their ledger references."""
    t = T(spark, d)
    keys = t.employee.where(F.col("role") == "staff").select("emp_id")
    r = quality.delete_with_rules(t.employee, "emp_id", keys,
                                  set_null={"transaction_log": (t.transaction_log, "emp_id")})
    return r["transaction_log"].select("log_id", "emp_id")


@register("length_violations", W("w_item_intake") + """
SELECT staged_id, 'name' AS "column" FROM w_item_intake WHERE length(name) > 150
UNION ALL SELECT staged_id, 'category' FROM w_item_intake WHERE length(category) > 120""")
def q_length_violations(spark, d):
    """DQ7: declared string lengths on staged items."""
    return (quality.length_violations(T(spark, d).item_intake, MAX_LENGTHS["item"])
            .select("staged_id", "column"))


# ---------------------------------------------------------------- sinks / sources
from stockflow.sources import sinks, tables as src  # noqa: E402


@register("update_by_key", W("w_item", "w_sod") + """
SELECT i.item_id, COALESCE(m.p, i.price) AS price
FROM w_item i LEFT JOIN (SELECT item_id, max(price) AS p FROM w_sod GROUP BY item_id) m ON m.item_id = i.item_id""")
def q_update_by_key(spark, d):
    """SNK3: item prices set to the highest price they were sold at."""
    t = T(spark, d)
    ch = t.sales_order_details.groupBy("item_id").agg(F.max("price").alias("price"))
    return sinks.update_by_key(t.item, ch, ["item_id"], ["price"]).select("item_id", "price")


@register("delete_by_key", W("w_so", "w_sod") + """
SELECT so_detail_id FROM w_sod WHERE so_id NOT IN (SELECT so_id FROM w_so WHERE status = 'SHIPPED')""")
def q_delete_by_key(spark, d):
    """SNK4: delete the lines of shipped orders (keyed anti join)."""
    t = T(spark, d)
    keys = t.sales_order.where(F.col("status") == "SHIPPED").select("so_id")
    return sinks.delete_by_key(t.sales_order_details, keys, ["so_id"]).select("so_detail_id")


@register("delete_n_per_key", W("w_log", "w_item", "w_alerts0") + """
SELECT alert_id FROM w_alerts0
QUALIFY NOT (status IN ('OPEN', 'ACK')
             AND row_number() OVER (PARTITION BY warehouse_id, item_id, status IN ('OPEN', 'ACK')
                                    ORDER BY alert_date, alert_id) = 1)""")
def q_delete_n_per_key(spark, d):
    """SNK5: drop one OPEN/ACK alert per key, the oldest (ordered LIMIT 1)."""
    a = T(spark, d).reorder_alerts
    keys = a.where(F.col("status").isin("OPEN", "ACK")).select("warehouse_id", "item_id").distinct()
    target = a.where(F.col("status").isin("OPEN", "ACK"))
    kept = sinks.delete_n_per_key(target, keys, ["warehouse_id", "item_id"], 1, ["alert_date", "alert_id"])
    return kept.unionByName(a.where(~F.col("status").isin("OPEN", "ACK"))).select("alert_id")


@register("ensure_stock_rows", W("w_po", "w_pod", "w_stock", "w_so", "w_sod") + """
SELECT warehouse_id, item_id, quantity FROM w_stock
UNION ALL
SELECT DISTINCT h.warehouse_id, d.item_id, CAST(0 AS BIGINT) FROM w_sod d JOIN w_so h ON h.so_id = d.so_id
WHERE NOT EXISTS (SELECT 1 FROM w_stock s WHERE s.warehouse_id = h.warehouse_id AND s.item_id = d.item_id)""")
def q_ensure_stock_rows(spark, d):
    """SNK6: a zero stock row for every (warehouse, item) sold but never stocked."""
    t = T(spark, d)
    keys = t.sales_order_details.join(t.sales_order.select("so_id", "warehouse_id"), "so_id")
    return sinks.ensure_stock_rows(t.stock, keys).select("warehouse_id", "item_id", "quantity")


@register("with_default_column", W("w_employee") + """
SELECT emp_id, CAST(0 AS DECIMAL(12,2)) AS bonus FROM w_employee""")
def q_with_default_column(spark, d):
    """SNK8: ALTER TABLE ADD COLUMN with a default."""
    e = sinks.with_default_column(T(spark, d).employee, "bonus", "decimal(12,2)", 0)
    return e.select("emp_id", "bonus")


@register("sql_view", W("w_stock") + """
SELECT warehouse_id, count(*) AS n_items, CAST(sum(quantity) AS BIGINT) AS units FROM w_stock GROUP BY warehouse_id""")
def q_sql_view(spark, d):
    """SRC4: ad-hoc read-only SQL over the tables registered as views."""
    t = T(spark, d)
    return src.sql_view(spark, {"stock": t.stock},
                        "SELECT warehouse_id, count(*) AS n_items, CAST(sum(quantity) AS BIGINT) AS units "
                        "FROM stock GROUP BY warehouse_id")


@register("latest_orders", W("w_po") + """
SELECT po_id, supplier_id, warehouse_id, po_date, status, total_amount FROM w_po ORDER BY po_id DESC LIMIT 5""")
def q_latest_orders(spark, d):
    """SL2: the five newest purchase orders (top-k)."""
    return T(spark, d).purchase_order.orderBy(F.desc("po_id")).limit(5)


@register("sample_items", None)
def q_sample_items(spark, d):
    """SL5: the default 50-row look at the item table (LIMIT without order:
    which rows come back is unspecified, so only the count is checked)."""
    t = T(spark, d)
    return src.sql_view(spark, {"item": t.item}, "SELECT * FROM item LIMIT 50")


@register("row_counts", W("w_warehouse", "w_item", "w_customer", "w_supplier", "w_po", "w_pod", "w_so", "w_sod",
                          "w_stock", "w_log", "w_employee") + """
SELECT 'warehouse' AS table_name, count(*) AS row_count FROM w_warehouse
UNION ALL SELECT 'item', count(*) FROM w_item UNION ALL SELECT 'customer', count(*) FROM w_customer
UNION ALL SELECT 'supplier', count(*) FROM w_supplier UNION ALL SELECT 'purchase_order', count(*) FROM w_po
UNION ALL SELECT 'purchase_order_details', count(*) FROM w_pod UNION ALL SELECT 'sales_order', count(*) FROM w_so
UNION ALL SELECT 'sales_order_details', count(*) FROM w_sod UNION ALL SELECT 'stock', count(*) FROM w_stock
UNION ALL SELECT 'transaction_log', count(*) FROM w_log UNION ALL SELECT 'employee', count(*) FROM w_employee""")
def q_row_counts(spark, d):
    """AG6: row count of every logical table."""
    t = T(spark, d)
    names = ["warehouse", "item", "customer", "supplier", "purchase_order", "purchase_order_details",
             "sales_order", "sales_order_details", "stock", "transaction_log", "employee"]
    out = None
    for n in names:
        c = getattr(t, n).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        out = c if out is None else out.unionByName(c)
    return out


# ---------------------------------------------------------------- streaming
from stockflow.streaming import streams  # noqa: E402

STREAM_STEPS = 4


def _staged_ledger(spark, t, name, extra: DataFrame | None = None):
    log = t.transaction_log if extra is None else t.transaction_log.unionByName(extra)
    path = streams.scratch_path(spark, name)
    files = streams.stage_files(log, path, STREAM_STEPS, ["logged_at", "log_id"])
    return streams.read_stream(spark, path, log.schema, files)


@register("stream_stock", REGISTRY["upsert_stock"][1])
def q_stream_stock(spark, d):
    """ST1 + ST5: live net stock from the movement stream (micro-batches of
    time-ordered files), kept as versioned snapshots, applied to the opening stock."""
    t = T(spark, d)
    moves = _staged_ledger(spark, t, "st1-src")
    init = spark.createDataFrame([], "warehouse_id long, item_id long, net_qty long")
    sink = streams.aggregate_to_snapshots(streams.stream_stock(moves), KEY_COLS, init,
                                          streams.scratch_path(spark, "st1-out"))
    net = sink.current()
    j = t.stock.select(*KEY_COLS, "quantity").join(net, KEY_COLS, "full_outer")
    return j.select(*KEY_COLS, (F.coalesce("quantity", F.lit(0)) + F.coalesce("net_qty", F.lit(0)))
                    .cast("long").alias("quantity"))


KEY_COLS = ["warehouse_id", "item_id"]


@register("stream_totals", W("w_sod") + """
SELECT so_id, CAST(sum(quantity * price) AS DECIMAL(18,2)) AS so_total FROM w_sod GROUP BY so_id""")
def q_stream_totals(spark, d):
    """ST3: live order totals from a stream of sales-order lines."""
    t = T(spark, d)
    lines = t.sales_order_details
    path = streams.scratch_path(spark, "st3-src")
    files = streams.stage_files(lines, path, STREAM_STEPS, ["so_id", "item_id"])
    src_df = streams.read_stream(spark, path, lines.schema, files)
    init = spark.createDataFrame([], "so_id long, so_total decimal(18,2)")
    sink = streams.aggregate_to_snapshots(streams.stream_totals(src_df, "so_id", "so_total"), ["so_id"], init,
                                          streams.scratch_path(spark, "st3-out"))
    return sink.current()


@register("stream_monthly", REGISTRY["month_purchases"][1])
def q_stream_monthly(spark, d):
    """ST6: running monthly purchases; purchase lines stream in and meet the
    static order headers (stream-static join)."""
    t = T(spark, d)
    lines = t.purchase_order_details
    path = streams.scratch_path(spark, "st6-src")
    files = streams.stage_files(lines, path, STREAM_STEPS, ["po_id", "item_id"])
    src_df = streams.read_stream(spark, path, lines.schema, files)
    joined = src_df.join(t.purchase_order.select("po_id", "po_date"), "po_id")
    init = spark.createDataFrame([], "month string, total_purchases decimal(38,2)")
    sink = streams.aggregate_to_snapshots(streams.stream_monthly(joined, "po_date", "total_purchases"),
                                          ["month"], init, streams.scratch_path(spark, "st6-out"))
    return sink.current()


@register("stream_alerts", REGISTRY["alerts_with_history"][1])
def q_stream_alerts(spark, d):
    """ST2 + ST5: live stock and alerts; every micro-batch runs the clipped
    fold and alert maintenance on the previous snapshots."""
    t = T(spark, d)
    moves = _staged_ledger(spark, t, "st2-src")
    p = streams.InventoryPipeline(spark, streams.scratch_path(spark, "st2-out"), t.stock, t.reorder_alerts,
                                  t.item, NEW_ALERT_ID_OFFSET).run(moves)
    return p.alerts()


@register("stream_dedupe", REGISTRY["stock_from_ledger"][1])
def q_stream_dedupe(spark, d):
    """ST4: every tenth movement is delivered twice; deduplication within the
    watermark restores the ledger before it is summed."""
    t = T(spark, d)
    replays = t.transaction_log.where(F.col("log_id") % 10 == 0)
    moves = _staged_ledger(spark, t, "st4-src", replays)
    dd = streams.dedupe_movements(moves, "1 day")
    out = streams.scratch_path(spark, "st4-out")
    streams.run_available_now(dd.writeStream.format("parquet").option("path", out).outputMode("append"),
                              out + "_checkpoint")
    from stockflow.operators import ledger as _l
    return _l.stock_from_ledger(spark.read.schema(t.transaction_log.schema).parquet(out))


# ---------------------------------------------------------------- workflow outputs
@register("receive_log", W("w_po", "w_pod") + """
SELECT d.po_detail_id AS src_id, h.warehouse_id, d.item_id, 'IN' AS change_type, d.quantity AS delta_qty,
       'PO' AS ref_type, h.po_id AS ref_id, CAST(NULL AS BIGINT) AS emp_id,
       TIMESTAMP '2026-01-01 00:00:00' AS logged_at
FROM w_pod d JOIN w_po h ON h.po_id = d.po_id
WHERE h.status IN ('CREATED', 'APPROVED', 'PARTIAL')""")
def q_receive_log(spark, d):
    """WF10: one IN ledger row per received line."""
    t = T(spark, d)
    r = orders.receive_pos(t.purchase_order, t.purchase_order_details, t.stock,
                           t.purchase_order.select("po_id"), as_of="2026-01-01 00:00:00")
    return r["log"]


@register("adjust_rejects", W("w_log", "w_po", "w_pod", "w_stock", extra=[
    ("w_adj", "SELECT *, delta_qty AS signed_qty FROM w_log WHERE change_type = 'ADJUST'"),
    *_clip("w_adj")]) + """
SELECT m.log_id, m.warehouse_id, m.item_id, m.delta_qty, 'NEGATIVE_STOCK' AS reason
FROM cm m JOIN cf f ON f.warehouse_id = m.warehouse_id AND f.item_id = m.item_id AND f.rn = m.rn
WHERE NOT f.accepted""")
def q_adjust_rejects(spark, d):
    """WF13: adjustments refused because they would make stock negative."""
    from stockflow.operators.orders import adjust_stock
    t = T(spark, d)
    adj = t.transaction_log.where(F.col("change_type") == "ADJUST").select(
        F.col("log_id").alias("adj_id"), "warehouse_id", "item_id", F.col("delta_qty").alias("delta"),
        "emp_id", F.lit("cycle count").alias("reason"), F.col("logged_at").alias("adjusted_at"))
    return adjust_stock(t.stock, adj)["rejected"]


@register("returns_log", W("w_returns", "w_po", "w_pod", "w_stock", extra=[
    ("w_ret", """SELECT return_id AS log_id, warehouse_id, item_id, returned_at AS logged_at, kind, quantity,
                        CASE WHEN kind = 'CUSTOMER' THEN quantity ELSE -quantity END AS signed_qty FROM w_returns"""),
    *_clip("w_ret")]) + """
SELECT m.log_id, m.warehouse_id, m.item_id, CASE WHEN m.kind = 'CUSTOMER' THEN 'IN' ELSE 'OUT' END AS change_type,
       m.quantity AS delta_qty, CASE WHEN m.kind = 'CUSTOMER' THEN 'RETURN_CUST' ELSE 'RETURN_SUPP' END AS ref_type,
       m.logged_at
FROM cm m JOIN cf f ON f.warehouse_id = m.warehouse_id AND f.item_id = m.item_id AND f.rn = m.rn
WHERE f.accepted""")
def q_returns_log(spark, d):
    """WF14 + D-2: ledger rows of the returns that were applied."""
    from stockflow.operators.orders import process_returns
    t = T(spark, d)
    return process_returns(t.stock, t.returns)["log"]


_LEDGER_SQL = """SELECT log_id, warehouse_id, item_id, change_type, delta_qty, ref_type, ref_id, emp_id, logged_at FROM w_log
UNION ALL
SELECT (SELECT max(log_id) FROM w_log) + row_number() OVER (ORDER BY """


@register("receive_ledger", W("w_po", "w_pod", "w_log") + _LEDGER_SQL + """d.po_detail_id), h.warehouse_id, d.item_id, 'IN',
       d.quantity, 'PO', h.po_id, CAST(NULL AS BIGINT), TIMESTAMP '2026-01-01 00:00:00'
FROM w_pod d JOIN w_po h ON h.po_id = d.po_id
WHERE h.status IN ('CREATED', 'APPROVED', 'PARTIAL')""")
def q_receive_ledger(spark, d):
    """WF10: the ledger, in its declared schema, after receiving every open order."""
    t = T(spark, d)
    return orders.receive_pos(t.purchase_order, t.purchase_order_details, t.stock, t.purchase_order.select("po_id"),
                              as_of="2026-01-01 00:00:00", ledger_log=t.transaction_log)["ledger"]


@register("returns_ledger", W("w_returns", "w_po", "w_pod", "w_stock", "w_log", extra=[
    ("w_ret", """SELECT return_id AS log_id, warehouse_id, item_id, returned_at AS logged_at, kind, quantity,
                        CASE WHEN kind = 'CUSTOMER' THEN quantity ELSE -quantity END AS signed_qty FROM w_returns"""),
    *_clip("w_ret")]) + _LEDGER_SQL + """m.logged_at, m.log_id), m.warehouse_id, m.item_id,
       CASE WHEN m.kind = 'CUSTOMER' THEN 'IN' ELSE 'OUT' END, m.quantity,
       CASE WHEN m.kind = 'CUSTOMER' THEN 'RETURN_CUST' ELSE 'RETURN_SUPP' END, CAST(NULL AS BIGINT),
       CAST(NULL AS BIGINT), m.logged_at
FROM cm m JOIN cf f ON f.warehouse_id = m.warehouse_id AND f.item_id = m.item_id AND f.rn = m.rn
WHERE f.accepted""")
def q_returns_ledger(spark, d):
    """WF14: the ledger, in its declared schema, after the applied returns."""
    t = T(spark, d)
    return orders.process_returns(t.stock, t.returns, ledger_log=t.transaction_log)["ledger"]


@register("delete_warehouse_cascade", W("w_stock", "w_log", "w_alerts0") + """
SELECT 'stock' AS tbl, warehouse_id, count(*) AS n_rows FROM w_stock WHERE warehouse_id <> 3 GROUP BY warehouse_id
UNION ALL
SELECT 'transaction_log', warehouse_id, count(*) FROM w_log WHERE warehouse_id <> 3 GROUP BY warehouse_id
UNION ALL
SELECT 'reorder_alerts', warehouse_id, count(*) FROM w_alerts0 WHERE warehouse_id <> 3 GROUP BY warehouse_id""")
def q_delete_warehouse_cascade(spark, d):
    """DQ6: all orders of warehouse 3 are deleted first (their lines CASCADE),
    then every warehouse: only 3 is free of RESTRICT, and its stock, ledger
    and alerts go with it."""
    tables = _tables(spark, d)
    for name, key in (("purchase_order", "po_id"), ("sales_order", "so_id")):
        done = quality.delete_by_declared_rules(tables, name, tables[name].where("warehouse_id = 3").select(key))
        tables = {n: done[n] for n in tables}
    done = quality.delete_by_declared_rules(tables, "warehouse", tables["warehouse"].select("warehouse_id"))
    parts = [done[n].groupBy("warehouse_id").agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("tbl"), "warehouse_id", "n_rows")
             for n in ("stock", "transaction_log", "reorder_alerts")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


from stockflow import catalog_workflows  # noqa: E402,F401  the queries of later rounds
