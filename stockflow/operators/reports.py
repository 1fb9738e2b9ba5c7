"""Monthly purchases, sales and profit/loss (AG3-AG5, WF17).

All months are answered in one pass by grouping on the month start; a single
month is the same plan with a half-open date filter that reaches the scan.
Defaults follow the reference: no status filter, salaries 0 (D-12).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import in_month, line_total, month_key

REPORT_TOTAL = "decimal(38,2)"


def _monthly(header: DataFrame, detail: DataFrame, key: str, date_col: str, out: str,
             month: str | None, statuses=None) -> DataFrame:
    h = header.select(key, date_col, "status")
    if statuses is not None:
        h = h.where(F.col("status").isin(*statuses))
    if month is not None:
        h = h.where(in_month(date_col, month))
    if month is not None:
        # the month's headers first: only their lines are summed, once
        lines = detail.select(key, "quantity", "price").join(h.select(key), key)
        return lines.agg(F.coalesce(F.sum(line_total()), F.lit(0)).cast(REPORT_TOTAL).alias(out)) \
                    .select(F.lit(month).alias("month"), out)
    j = h.join(detail.groupBy(key).agg(F.sum(line_total()).alias("_s")), key)
    return (j.groupBy(month_key(date_col).alias("month"))
            .agg(F.sum("_s").cast(REPORT_TOTAL).alias(out)))


def monthly_purchases(po: DataFrame, pod: DataFrame, month: str | None = None, statuses=None) -> DataFrame:
    """AG3: purchase value per month (or for one 'YYYY-MM' month; empty -> 0)."""
    return _monthly(po, pod, "po_id", "po_date", "total_purchases", month, statuses)


def monthly_sales(so: DataFrame, sod: DataFrame, month: str | None = None, statuses=None) -> DataFrame:
    """AG4: sales value per month (or for one month)."""
    return _monthly(so, sod, "so_id", "so_date", "total_sales", month, statuses)


def monthly_pnl(po: DataFrame, pod: DataFrame, so: DataFrame, sod: DataFrame,
                month: str | None = None, salaries: DataFrame | float = 0,
                statuses: dict | None = None) -> DataFrame:
    """AG5: sales - purchases - salaries per month.

    ``salaries`` is a constant (the reference uses 0), a scalar Column (e.g.
    a payroll scalar subquery) or a DataFrame with ``month`` and ``salaries``.
    """
    st = statuses or {}
    zero = F.lit(0).cast(REPORT_TOTAL)
    p = monthly_purchases(po, pod, month, st.get("po")).withColumn("total_sales", F.lit(None).cast(REPORT_TOTAL))
    s = monthly_sales(so, sod, month, st.get("so")).withColumn("total_purchases", F.lit(None).cast(REPORT_TOTAL))
    # Union + group instead of a full outer join: no join at all, and the
    # single-month case never pairs two one-row sides on a constant key.
    j = (p.unionByName(s).groupBy("month")
         .agg(F.sum("total_purchases").alias("total_purchases"), F.sum("total_sales").alias("total_sales")))
    if isinstance(salaries, DataFrame):
        j = j.join(salaries.select("month", F.col("salaries").cast(REPORT_TOTAL)), "month", "left")
        sal = F.coalesce(F.col("salaries"), zero)
    elif isinstance(salaries, Column):
        sal = F.coalesce(salaries.cast(REPORT_TOTAL), zero)
    else:
        sal = F.lit(salaries).cast(REPORT_TOTAL)
    tp = F.coalesce(F.col("total_purchases"), zero).cast(REPORT_TOTAL)
    ts = F.coalesce(F.col("total_sales"), zero).cast(REPORT_TOTAL)
    return j.select("month", tp.alias("total_purchases"), ts.alias("total_sales"),
                    sal.alias("salaries"), (ts - tp - sal).cast(REPORT_TOTAL).alias("profit_loss"))


def month_po_list(po: DataFrame, month: str | None = None) -> DataFrame:
    """WF17: purchase orders of a month (all months when None, with the month)."""
    p = po if month is None else po.where(in_month("po_date", month))
    return p.select("po_id", "supplier_id", "warehouse_id", "po_date", "status",
                    month_key("po_date").alias("month"))


def month_so_list(so: DataFrame, month: str | None = None) -> DataFrame:
    """WF17: sales orders of a month."""
    s = so if month is None else so.where(in_month("so_date", month))
    return s.select("so_id", "customer_id", "warehouse_id", "so_date", "status",
                    month_key("so_date").alias("month"))


def monthly_report(po, pod, so, sod, month: str) -> dict[str, DataFrame]:
    """WF17: the three totals plus the two order lists of one month."""
    return {"pnl": monthly_pnl(po, pod, so, sod, month),
            "purchase_orders": month_po_list(po, month),
            "sales_orders": month_so_list(so, month)}
