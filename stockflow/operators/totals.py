"""Order totals (AG1, AG2) and header-total maintenance (WF16, D-11).

Detail lines are pre-aggregated per order (partial + final hash aggregate)
before meeting the header, so the header join sees one row per order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import line_total
from stockflow.schemas import HEADER_TOTAL, ORDER_TOTAL


def line_sums(detail: DataFrame, key: str) -> DataFrame:
    return detail.groupBy(key).agg(F.sum(line_total()).alias("_sum"))


def order_totals(header: DataFrame, detail: DataFrame, key: str, out: str = "total") -> DataFrame:
    """Sum of quantity*price per header row; an order without lines totals 0.00."""
    return (header.select(key).join(line_sums(detail, key), key, "left")
            .select(key, F.coalesce(F.col("_sum"), F.lit(0)).cast(ORDER_TOTAL).alias(out)))


def po_totals(po: DataFrame, pod: DataFrame) -> DataFrame:
    """AG1: fn_po_total for every purchase order at once."""
    return order_totals(po, pod, "po_id", "po_total")


def so_totals(so: DataFrame, sod: DataFrame) -> DataFrame:
    """AG2: fn_so_total for every sales order at once."""
    return order_totals(so, sod, "so_id", "so_total")


def total_drift(header: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """D-11 audit: headers whose stored total differs from their lines."""
    t = order_totals(header, detail, key, "computed_total")
    return (header.select(key, F.col("total_amount").cast(ORDER_TOTAL).alias("stored_total"))
            .join(t, key)
            .where(F.col("stored_total") != F.col("computed_total"))
            .select(key, "stored_total", "computed_total",
                    (F.col("stored_total") - F.col("computed_total")).cast(ORDER_TOTAL).alias("drift")))


def refresh_totals(header: DataFrame, detail: DataFrame, key: str,
                   changed_keys: DataFrame | None = None) -> DataFrame:
    """WF16: rewrite ``total_amount`` from the lines, for changed orders only.

    ``changed_keys`` (one column ``key``) limits the work to orders whose lines
    changed -- the set-based form of the six detail triggers. Without it every
    header is refreshed.
    """
    d = detail if changed_keys is None else detail.join(changed_keys.select(key).distinct(), key, "left_semi")
    sums = line_sums(d, key)
    if changed_keys is not None:
        touched = changed_keys.select(key).distinct().withColumn("_touched", F.lit(True))
        sums = touched.join(sums, key, "left")
    else:
        sums = sums.withColumn("_touched", F.lit(True))
    cols = [c for c in header.columns]
    joined = header.join(sums, key, "left")
    new_total = F.when(F.col("_touched") | F.lit(changed_keys is None),
                       F.coalesce(F.col("_sum"), F.lit(0)).cast(HEADER_TOTAL)).otherwise(F.col("total_amount"))
    return joined.select(*[new_total.alias(c) if c == "total_amount" else F.col(c) for c in cols])
