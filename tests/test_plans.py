"""Plan-shape assertions: no cartesian products or nested-loop joins, no
row-at-a-time Python UDFs, scans prune columns and push filters, ledger-order
work never funnels into one partition."""

import contextlib
import io

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_no_row_udf(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p


@pytest.mark.parametrize("name", ["running_balance", "clipped_balance", "alerts_final",
                                  "alerts_with_history", "adjust_result", "returns_result"])
def test_ordered_ledger_work_is_not_single_partition(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "SinglePartition" not in p


def test_scan_pushdown_and_pruning(spark):
    p = plan(QUERIES["po_totals"](spark, SF))
    assert "EqualTo(l_linestatus,O)" in p
    lineitem_schemas = [ln for ln in p.splitlines() if "ReadSchema" in ln and "l_orderkey" in ln]
    assert lineitem_schemas and all("l_extendedprice" not in ln for ln in lineitem_schemas)


def test_one_month_sums_only_its_own_lines(spark, seed):
    """The month's headers are joined before the lines are summed, and summed once."""
    from stockflow.operators.reports import monthly_purchases
    df = monthly_purchases(seed["purchase_order"], seed["purchase_order_details"], "2025-10")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.index("Aggregate") < plan.index("Join")


def test_ordered_scans_stay_in_arrow(spark, seed):
    """No pandas between the range exchange and the result of an ordered scan."""
    from stockflow.operators.ledger import running_balance
    df = running_balance(seed["transaction_log"], seed["stock"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
