"""The mergeable alert summary: any split gives the same positions, and the plan has one fold."""

import datetime as dt
import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockflow.operators import alerts, ledger

OBS = "warehouse_id long, item_id long, quantity long, logged_at timestamp, log_id long, reorder_level long, new_alert_id long"


def positions(quantities, level=5):
    low = [q < level for q in quantities]
    pick = lambda it: next(it, None)
    fl, fn = pick(k for k, x in enumerate(low) if x), pick(k for k, x in enumerate(low) if not x)
    fr = None if fl is None else pick(k for k, x in enumerate(low) if not x and k > fl)
    last = max((k for k, x in enumerate(low) if not x), default=-1)
    return fl, fn, fr, pick(k for k, x in enumerate(low) if x and k > last), low.count(False)


def batch(rows, pid):
    k, i, q, n = zip(*rows)
    return pa.RecordBatch.from_pydict({
        "warehouse_id": pa.array(k), "item_id": pa.array(i), "_pid": pa.array([pid] * len(rows)),
        "_low": pa.array([x < 5 for x in q]), "new_alert_id": pa.array(n), "quantity": pa.array(q),
        "reorder_level": pa.array([5] * len(rows)), "logged_at": pa.array(n)})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=12), min_size=1, max_size=4), st.integers(1, 7))
def test_any_batches_give_the_same_summary(keys, size):
    rows = [(1, i, q, n) for i, qs in enumerate(keys) for n, q in enumerate(qs)]
    batches = [batch(rows[k:k + size], 3) for k in range(0, len(rows), size)]
    out = [r for b in alerts._summarise(iter(batches)) for r in b.to_pylist()]
    assert [r["item_id"] for r in out] == list(range(len(keys)))
    got = [(*(r[f"{p}_alert_id"] for p in ("FL", "FN", "FR", "OA")), r["nN"]) for r in out]
    assert got == [positions(q) for q in keys]


def test_hot_key_over_many_chunks(spark):
    r = random.Random(3)
    keys = {1: [r.randrange(10) for _ in range(3000)], 2: [1] * 5, 3: [9], 4: [1] * 400 + [8] + [2] * 300}
    rows = [(1, i, q, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=n), n, 5, n) for i, qs in keys.items() for n, q in enumerate(qs)]
    r.shuffle(rows)
    got = alerts.history_positions(spark.createDataFrame(rows, OBS).repartition(5)).collect()
    at = lambda x: None if x is None else x["alert_id"]
    assert {x.item_id: (at(x.FL), at(x.FN), at(x.FR), at(x.OA), x.nN) for x in got} == {i: positions(q) for i, q in keys.items()}
    assert alerts.history_positions(spark.createDataFrame([], OBS)).count() == 0


def test_one_fold_and_no_join_back(spark, seed):
    """The plan from movements to alerts: one scan folds, one summarises, and the only join meets the old alerts."""
    moves = alerts.with_levels(seed["transaction_log"], seed["item"])
    obs = alerts.observations(ledger.apply_movements(moves, seed["stock"]))
    plan = alerts.maintain_alerts(seed["reorder_alerts"], obs, in_order=True)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("+- == Initial Plan")[0]
    assert plan.count("MapInArrow") == 2
    assert sum(plan.count(j) for j in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin")) == 1
    again = alerts.maintain_alerts(seed["reorder_alerts"], alerts.observations(
        ledger.apply_movements(seed["transaction_log"], seed["stock"]), seed["item"]))
    mine = alerts.maintain_alerts(seed["reorder_alerts"], obs, in_order=True)
    assert sorted(map(str, mine.collect())) == sorted(map(str, again.collect()))


def test_item_unknown_gives_no_observation(spark, seed):
    moves = seed["transaction_log"].withColumn("item_id", F.col("item_id") + 1000)
    assert alerts.observations(ledger.apply_movements(alerts.with_levels(moves, seed["item"]), None)).count() == 0
