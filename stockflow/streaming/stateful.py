"""ST2 as a stateful operator: live stock and reorder alerts with Spark's state store.

Each (warehouse, item) has a state of a few numbers: its balance, the time of
the last movement applied and at most three alerts (OPEN, ACK, RESOLVED). A
micro-batch's movements of a key are taken in (time, id) order; one that would
make the balance negative is rejected, one older than the state's time is late
and left out (counted), every other is one observation for the alert trigger.
A key's opening balance and alerts come from the static tables through a
stream-static join and count only while the key has no state.

Against ``InventoryPipeline`` (snapshots and the batch operators) the state
store saves reading and rewriting state, and checkpoints make it recoverable;
but a key's movements of one micro-batch are sorted in one task, so here the
batch size (``maxFilesPerTrigger``) must bound a key's share of a batch. Where a
single key can flood a batch, use ``InventoryPipeline``, whose fold splits a hot
key over chunks. Both give the same alerts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stockflow.functions.scalars import signed_qty
from stockflow.operators.alerts import ALERT_COLS
from stockflow.streaming.streams import SnapshotSink, run_available_now

KEY = ["warehouse_id", "item_id"]
STATE = "balance long, mark long, late long, alerts string"
OUT = ("warehouse_id long, item_id long, balance long, late long, alert_id long, current_quantity long, "
       "reorder_level long, expected_quantity long, alert_micros long, status string")


def observe(alerts: dict[str, list], quantity: int, level: int, new_id: int, at: int) -> None:
    """The stock trigger for one observation. ``alerts`` maps a status to
    [alert_id, quantity, level, expected quantity, time] and is changed in place."""
    live = [s for s in ("OPEN", "ACK") if s in alerts]
    if quantity < level:
        if not live:
            alerts["OPEN"] = [new_id, quantity, level, None, at]
    elif "RESOLVED" in alerts:
        for s in live:
            del alerts[s]
    elif live:
        newest = max(live, key=lambda s: (alerts[s][4], alerts[s][0]))
        alerts["RESOLVED"] = alerts.pop(newest)
        alerts["RESOLVED"][1] = quantity


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["at", "log_id"], kind="stable")
    if state.exists:
        balance, mark, late, held = state.get
    else:
        balance, mark, late, held = int(rows["opening"].iloc[0]), None, 0, rows["held"].iloc[0]
    alerts = json.loads(held)
    for at, signed, level, new_id in zip(rows["at"].tolist(), rows["signed"].tolist(), rows["level"].tolist(), rows["new_id"].tolist()):
        if mark is not None and at < mark:
            late += 1
            continue
        mark = at  # a rejected movement has been seen as well
        if balance + signed < 0:
            continue
        balance += signed
        if level >= 0:
            observe(alerts, balance, level, new_id, at)
    state.update((balance, mark, late, json.dumps(alerts)))
    found = [(*key, balance, late, *values, s) for s, values in alerts.items()] or [(*key, balance, late, *[None] * 5, None)]
    frame = pd.DataFrame(found, columns=[c.split()[0] for c in OUT.split(", ")])
    yield frame.astype({c.split()[0]: "Int64" for c in OUT.split(", ") if c.endswith("long")})


def stream_alerts_state(moves: DataFrame, stock: DataFrame, alerts: DataFrame, item: DataFrame, new_alert_id_offset: int = 0) -> DataFrame:
    """Update-mode stream of each changed key's balance and alerts (a row
    without status where it has none). An item without level, or one that is
    not known, moves stock and gives no observation."""
    slot = F.concat(F.lit('"'), F.col("status"), F.lit('": '), F.concat(F.lit("["), F.concat_ws(", ", *[
        F.coalesce(c.cast("string"), F.lit("null")) for c in (
            F.col("alert_id"), F.col("current_quantity"), F.col("reorder_level"), F.col("expected_quantity"),
            F.unix_micros("alert_date"))]), F.lit("]")))
    newest = F.max(F.struct(F.struct("alert_date", "alert_id").alias("o"), slot.alias("s")))  # one per status, as the unique key says
    held = (alerts.groupBy(*KEY, "status").agg(newest.alias("m")).groupBy(*KEY)
            .agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("m.s")), ", "), F.lit("}")).alias("held")))
    opening = stock.select(*KEY, F.col("quantity").alias("opening")).join(held, KEY, "full_outer")
    levels = item.select("item_id", F.col("reorder_level").alias("level"))
    rows = (moves.withColumn("signed", signed_qty()).join(opening, KEY, "left").join(levels, "item_id", "left")
            .select(*KEY, F.unix_micros("logged_at").alias("at"), "log_id", "signed",
                    F.coalesce("level", F.lit(-1)).cast("long").alias("level"),
                    F.coalesce("opening", F.lit(0)).cast("long").alias("opening"), F.coalesce("held", F.lit("{}")).alias("held"),
                    (F.col("log_id") + F.lit(new_alert_id_offset)).alias("new_id")))
    return rows.groupBy(*KEY).applyInPandasWithState(_advance, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def _replace(prev: DataFrame, batch: DataFrame, epoch: int) -> DataFrame:
    """A key's new alerts replace its old ones, also when it has none left."""
    rows = batch.where(F.col("status").isNotNull()).withColumn("alert_date", F.timestamp_micros("alert_micros"))
    return prev.join(batch.select(*KEY).distinct(), KEY, "left_anti").unionByName(rows.select(*prev.columns))


def run_alerts_state(moves: DataFrame, stock: DataFrame, alerts: DataFrame, item: DataFrame, base: str,
                     new_alert_id_offset: int = 0) -> DataFrame:
    """The alert table after everything available has streamed through the state, kept as snapshots in ``base``."""
    spark = moves.sparkSession
    sink = SnapshotSink(spark, base, _replace, alerts.select(*ALERT_COLS), KEY)
    changes = stream_alerts_state(moves, stock, alerts, item, new_alert_id_offset)
    run_available_now(changes.writeStream.outputMode("update").foreachBatch(sink), base + "/_checkpoint")
    return sink.current()
