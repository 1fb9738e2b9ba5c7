"""Reorder-alert life cycle (WN1, WN4, WF15).

The stock trigger, applied row by row to each (warehouse, item) in time order:

* low (``quantity < reorder_level``) and no OPEN/ACK alert -> insert OPEN;
* not low and a RESOLVED alert exists -> delete OPEN/ACK;
* not low, no RESOLVED -> the newest OPEN/ACK (by alert_date, alert_id)
  becomes RESOLVED with the new quantity.

It is a finite-state machine per key, and its final state depends only on a
handful of positions in each key's history, so no per-key fold is needed:

* ``FL`` first low observation, ``FN`` first not-low observation,
* ``FR`` first not-low observation that has a low one before it,
* ``OA`` first low observation after the last not-low one (null when the
  last observation is not low), ``nN`` number of not-low observations.

These are an associative summary: two stretches of a key's history, one after
the other, have the summary that their own summaries give. So every range chunk
summarises its keys in one scan, the summaries of a key that spans several
chunks are merged in chunk order, and no observation is joined back or leaves
its chunk. The result is joined with the existing alerts (at most one row per
status and key) on the key -- one row per key on both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stockflow.functions.scalars import is_low
from stockflow.plans.checkpoint import cut_lineage
from stockflow.plans.scan import PID, _flags, _group_starts, _key_at, range_chunks, with_partition_id

KEY = ["warehouse_id", "item_id"]
ALERT_COLS = ["alert_id", "warehouse_id", "item_id", "current_quantity", "reorder_level",
              "expected_quantity", "alert_date", "status"]
_SLOT = ["alert_id", "current_quantity", "reorder_level", "expected_quantity", "alert_date"]


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """WN1: the newest row per key (``ORDER BY order DESC LIMIT 1`` per key).

    A ``max_by`` aggregate: partial per map task, so a hot key is reduced
    before the shuffle (no window over a whole key group)."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
            .select(*keys, *[F.col("_r." + c).alias(c) for c in rest]))


def with_levels(moves: DataFrame, item: DataFrame) -> DataFrame:
    """Movements with their item's ``reorder_level``. Joined before the movements
    are applied, it travels through the fold, and the observations come out of
    it in key order, ready to be summarised where they lie."""
    return moves.join(item.select("item_id", "reorder_level"), "item_id", "left")


def with_all_levels(lines: DataFrame, item: DataFrame) -> DataFrame:
    """As ``with_levels``, for callers that join after the fold otherwise: a line
    stays one row and has the levels of every item row with its id, in
    ``reorder_levels``, so that an item id that repeats changes no balance."""
    levels = (item.where(F.col("item_id").isNotNull()).groupBy("item_id")
              .agg(F.sort_array(F.collect_list("reorder_level")).alias("reorder_levels")))
    return lines.join(levels, "item_id", "left")


def observations(applied: DataFrame, item: DataFrame | None = None, id_offset: int = 0) -> DataFrame:
    """Stock observations from applied movements (D-5: every applied movement
    of a known item emits one). ``new_alert_id`` is the id an alert opened here
    would get. ``item`` is not needed if the movements had their levels
    (``with_levels``, ``with_all_levels``); then the observations keep the order of the fold."""
    seen = applied.where(F.col("accepted"))
    if "reorder_levels" in applied.columns:
        seen = seen.withColumn("reorder_level", F.explode("reorder_levels"))
    elif "reorder_level" not in applied.columns:
        seen = seen.join(item.select("item_id", "reorder_level"), "item_id")
    return (seen.where(F.col("reorder_level").isNotNull())
            .select(*KEY, F.col("balance").alias("quantity"), "logged_at", "log_id", "reorder_level",
                    (F.col("log_id") + F.lit(id_offset)).alias("new_alert_id")))


_SEEN = {"alert_id": "new_alert_id", "current_quantity": "quantity", "reorder_level": "reorder_level", "alert_date": "logged_at"}
_PLACES = ("FL", "FN", "FR", "OA")


def _places(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each key of a sorted batch: its first low (FL), first not-low
    (FN), first not-low after the first low (FR) and first low after the last
    not-low observation (OA), and how many are not low (nN)."""
    n, low = batch.num_rows, _flags(batch, "_low")
    at, row = np.flatnonzero(_group_starts(batch, KEY)), np.arange(batch.num_rows)
    key = np.repeat(np.arange(len(at)), np.diff(np.append(at, n)))

    def first(which: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(np.where(which, row, n), at)

    fl, last_high = first(low), np.maximum.reduceat(np.where(low, -1, row), at)
    found = (fl, first(~low), first(~low & (row > fl[key])), first(low & (row > last_high[key])))
    columns = {c: batch.column(c).take(pa.array(at)) for c in (*KEY, PID)}
    for place, where in zip(_PLACES, found):
        pick = pa.array(np.where(where < n, where, 0), mask=where == n)  # null where there is none
        columns |= {f"{place}_{c}": batch.column(source).take(pick) for c, source in _SEEN.items()}
    columns["nN"] = pa.array(np.add.reduceat((~low).astype(np.int64), at))
    return pa.RecordBatch.from_pydict(columns)


def _merged(earlier: pa.RecordBatch, later: pa.RecordBatch) -> pa.RecordBatch:
    """The summary of two stretches of one key, the earlier first."""
    a, b = earlier.to_pylist()[0], later.to_pylist()[0]

    def place(row: dict, name: str) -> list | None:
        values = [row[f"{name}_{c}"] for c in _SEEN]
        return None if row[f"{name}_current_quantity"] is None else values

    both = {"FL": place(a, "FL") or place(b, "FL"), "FN": place(a, "FN") or place(b, "FN"),
            "FR": place(a, "FR") or place(b, "FN" if place(a, "FL") else "FR"),
            "OA": place(b, "OA") if b["nN"] else place(a, "OA") or place(b, "FL")}
    row = {c: b[c] for c in (*KEY, PID)} | {"nN": a["nN"] + b["nN"]}
    for name, values in both.items():
        row |= {f"{name}_{c}": v for c, v in zip(_SEEN, values or [None] * len(_SEEN))}
    return pa.RecordBatch.from_pylist([row], schema=later.schema)


def _summarise(batches):
    """One summary for each key of a chunk; only a key that goes on in the next batch is held."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        found = _places(batch)
        first, n = found.slice(0, 1), found.num_rows
        if held is not None:
            if _key_at(held, KEY, 0) == _key_at(first, KEY, 0):
                first = _merged(held, first)
            else:
                yield held
        held = first if n == 1 else found.slice(n - 1, 1)
        if n > 1:
            yield first
            yield found.slice(1, n - 2)
    if held is not None:
        yield held


def history_positions(obs: DataFrame, order: list[str] | None = None, in_order: bool = False) -> DataFrame:
    """Per key: FL, FN, FR, OA (as alert-slot structs) and nN, in one pass.

    The five are an associative summary of a stretch of observations. Each
    range chunk summarises its keys in one scan; a key has one summary for each
    chunk that it spans (a hot key spans many, and none of its rows leaves its
    chunk), and these are merged in chunk order. ``in_order`` says that ``obs``
    comes straight from a fold, sorted in chunks by (key, order); otherwise it
    is dealt into chunks first.
    """
    order = order or ["logged_at", "log_id"]
    chunks = obs if in_order else cut_lineage(range_chunks(obs, KEY, order))
    rows = with_partition_id(chunks).withColumn("_low", is_low()).select(*KEY, PID, "_low", *_SEEN.values())
    types = {c: rows.schema[source].dataType for c, source in _SEEN.items()}
    shape = StructType([StructField(c, rows.schema[c].dataType) for c in KEY] + [StructField(PID, LongType())] + [
        StructField(f"{p}_{c}", t) for p in _PLACES for c, t in types.items()] + [StructField("nN", LongType())])
    parts = rows.mapInArrow(_summarise, shape)

    def slot(place: str) -> Column:
        fields = {"expected_quantity": F.lit(None).cast("long")} | {c: F.col(f"{place}_{c}") for c in _SEEN}
        return F.when(F.col(f"{place}_current_quantity").isNotNull(), F.struct(*[fields[c].alias(c) for c in _SLOT]))

    def merge(a: Column, b: Column) -> Column:
        return F.struct(
            F.coalesce(a["FL"], b["FL"]).alias("FL"), F.coalesce(a["FN"], b["FN"]).alias("FN"),
            F.coalesce(a["FR"], F.when(a["FL"].isNotNull(), b["FN"]).otherwise(b["FR"])).alias("FR"),
            F.when(b["nN"] > 0, b["OA"]).otherwise(F.coalesce(a["OA"], b["FL"])).alias("OA"), (a["nN"] + b["nN"]).alias("nN"))

    one = F.struct(F.col(PID), F.struct(*[slot(p).alias(p) for p in _PLACES], F.col("nN")).alias("s"))
    by_key = parts.groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["s"]).alias("_s"))  # one a chunk
    whole = F.aggregate(F.slice("_s", F.lit(2), F.size("_s")), F.element_at("_s", 1), merge)
    return by_key.select(*KEY, whole.alias("_w")).select(*KEY, "_w.*")


def _slot(df_col: str) -> Column:
    return F.struct(*[F.col(f"{df_col}.{c}").alias(c) for c in _SLOT])


def _as_status(slot: Column, status: str, qty: Column | None = None) -> Column:
    fields = []
    for c in _SLOT:
        v = qty if (c == "current_quantity" and qty is not None) else slot[c]
        fields.append(v.alias(c))
    return F.when(slot.isNotNull(), F.struct(*fields, F.lit(status).alias("status")))


def maintain_alerts(alerts: DataFrame, obs: DataFrame, order: list[str] | None = None, in_order: bool = False) -> DataFrame:
    """WF15: the alert table after all observations, as the later trigger
    leaves it (D-4). New alerts take ``new_alert_id`` of the observation that
    opened them; an alert keeps its alert_date when it is resolved. ``in_order``
    as in ``history_positions``."""
    pos = history_positions(obs, order, in_order)
    a = alerts.select(*ALERT_COLS)
    slot = F.struct(*[F.col(c) for c in _SLOT])
    ordc = F.struct("alert_date", "alert_id")
    init = (a.groupBy(*KEY).agg(
        *[F.max_by(F.when(F.col("status") == s, slot), F.when(F.col("status") == s, ordc)).alias(n)
          for s, n in (("OPEN", "o0"), ("ACK", "a0"), ("RESOLVED", "r0"))]))
    j = init.join(pos, KEY, "full_outer")

    o0, a0, r0 = F.col("o0"), F.col("a0"), F.col("r0")
    R = r0.isNotNull()
    A = o0.isNotNull() | a0.isNotNull()
    o_newer = o0.isNotNull() & (a0.isNull() | (F.struct(o0.alert_date, o0.alert_id)
                                               > F.struct(a0.alert_date, a0.alert_id)))
    newest = F.when(o_newer, o0).otherwise(a0)
    other = F.when(o_newer, a0).otherwise(F.when(o0.isNotNull() & a0.isNotNull(), o0))
    other_status = F.when(o_newer, "ACK").otherwise("OPEN")
    nN = F.coalesce(F.col("nN"), F.lit(0))
    FN, FR, FL, OA = F.col("FN"), F.col("FR"), F.col("FL"), F.col("OA")
    new_open = F.when(OA.isNotNull(), _as_status(_slot("OA"), "OPEN"))
    keep_o = _as_status(o0, "OPEN")
    keep_a = _as_status(a0, "ACK")
    keep_r = _as_status(r0, "RESOLVED")

    def arr(*xs):
        return F.array(*xs)

    null_row = F.lit(None).cast("struct<alert_id:bigint,current_quantity:bigint,reorder_level:bigint,"
                                "expected_quantity:bigint,alert_date:timestamp,status:string>")
    # Case R: RESOLVED stays; any not-low (or no OPEN/ACK to begin with) ->
    # OPEN/ACK gone and an OPEN from OA; else OPEN/ACK unchanged.
    case_r = F.when(
        (nN > 0) | ~A, arr(keep_r, new_open, null_row)).otherwise(arr(keep_r, keep_o, keep_a))
    # Case no RESOLVED, some OPEN/ACK.
    resolved_newest = F.struct(*[(FN["current_quantity"] if c == "current_quantity" else newest[c]).alias(c)
                                 for c in _SLOT], F.lit("RESOLVED").alias("status"))
    keep_other = F.when(other.isNotNull(), F.struct(*[other[c].alias(c) for c in _SLOT],
                                                    other_status.alias("status")))
    case_a = F.when(FN.isNull(), arr(keep_o, keep_a, null_row)).otherwise(
        F.when(nN >= 2, arr(resolved_newest, new_open, null_row))
        .otherwise(F.when(other.isNotNull(), arr(resolved_newest, keep_other, null_row))
                   .otherwise(arr(resolved_newest, new_open, null_row))))
    # Case empty: an alert opened at FL is resolved at FR; a last OPEN from OA.
    new_resolved = F.when(FR.isNotNull(), F.struct(
        FL["alert_id"].alias("alert_id"), FR["current_quantity"].alias("current_quantity"),
        FL["reorder_level"].alias("reorder_level"), F.lit(None).cast("long").alias("expected_quantity"),
        FL["alert_date"].alias("alert_date"), F.lit("RESOLVED").alias("status")))
    case_e = arr(new_resolved, new_open, null_row)

    rows = F.when(R, case_r).when(A, case_a).otherwise(case_e)
    out = j.select(*KEY, F.explode(rows).alias("r")).where(F.col("r").isNotNull())
    return out.select(F.col("r.alert_id").alias("alert_id"), *KEY,
                      *[F.col("r." + c).alias(c) for c in _SLOT if c != "alert_id"],
                      F.col("r.status").alias("status"))
