"""Skew-safe ordered scans per key: running sums and the clipped balance fold.

A window ``partitionBy(key).orderBy(t)`` puts every row of a key into one
task, so one hot (warehouse, item) holding a third of the ledger would make
one task process a third of the data. Instead, rows are range-partitioned on
``(keys..., order...)``: the range partitioner samples the composite key, so
a hot key is split over as many partitions as its volume needs. Each
partition is scanned locally (``mapInArrow``: numpy over the value column,
every other column passes through as the Arrow data it was, so no id is ever
rounded) and the only cross-partition state is the carry into the *first* key
of each partition -- at most one carry per partition. That structural bound
(``<= num_partitions`` rows) is what makes carry tables safe to broadcast or
to bring to the driver.

The range-partitioned input is checkpointed (shared checkpoint folder) before
use, so every branch and every retry reads the same fixed partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from stockflow.plans.checkpoint import cut_lineage

PID = "_pid"


def default_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def range_chunks(df: DataFrame, keys: list[str], order: list[str],
                 num_partitions: int | None = None) -> DataFrame:
    """Range-partition on (keys, order) and sort each partition the same way."""
    n = num_partitions or default_partitions(df)
    cols = [*keys, *order]
    return df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)


def with_partition_id(parts: DataFrame) -> DataFrame:
    """Tag rows with their partition index, computed in the JVM directly over
    the (checkpointed) partitions. Python code reads it from this column: a
    task's own partition id is not the data partition's index when the scan
    sits under a Union in the same stage."""
    return parts.withColumn(PID, F.spark_partition_id().cast("long"))


def _with_fields(schema: StructType, fields: list[StructField]) -> StructType:
    names = {f.name for f in fields}
    return StructType([f for f in schema.fields if f.name not in names] + fields)


def _group_starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """True where a row of this (sorted) batch starts a new key group."""
    n = batch.num_rows
    start = np.zeros(n, dtype=bool)
    start[0] = True
    for k in keys:
        a, b = batch.column(k).slice(1), batch.column(k).slice(0, n - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        start[1:] |= differ.to_numpy(zero_copy_only=False)
    return start


def _key_at(batch: pa.RecordBatch, keys: list[str], i: int) -> tuple:
    return tuple(batch.column(k)[i].as_py() for k in keys)


def _longs(batch: pa.RecordBatch, col: str) -> np.ndarray:
    return pc.fill_null(batch.column(col).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def _flags(batch: pa.RecordBatch, col: str) -> np.ndarray:
    return pc.fill_null(batch.column(col), False).to_numpy(zero_copy_only=False)


def _extended(batch: pa.RecordBatch, extra: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The batch with columns added or replaced at the end; the others untouched."""
    keep = [n for n in batch.schema.names if n not in extra]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *(pa.array(v) for v in extra.values())],
                                      names=[*keep, *extra])


def _segment_sums(values: np.ndarray, starts: np.ndarray, carry: int) -> np.ndarray:
    """Running sums that begin anew at ``starts``; the first segment begins at ``carry``."""
    total = np.cumsum(values)
    at = np.flatnonzero(starts)
    base = total[at] - values[at]
    if at.size:
        base[0] -= carry
    return total - np.repeat(base, np.diff(np.append(at, values.size)))


# ---------------------------------------------------------------- running sums
def running_sums(df: DataFrame, keys: list[str], order: list[str],
                 sums: dict[str, str], num_partitions: int | None = None) -> DataFrame:
    """Per-key running sums of long columns in ``order`` (unbounded preceding
    .. current row), exact under any key skew. ``sums`` maps output -> input.

    The range-partitioned input is checkpointed once: the local scan and the
    per-chunk totals must see the very same partitions, and two separately
    planned range exchanges may sample different bounds. Only a chunk's first
    key can continue from an earlier chunk, so only the chunks' first and last
    keys are summed for the carries.
    """
    parts = with_partition_id(cut_lineage(range_chunks(df, keys, order, num_partitions)))
    outs = list(sums)
    schema = _with_fields(parts.schema, [StructField(o, LongType(), True) for o in outs])

    def local(it):
        last_key, carry = None, {}
        for batch in it:
            if not batch.num_rows:
                continue
            starts = _group_starts(batch, keys)
            goes_on = _key_at(batch, keys, 0) == last_key
            made = {o: _segment_sums(_longs(batch, sums[o]), starts, carry[o] if goes_on else 0) for o in outs}
            last_key, carry = _key_at(batch, keys, batch.num_rows - 1), {o: int(v[-1]) for o, v in made.items()}
            yield _extended(batch, made)

    def edges(it):
        """(chunk, key, sums) of a chunk's first and last key: at most two rows."""
        pid, found = None, {}
        for batch in it:
            if not batch.num_rows:
                continue
            pid = batch.column(PID)[0].as_py() if pid is None else pid
            ids = np.cumsum(_group_starts(batch, keys)) - 1
            first = next(iter(found), None)
            for g in sorted({0, int(ids[-1])}):
                own = ids == g
                key = _key_at(batch, keys, int(np.argmax(own)))
                add = [int(_longs(batch, sums[o])[own].sum()) for o in outs]
                old = found.get(key)
                found[key] = [x + y for x, y in zip(old, add)] if old else add
            last = _key_at(batch, keys, batch.num_rows - 1)
            found = {k: v for k, v in found.items() if k in (first if first is not None else next(iter(found)), last)}
        if found:
            names = [*keys, PID, *["_t_" + o for o in outs]]
            rows = [[*k, pid, *v] for k, v in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa_types[i]) for i in range(len(names))], names=names)

    edge_schema = StructType([parts.schema[k] for k in keys] + [StructField(PID, LongType())]
                             + [StructField("_t_" + o, LongType()) for o in outs])
    from pyspark.sql.pandas.types import to_arrow_type
    pa_types = [to_arrow_type(f.dataType) for f in edge_schema.fields]
    totals = parts.select(*keys, PID, *dict.fromkeys(sums.values())).mapInArrow(edges, edge_schema)
    w = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    # Non-null only for a key continuing from an earlier chunk: at most one row per chunk.
    carries = (totals.select(F.col(PID).alias("_cp"), *[F.col(k).alias("_ck_" + k) for k in keys],
                             *[F.sum("_t_" + o).over(w).alias("_c_" + o) for o in outs])
               .where(F.col("_c_" + outs[0]).isNotNull()))
    same = F.col(PID) == F.col("_cp")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_ck_" + k))
    out = parts.mapInArrow(local, schema).join(F.broadcast(carries), same, "left")
    for o in outs:
        out = out.withColumn(o, (F.col(o) + F.coalesce(F.col("_c_" + o), F.lit(0))).cast("long"))
    return out.select(*[f.name for f in schema.fields if f.name != PID])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                num_partitions: int | None = None) -> DataFrame:
    return running_sums(df, keys, order, {out: value}, num_partitions)


# ---------------------------------------------------------------- clipped fold
def _clip(values: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Balances and acceptance of one stretch of movements entered with ``b``:
    running sums up to the next violation, which is left out; where violations
    are dense, short stretches go value by value."""
    n, i, step = len(values), 0, 256
    balance, accepted = np.empty(n, np.int64), np.ones(n, bool)
    while i < n:
        run = b + np.cumsum(values[i:i + step])
        below = np.flatnonzero(run < 0)
        ok = int(below[0]) if below.size else len(run)
        balance[i:i + ok] = run[:ok]
        b = int(run[ok - 1]) if ok else b
        i += ok
        if not below.size:
            step *= 2
            continue
        step = max(16, step // 2)
        stop = min(n, i + (64 if step == 16 else 1))
        for k, v in enumerate(values[i:stop].tolist(), i):
            accepted[k] = b + v >= 0
            b += v if accepted[k] else 0
            balance[k] = b
        i = stop
    return balance, accepted


def _fold(values: np.ndarray, resets: np.ndarray, starts: np.ndarray, carry_in: int):
    """Clipped fold over one sorted batch: (balance after each row, accepted, last balance).

    ``starts`` rows begin a key at balance 0; ``resets`` rows (openings) set
    the balance to their value; other rows add their value unless the balance
    would go below zero, in which case they are rejected. Stretches without a
    violation are settled all at once.
    """
    cut = starts | resets
    cut[0] = True
    carry = 0 if starts[0] or resets[0] else carry_in
    balance, accepted = _segment_sums(values, cut, carry), np.ones(len(values), bool)
    at = np.flatnonzero(cut)
    end = np.append(at[1:], len(values))
    for s in np.flatnonzero(np.minimum.reduceat(balance, at) < 0).tolist():
        a, z = int(at[s]), int(end[s])
        if resets[a]:
            balance[a] = values[a]
            balance[a + 1:z], accepted[a + 1:z] = _clip(values[a + 1:z], int(values[a]))
        else:
            balance[a:z], accepted[a:z] = _clip(values[a:z], carry if s == 0 else 0)
    return balance, accepted, int(balance[-1])


def _fold_partition(it, keys, value, reset, carries: dict):
    """Fold every row of one partition. Its first key starts from
    ``carries.get(pid, 0)`` (the balance carried from earlier partitions);
    every later key starts at 0 or at its opening row."""
    last_key, carry = None, 0
    for batch in it:
        if not batch.num_rows:
            continue
        starts = _group_starts(batch, keys)
        if last_key is None:                        # first batch of the partition
            starts[0], carry = False, int(carries.get(batch.column(PID)[0].as_py(), 0))
        else:
            starts[0] = _key_at(batch, keys, 0) != last_key
        balance, accepted, carry = _fold(_longs(batch, value), _flags(batch, reset), starts, carry)
        last_key = _key_at(batch, keys, batch.num_rows - 1)
        yield _extended(batch, {"_balance": balance, "_accepted": accepted})


class _Run:
    """Summary of one key's rows in one chunk, entered with balance 0."""

    def __init__(self, key: tuple, first: bool):
        self.key, self.first = key, first
        self.reset, self.total, self.low, self.final = False, 0, 0, 0
        self.gain, self.draw = 0, 0

    def add(self, values: np.ndarray, resets: np.ndarray) -> None:
        run = self.total + np.cumsum(np.where(resets, 0, values))
        added = int(run[-1]) - self.total
        self.gain = max(self.gain + added, int(run[-1]) - min(self.total, int(run.min())))  # largest sum of a tail
        self.draw = max(self.draw, -int(values.min()))                                      # largest single movement out
        self.low, self.total = min(self.low, int(run.min())), int(run[-1])
        self.reset = self.reset or bool(resets.any())
        self.final = _fold(values, resets, np.zeros(len(values), bool), self.final)[2]


def _summaries(it, keys, value, reset, names, types):
    """Summaries of a chunk's first and last key only (at most two rows): keys
    strictly inside never cross a boundary."""
    pid, first, last = None, None, None
    for batch in it:
        if not batch.num_rows:
            continue
        pid = batch.column(PID)[0].as_py() if pid is None else pid
        ids = np.cumsum(_group_starts(batch, keys)) - 1
        values, resets = _longs(batch, value), _flags(batch, reset)
        for g in sorted({0, int(ids[-1])}):
            own = ids == g
            key = _key_at(batch, keys, int(np.argmax(own)))
            if first is None:
                first = last = _Run(key, True)
            elif key != last.key:
                last = _Run(key, False)
            last.add(values[own], resets[own])
    if first is not None:
        rows = [[*r.key, pid, r.first, r.reset, r.total, max(0, -r.low), r.final, r.gain, r.draw]
                for r in ([first] if last is first else [first, last])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


#: Entry balances for which a chunk's step table may hold an exit balance.
TABLE_ENTRIES = 1 << 16


def _resolve_chains(rows, keys) -> tuple[dict[int, int], dict[tuple, list[tuple]]]:
    """Walk each key's chunks in order. A chunk entered with balance b >= need
    rejects nothing and leaves b + sum; one with an opening leaves its own
    final balance. Returns the carries known so far and, of each key that met
    a chunk below its need, that chunk and all later ones as (chunk, highest
    balance it can be entered with, need, sum, final balance or None); of the
    first that highest balance is the balance.

    The bound: a chunk entered with at most u leaves at most u + sum if it
    rejects nothing; else less than the largest movement out was left at its
    last rejection, and what came after adds at most the largest tail sum.
    """
    chains: dict[tuple, list] = {}
    for r in rows:
        chains.setdefault(tuple(r[k] for k in keys), []).append(r)
    carries, open_at = {}, {}
    for key, chunks in chains.items():
        chunks.sort(key=lambda r: r[PID])
        b, later = chunks[0]["_final"], None
        for r in chunks[1:]:
            if later is None:
                carries[r[PID]] = b
                if not r["_reset"] and b < r["_need"]:
                    later = open_at[key] = []
            if later is not None:
                later.append((r[PID], b, r["_need"], r["_sum"], r["_final"] if r["_reset"] else None))
            if r["_reset"]:
                b = r["_final"]
            elif later is None:
                b += r["_sum"]
            else:
                b = max(b + r["_sum"], r["_draw"] - 1 + r["_gain"], 0)
    return carries, open_at


def clipped_fold(df: DataFrame, keys: list[str], order: list[str], value: str, reset: str,
                 balance_out: str = "balance", accepted_out: str = "accepted",
                 num_partitions: int | None = None, stats: dict | None = None,
                 table_entries: int = TABLE_ENTRIES) -> DataFrame:
    """Per-key fold where a row that would make the balance negative is rejected.

    ``reset`` marks opening rows (they set the balance to ``value``); they
    must sort first within their key. The data is split into range chunks and
    written once. Four passes at most, whatever the data:

    1. each chunk summarises its first and last key (sum, need, final
       balance); the driver walks the chunks of the keys that cross borders;
    2. only if a key met a chunk with less than that chunk needs: from there on
       its balances depend on every single row, but a chunk's exit balance is a
       function of its entry balance. Each such chunk, where it lies, writes
       that function as a step table over the balances it can be entered with
       (at most ``TABLE_ENTRIES``; balances of at least its need need no entry);
    3. the tables of a key are composed by one lookup a chunk along its chain.
       Only a key with a table beyond that size streams its rows (value and
       opening flag only) in order through one task instead;
    4. every chunk folds its rows, its first key starting from its carry.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    parts = with_partition_id(cut_lineage(range_chunks(df, keys, order, num_partitions)))
    schema = StructType([parts.schema[k] for k in keys] + [
        StructField(PID, LongType()), StructField("_first", BooleanType()), StructField("_reset", BooleanType()),
        StructField("_sum", LongType()), StructField("_need", LongType()), StructField("_final", LongType()),
        StructField("_gain", LongType()), StructField("_draw", LongType())])
    names, types = [f.name for f in schema.fields], [to_arrow_type(f.dataType) for f in schema.fields]
    slim = parts.select(*keys, PID, *dict.fromkeys([value, reset]))
    rows = slim.mapInArrow(lambda it: _summaries(it, keys, value, reset, names, types), schema).collect()  # <= 2 per chunk
    carries, open_at = _resolve_chains(rows, keys)
    tabled = {k: v for k, v in open_at.items() if all(min(high + 1, need) <= table_entries for _, high, need, _, _ in v)}
    streamed = {k: v[0][:2] for k, v in open_at.items() if k not in tabled}
    if tabled:
        carries |= _compose_chains(_step_tables(slim, keys, value, tabled), len(tabled))
    if streamed:
        carries |= _stream_chains(slim, keys, value, reset, streamed)
    if stats is not None:
        stats.update(passes=2 + 2 * bool(tabled) if not streamed else 3 + 2 * bool(tabled),
                     tabled_keys=len(tabled), streamed_keys=len(streamed))

    out = _with_fields(parts.schema, [StructField("_balance", LongType()), StructField("_accepted", BooleanType())])
    return (parts.mapInArrow(lambda it: _fold_partition(it, keys, value, reset, carries), out).drop(PID)
            .withColumnRenamed("_balance", balance_out).withColumnRenamed("_accepted", accepted_out))


def _small_table(spark: SparkSession, rows: list[tuple], shape: StructType) -> DataFrame:
    """A few rows of the driver as a table. Given as Arrow data they are a local
    relation; rows of Python objects would start a second set of Python workers
    on the executors, beside those of the scans."""
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(shape)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)],
                                                      schema=schema), shape)


def _exits(values: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The balance that each entry balance leaves after all movements. Balances
    that meet go on together, so they are followed once."""
    now, of = np.unique(entries, return_inverse=True)
    step = 16
    for i in range(0, len(values), step):
        for v in values[i:i + step].tolist():
            now = now + v if v >= 0 else np.where(now + v >= 0, now + v, now)
        if len(now) > 1:
            now, met = np.unique(now, return_inverse=True)
            of = met[of]
        else:
            break
    else:
        return now[of]
    b = int(now[0])
    done = i + step
    if done < len(values):
        b = int(_clip(values[done:], b)[0][-1])
    return np.full(len(of), b, np.int64)


def _step_tables(slim: DataFrame, keys: list[str], value: str, chains: dict[tuple, list[tuple]]) -> DataFrame:
    """(_chain, PID, _enter, _need, _sum, _last, table): a row for each chunk of ``chains``.
    ``table`` has the exit balances of the entry balances from 0 on; no row leaves its chunk."""
    spark = slim.sparkSession
    numbered = [(i, *key, pid, high, need, total, final)
                for i, (key, chunks) in enumerate(sorted(chains.items(), key=str)) for pid, high, need, total, final in chunks]
    shape = StructType([StructField("_chain", LongType())] + [StructField("_k_" + k, slim.schema[k].dataType) for k in keys]
                       + [StructField(c, LongType()) for c in ("_at", "_high", "_need", "_sum", "_last")])
    plan = F.broadcast(_small_table(spark, numbered, shape))   # at most one row per chunk
    same = F.col(PID) == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_k_" + k))
    rows = slim.join(plan, same).select("_chain", PID, "_high", "_need", "_sum", "_last", F.col(value).cast("long").alias("_v"))

    def table(it):
        facts, now, of = None, None, None
        for batch in it:
            if not batch.num_rows:
                continue
            if facts is None:   # a chunk is the continuation of one key at most
                facts = [batch.column(i)[0].as_py() for i in range(6)]
                of = now = np.arange(0 if facts[5] is not None else min(facts[2] + 1, facts[3]), dtype=np.int64)
            if len(now):
                found = _exits(_longs(batch, "_v"), now)
                now, met = np.unique(found, return_inverse=True)
                of = met[of]
        if facts is not None:
            exits = now[of] if len(now) else np.array([], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.int64()) for x in facts), pa.array([exits.astype("<i8").tobytes()], pa.binary())],
                names=["_chain", PID, "_high", "_need", "_sum", "_last", "table"])

    return rows.mapInArrow(table, f"_chain long, {PID} long, _high long, _need long, _sum long, _last long, table binary")


def _compose_chains(tables: DataFrame, n: int) -> dict[int, int]:
    """The balance with which each chunk of the chains is entered: a lookup a chunk, a chain in one task."""
    def follow(it):
        chain, b = None, 0
        for batch in it:
            found = []
            for c, pid, high, need, total, last, table in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if c != chain:
                    chain, b = c, high   # the first chunk's balance is known
                found.append((pid, b))
                b = last if last is not None else b + total if b >= need else int(np.frombuffer(table, "<i8", 1, 8 * b)[0])
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()),
                                              pa.array([x for _, x in found], pa.int64())], names=["pid", "balance"])

    got = tables.repartitionByRange(n, "_chain").sortWithinPartitions("_chain", PID).mapInArrow(follow, "pid long, balance long")
    return {r["pid"]: r["balance"] for r in got.collect()}  # at most one per chunk


def _stream_chains(slim: DataFrame, keys: list[str], value: str, reset: str,
                   open_at: dict[tuple, tuple[int, int]]) -> dict[int, int]:
    """The balance with which each later chunk of the keys in ``open_at`` is entered (at most one per chunk)."""
    spark, n = slim.sparkSession, len(open_at)
    numbered = [(i, *key, pid, b) for i, (key, (pid, b)) in enumerate(sorted(open_at.items(), key=str))]
    shape = StructType([StructField("_chain", LongType())] + [StructField("_k_" + k, slim.schema[k].dataType) for k in keys]
                       + [StructField("_from", LongType()), StructField("_enter", LongType())])
    chains = F.broadcast(_small_table(spark, numbered, shape))   # at most one row per chunk
    same = F.col(PID) >= F.col("_from")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_k_" + k))
    rows = (slim.withColumn("_at", F.monotonically_increasing_id()).join(chains, same)
            .select("_chain", PID, "_at", "_enter", F.col(value).cast("long").alias("_v"), F.col(reset).alias("_r")))

    def follow(it):
        chain, pid, b = None, None, 0
        for batch in it:
            if not batch.num_rows:
                continue
            ids, pids = _longs(batch, "_chain"), _longs(batch, PID)
            values, resets, enter = _longs(batch, "_v"), _flags(batch, "_r"), _longs(batch, "_enter")
            cuts = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (pids[1:] != pids[:-1])))
            found = []
            for a, z in zip(cuts.tolist(), np.append(cuts[1:], len(ids)).tolist()):
                if ids[a] != chain:
                    chain, pid, b = int(ids[a]), int(pids[a]), int(enter[a])
                elif pids[a] != pid:
                    pid = int(pids[a])
                    found.append((pid, b))
                b = _fold(values[a:z], resets[a:z], np.zeros(z - a, bool), b)[2]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()),
                                              pa.array([x for _, x in found], pa.int64())], names=["pid", "balance"])

    got = rows.repartitionByRange(n, "_chain").sortWithinPartitions("_chain", "_at").mapInArrow(follow, "pid long, balance long")
    return {r["pid"]: r["balance"] for r in got.collect()}
