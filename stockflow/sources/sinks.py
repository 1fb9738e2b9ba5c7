"""State changes as pure functions plus snapshot writes (SNK1-SNK8).

Plain Parquet has no UPDATE/DELETE/MERGE, so each change is
``(state, changes) -> new state``; callers write the result as a new
snapshot version (never overwriting the path being read).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["warehouse_id", "item_id"]


def dense_ids(df: DataFrame, order_cols: list[str], id_col: str, base: int = 0,
              num_partitions: int | None = None) -> DataFrame:
    """Consecutive ids ``base + 1, base + 2, ...`` in ``order_cols`` order.

    Range-sort into partitions (checkpointed, so partition contents are
    fixed), count rows per partition (one small aggregate: <= one row per
    partition, the only thing brought to the driver), and number rows as
    partition offset + position within the partition. No single-partition
    window and no Python row path.
    """
    from stockflow.plans.checkpoint import cut_lineage
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = cut_lineage(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
                        .withColumn("_pid", F.spark_partition_id())
                        .withColumn("_mid", F.monotonically_increasing_id()))
    counts = sorted((r["_pid"], r["n"]) for r in parts.groupBy("_pid").agg(F.count("*").alias("n")).collect())
    offsets, acc = [], base
    for pid, cnt in counts:
        offsets.append((pid, acc))
        acc += cnt
    # one row per partition, joined rather than spelled out in the plan
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, "_opid int, _off long"))
    local = F.col("_mid") - (F.col("_pid").cast("long") * F.lit(1 << 33))
    return (parts.join(table, F.col("_pid") == F.col("_opid"))
            .withColumn(id_col, (F.col("_off") + local + 1).cast("long")).drop("_pid", "_mid", "_opid", "_off"))


class Outputs(dict):
    """A workflow's result tables; a callable is run when its table is first
    asked for, so a caller pays only for what it uses (ids need jobs)."""

    def __getitem__(self, name):
        value = super().__getitem__(name)
        if callable(value):
            value = value()
            self[name] = value
        return value


def append_rows(target: DataFrame, new: DataFrame, id_col: str, order_cols: list[str],
                defaults: dict[str, object] | None = None, table: str | None = None) -> DataFrame:
    """SNK1: append rows with generated ids ``max(id) + 1, + 2, ...`` in
    ``order_cols`` order, filling column defaults.

    With ``table`` the declared defaults of that table apply too, and a row
    that would put null into one of its NOT NULL columns is an error.
    """
    from stockflow.schemas import DEFAULTS, NOT_NULL
    defaults = {**DEFAULTS.get(table, {}), **(defaults or {})}
    base = target.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("m")).first()["m"]
    with_ids = dense_ids(new, order_cols, id_col, int(base))
    for name, value in (defaults or {}).items():
        if name in with_ids.columns:
            with_ids = with_ids.withColumn(name, F.coalesce(F.col(name), F.lit(value).cast(target.schema[name].dataType)))
    for f in target.schema.fields:
        if f.name not in with_ids.columns:
            v = (defaults or {}).get(f.name)
            with_ids = with_ids.withColumn(f.name, F.lit(v).cast(f.dataType))
    required = NOT_NULL.get(table, ())

    def value(f):
        c = F.col(f.name).cast(f.dataType)
        if f.name not in required:
            return c
        return F.when(c.isNull(), F.raise_error(F.lit(f"{table}.{f.name} must not be null")).cast(f.dataType)).otherwise(c).alias(f.name)

    return target.unionByName(with_ids.select(*[value(f) for f in target.schema.fields]))


def snapshot(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK2: write a copy of a table (a new version folder; never the source)."""
    df.write.mode(mode).parquet(path)


def update_by_key(target: DataFrame, changes: DataFrame, keys: list[str], cols: list[str],
                  order: list[str] | None = None) -> DataFrame:
    """SNK3: keyed update of ``cols`` from ``changes``; never adds a row.

    Of several changes of one key the newest in ``order`` counts (without
    ``order``, the largest values), by an aggregate with map-side combine.
    """
    new = F.struct(*[F.col(c).alias("_new_" + c) for c in cols])
    ch = (changes.groupBy(*keys).agg(F.max(F.struct(F.struct(*[F.col(o) for o in order or cols]).alias("o"), new.alias("n"))).alias("_m"))
          .select(*keys, "_m.n.*", F.lit(True).alias("_hit")))
    j = target.join(ch, keys, "left")
    out = [F.when(F.col("_hit"), F.col("_new_" + c)).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c)
           if c in cols else F.col(c) for c in target.columns]
    return j.select(*out)


def delete_by_key(target: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    """SNK4: keyed delete (anti join)."""
    return target.join(keys_df.select(*keys).distinct(), keys, "left_anti")


def delete_n_per_key(target: DataFrame, keys_df: DataFrame, keys: list[str], n: int,
                     order: list[str]) -> DataFrame:
    """SNK5: delete at most ``n`` matching rows per key, the first ones in ``order``.

    Rows off the delete keys pass untouched; matching rows are ranked per key
    in a fixed order (the source's ``LIMIT`` without order is not repeatable)
    by a skew-safe running count, and the first ``n`` are dropped.
    """
    from stockflow.plans.scan import running_sum
    k = keys_df.select(*keys).distinct()
    untouched = target.join(k, keys, "left_anti")
    hit = target.join(k, keys, "left_semi").withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sum(hit, keys, order, "_one", "_rank")
    kept = ranked.where(F.col("_rank") > n).drop("_one", "_rank")
    return untouched.unionByName(kept.select(*target.columns))


def _next_stock_ids(stock: DataFrame, new_keys: DataFrame) -> DataFrame:
    """Ids for stock rows that do not exist yet: ``max(stock_id) + 1, ...`` in
    (warehouse, item) order (SNK1's dense ids; no formula over the key values,
    which could collide for large ids)."""
    base = stock.agg(F.coalesce(F.max("stock_id"), F.lit(0)).alias("m")).first()["m"]
    return dense_ids(new_keys, KEY, "stock_id", int(base))


def ensure_stock_rows(stock: DataFrame, keys_df: DataFrame) -> DataFrame:
    """SNK6: make sure a stock row exists for every (warehouse, item); new rows
    start at 0 with fresh ids. Existing rows are kept untouched."""
    new = keys_df.select(*KEY).distinct().join(stock.select(*KEY), KEY, "left_anti")
    new = _next_stock_ids(stock, new).select(
        "stock_id", *KEY, F.lit(0).cast("long").alias("quantity"), F.lit(None).cast("timestamp").alias("last_updated"))
    return stock.unionByName(new.select(*stock.columns))


def upsert_stock(stock: DataFrame, deltas: DataFrame, delta_col: str = "delta",
                 as_of=None) -> DataFrame:
    """SNK7: add quantity deltas to stock; keys without a row get one (with a
    fresh id).

    Deltas are pre-aggregated per key (map-side partial aggregation), so the
    joins see one row per key on each side; ids are made for new keys only.
    """
    d = deltas.groupBy(*KEY).agg(F.sum(delta_col).cast("long").alias("_d"))
    ts = F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()
    qty = (F.coalesce(F.col("quantity"), F.lit(0)) + F.coalesce(F.col("_d"), F.lit(0))).cast("long")
    upd = F.when(F.col("_d").isNotNull(), ts).otherwise(F.col("last_updated"))
    cols = [qty.alias(c) if c == "quantity" else upd.alias(c) if c == "last_updated" else F.col(c)
            for c in stock.columns]
    if "stock_id" not in stock.columns:
        return stock.join(d, KEY, "full_outer").select(*cols)
    existing = stock.join(d, KEY, "left").select(*cols)
    fresh = _next_stock_ids(stock, d.join(stock.select(*KEY), KEY, "left_anti"))
    blank = [F.col(c) if c in (*KEY, "stock_id") else F.col("_d").alias(c) if c == "quantity"
             else ts.alias(c) if c == "last_updated" else F.lit(None).cast(stock.schema[c].dataType).alias(c)
             for c in stock.columns]
    return existing.unionByName(fresh.select(*blank))


def with_default_column(df: DataFrame, name: str, dtype: str, default=None) -> DataFrame:
    """SNK8: add a column (ALTER TABLE ADD COLUMN ... DEFAULT)."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(default).cast(dtype))
