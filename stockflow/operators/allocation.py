"""Shipping allocation (WF11): which orders ship when an order ships only if
every line fits the stock left by the orders before it.

Who ships depends on who shipped before, so a key's orders form a chain. Three
ways of deciding work together, and every decision is exact:

* **fold by warehouse**: an order touches one warehouse, so warehouses are
  independent; when each has at most ``fold_lines`` undecided lines, a task
  folds a warehouse's orders one after the other and nothing is left;
* **sums**: skew-safe running sums per (warehouse, item) in order id. ``upper`` =
  stock - shipped by smaller ids, ``lower`` = upper - demand of undecided
  smaller ids. All lines within ``lower`` ship, any line above ``upper`` is
  rejected. This settles most orders of a large table in one pass;
* **fold by component**: what sums leave undecided is a graph of orders that
  share keys. Its connected components are independent, so each is folded in a
  task of its own; of a component above ``fold_lines`` lines the first orders
  up to that many lines are folded (they depend on nothing behind them).

Sums and component folds alternate, so a component of L lines takes at most
about 2 L / fold_lines rounds, however long its chains are, and usually one.
The smallest undecided order is always decided by sums, so the loop ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.plans.checkpoint import ensure_checkpoint_dir, written
from stockflow.plans.components import components
from stockflow.plans.scan import running_sums
from stockflow.plans.skew import join_hot_key

KEY = ["warehouse_id", "item_id"]
#: Lines that one task folds, one after the other, with a counter for each key among them.
FOLD_LINES = 200_000


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decide the orders of each group in turn. Rows come by group and order; ``left`` is the stock that
    orders decided earlier leave at a line, ``used`` what the group's own orders have shipped from a key."""
    group, order, kind, used, lines, done = None, None, None, {}, [], []

    def close() -> None:
        ships = all(q <= left - used.get(key, 0) for key, q, left in lines)
        done.append((order, ships))
        for key, q, _ in lines if ships else ():
            used[key] = used.get(key, 0) + q
        lines.clear()

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("_group", "so_id", *KEY, "_q", "_left")]
        for g, so, wh, item, q, left in zip(*columns):
            if lines and (g != group or so != order):
                close()
            if g != group:
                used = {}
            group, order = g, so
            lines.append(((wh, item), q, left))
        kind = b.schema.field("so_id").type
        yield _decided(done, kind)
        done.clear()
    if lines:
        close()
        yield _decided(done, kind)


def _decided(done: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.bool_())],
                                      names=["so_id", "_ship"])


def _folded(rows: DataFrame) -> DataFrame:
    """(so_id, _ship) of all orders in ``rows`` (_group, so_id, key, _q, _left), a task for each group."""
    kind = rows.schema["so_id"].dataType.simpleString()
    return (rows.repartition("_group").sortWithinPartitions("_group", "so_id")
            .mapInArrow(_fold, f"so_id {kind}, _ship boolean"))


def _by_component(x: DataFrame, fold_lines: int) -> DataFrame:
    """Rows of the orders that component folds may decide now, with their component as ``_group``."""
    keyed = x.withColumn("_key", F.concat_ws(":", *KEY))
    first = written(keyed.groupBy("_key").agg(F.count("*").alias("_n"), F.min("so_id").alias("_first")), "firsts")
    total = x.count()
    edges = join_hot_key(keyed.select("so_id", "_key"), first, "_key", "_n", total).select(
        F.col("so_id").alias("a"), F.col("_first").alias("b"))
    roots = components(edges).withColumnRenamed("node", "so_id")
    sizes = written(x.groupBy("so_id").agg(F.count("*").alias("_n")).join(roots, "so_id", "left")
                        .select("so_id", "_n", F.coalesce("root", "so_id").alias("_group")), "sizes")
    placed = running_sums(join_hot_key(x, sizes, "so_id", "_n", total).withColumn("_one", F.lit(1).cast("long")),
                          ["_group"], ["so_id", *KEY], {"_pos": "_one"})
    now = sizes.join(placed.groupBy("so_id").agg(F.max("_pos").alias("_last")), "so_id").where(F.col("_last") <= fold_lines)
    return join_hot_key(placed.drop("_group"), now.drop("_last"), "so_id", "_n", total).where(F.col("_group").isNotNull())


def _settled(state: DataFrame) -> DataFrame:
    """Undecided lines with what smaller ids have shipped from their key (``_used``) and what undecided
    smaller ids ask of it (``_before``)."""
    undecided = state.where(~F.col("_fresh"))
    fresh = state.where("_fresh").join(undecided.select(*KEY).distinct(), KEY, "left_semi")
    both = undecided.unionByName(fresh).withColumns({
        "_s": F.when(F.col("_fresh"), F.col("_q")).otherwise(F.lit(0)).cast("long"),
        "_u": F.when(F.col("_fresh"), F.lit(0)).otherwise(F.col("_q")).cast("long")})
    x = running_sums(both, KEY, ["so_id"], {"_cs": "_s", "_cu": "_u"}).where(~F.col("_fresh"))
    return x.withColumn("_used", F.col("_used") + F.col("_cs")).withColumn("_before", F.col("_cu") - F.col("_u"))


def allocate(lines: DataFrame, stock: DataFrame, fail_reason: str = "INSUFFICIENT_STOCK",
             stats: dict | None = None, fold_lines: int = FOLD_LINES) -> DataFrame:
    """so_id, shipped, reason of every order of ``lines``, as if shipped one by one in ``so_id`` order.

    All lines of an order lie in one warehouse; lines of one order and item
    count together. Decisions are written once, each undecided line carries
    what smaller ids have shipped from its key, and a shipped line takes part
    only in the one round after it ships. Rounds are written to the shared
    checkpoint folder. ``stats`` gets the undecided lines and the way of each round.
    """
    spark = lines.sparkSession
    kind = lines.schema["so_id"].dataType.simpleString()
    done = f"{ensure_checkpoint_dir(spark)}/decisions-{uuid.uuid4().hex}"
    state = written(
        lines.groupBy("so_id", *KEY).agg(F.coalesce(F.sum("quantity"), F.lit(0)).cast("long").alias("_q"))
        .join(stock.select(*KEY, F.col("quantity").alias("_avail")), KEY, "left")
        .withColumns({"_avail": F.coalesce("_avail", F.lit(0)).cast("long"), "_used": F.lit(0).cast("long"),
                      "_fresh": F.lit(False)}), "allocation-lines")
    undecided, ways = [], []
    while True:
        n, most = (state.where(~F.col("_fresh")).groupBy("warehouse_id").count()
                   .agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first())
        if not n:
            break
        way = "warehouse" if most <= fold_lines else "component" if ways[-1:] == ["sums"] else "sums"
        x = state if way == "warehouse" and not ways else _settled(state)
        left = F.col("_avail") - F.col("_used")
        if way == "sums":
            per_order = (x.groupBy("so_id").agg(F.bool_and(F.col("_q") <= left - F.col("_before")).alias("_all"),
                                                F.bool_or(F.col("_q") > left).alias("_none"))
                         .where(F.col("_all") | F.col("_none")).select("so_id", F.col("_all").alias("_ship")))
        else:
            if way == "component":
                x = written(x, "undecided")
                rows = _by_component(x, fold_lines)
            else:
                rows = x.withColumn("_group", F.col("warehouse_id"))
            per_order = _folded(rows.select("_group", "so_id", *KEY, "_q", left.alias("_left")))
        undecided.append(n)
        ways.append(way)
        if way == "warehouse":  # decides all that is left
            per_order.write.mode("append").parquet(done)
            break
        x = written(x.join(per_order, "so_id", "left"), "round")
        x.where(F.col("_ship").isNotNull()).select("so_id", "_ship").distinct().write.mode("append").parquet(done)
        state = (x.where(F.col("_ship").isNull() | F.col("_ship")).withColumn("_fresh", F.col("_ship").isNotNull())
                 .select("so_id", *KEY, "_q", "_avail", "_used", "_fresh"))
    if stats is not None:
        stats.update(rounds=len(ways), undecided=undecided, ways=ways)
    schema = f"so_id {kind}, _ship boolean"
    decided = spark.read.schema(schema).parquet(done) if ways else spark.createDataFrame([], schema)
    return decided.select("so_id", F.col("_ship").alias("shipped"), F.when(~F.col("_ship"), F.lit(fail_reason)).alias("reason"))
