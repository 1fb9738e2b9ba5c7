"""Mixing sources to target weights (operator 4) by Pareto order sampling.

A document's size is its number of words. Sources in code-point order (null
last) weigh 1, 2, 3, repeating, and share the size of the whole corpus by
weight; no source gets more than ``MAX_REPEAT`` times its own size, and what
is cut off is shared again among the others. Of each source every document is
first given the certain whole copies, floor(target / size of the source). The
rest is a fixed-size sample, the size being words: documents are ranked by
random odds divided by their inclusion odds, and the smallest are taken until
the target is met as nearly as whole documents allow. Inclusion odds are the
odds of the source's remaining fraction, tilted by an importance (by default
mildly towards longer documents).

Each source's cut is found without sorting it: ranks are 52-bit integers,
counted in 4,096 cells per source, then 4,096 cells inside the cell that holds
the cut, then exactly. A hot source is thus only ever pre-aggregated. Random
numbers are hashes of the row and a seed, so reruns agree; equal rows share
their rank and are taken or left together.

Null and empty texts have size 0 and take part with nothing to take. Null
sources form one source, ordered last. Without any word all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockflow.llm.common import materialize
from stockflow.sources.sinks import dense_ids

MAX_REPEAT, SEED, CYCLE = 3, 20, 3
RANK_BITS, CELL_BITS = 52, 12


def words(text: Column) -> Column:
    """Number of words: runs of anything but space and the controls 9 to 13."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def default_importance(size: Column) -> Column:
    return F.lit(1.0) + F.log10(size + 1)


def source_targets(sized: DataFrame) -> DataFrame:
    """(m_source, m_size, m_target, m_whole, m_part, m_odds) of each source of
    ``sized(source, size)``: certain copies, words left to sample, their odds."""
    totals = materialize(sized.groupBy("source").agg(F.sum("size").alias("m_size")), "source_sizes")
    ranked = dense_ids(totals.withColumn("m_last", F.col("source").isNull()), ["m_last", "source"], "m_rank")
    ranked = materialize(ranked.select(F.col("source").alias("m_source"), "m_size", (
        (F.col("m_rank") - 1) % CYCLE + 1).alias("m_weight")), "source_weights")
    cap, weight = F.col("m_size") * MAX_REPEAT, F.col("m_weight")
    total = ranked.agg(F.sum("m_size").alias("s"), F.sum("m_weight").alias("w")).first()
    everything = total["s"] or 0
    level, before = everything / (total["w"] or 1), None
    while level != before:  # the sources at their limit only grow in number, so this ends
        full = cap <= F.lit(level) * weight
        r = ranked.agg(F.sum(F.when(full, cap)).alias("c"), F.sum(F.when(~full, weight)).alias("w")).first()
        before, level = level, (everything - (r["c"] or 0)) / r["w"] if r["w"] else level
    target = F.when(cap <= F.lit(level) * weight, cap.cast("double")).otherwise(F.lit(level) * weight)
    rate = F.when(F.col("m_size") > 0, F.col("m_target") / F.col("m_size")).otherwise(0.0)
    whole = F.least(F.floor(rate + 1e-9), F.lit(MAX_REPEAT).cast("long"))
    left = F.greatest(F.col("m_target") - F.col("m_whole") * F.col("m_size"), F.lit(0.0))
    share = F.least(F.greatest(F.when(F.col("m_size") > 0, left / F.col("m_size")).otherwise(0.0), F.lit(1e-12)), F.lit(1 - 1e-12))
    return materialize(ranked.withColumn("m_target", target).withColumn("m_whole", whole)
                       .withColumn("m_part", left).withColumn("m_odds", share / (1 - share)).drop("m_weight"), "targets")


def pareto_rank(row: tuple[Column, Column, Column], size: Column, seed: int, importance) -> Column:
    """The integer rank of a row (doc_id, source, text) beside its source's odds."""
    h = F.xxhash64(F.lit(seed), *[c.cast("string") for c in row])
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0 ** -53)
    odds = F.col("m_odds") * importance(size)
    return F.floor(u / (u + odds * (1 - u)) * F.lit(float(1 << RANK_BITS))).cast("long")


def _crossing(cells: DataFrame, digit: str) -> DataFrame:
    """Of each source the first cell whose running size passes the words to sample."""
    w = Window.partitionBy("m_id").orderBy(digit)
    run = cells.withColumn("m_run", F.col("m_below") + F.sum("m_sum").over(w))
    past = run.filter(F.col("m_run") > F.col("m_part"))
    return past.groupBy("m_id").agg(F.min(F.struct(digit, (F.col("m_run") - F.col("m_sum")).alias("m_below"))).alias("m")) \
        .select("m_id", F.col(f"m.{digit}").alias(digit), F.col("m.m_below").alias("m_below"))


def source_plan(docs: DataFrame, seed: int = SEED, importance=default_importance) -> DataFrame:
    """Of each source its targets, certain copies and the rank of its last sampled document (m_cut)."""
    sized = docs.select("doc_id", "source", "text", words(F.col("text")).alias("size"))
    sources = source_targets(sized.select("source", "size"))
    sources = materialize(sources.withColumn("m_id", F.xxhash64("m_source")), "source_ids")
    ranked = sized.join(sources, F.col("source").eqNullSafe(F.col("m_source"))).filter(F.col("m_part") > 0)
    rank = pareto_rank((F.col("doc_id"), F.col("source"), F.col("text")), F.col("size"), seed, importance)
    ranked = materialize(ranked.select("m_id", "m_source", "m_part", "size", rank.alias("m_rank")), "ranks")
    ids = ["m_id", "m_source", "m_part"]
    shift = RANK_BITS - CELL_BITS
    rows = ranked.withColumn("c1", F.shiftright("m_rank", shift))
    cells = rows.groupBy(*ids, "c1").agg(F.sum("size").alias("m_sum")).withColumn("m_below", F.lit(0))
    one = materialize(_crossing(cells, "c1"), "cells")
    shift -= CELL_BITS
    rows = rows.join(one, ["m_id", "c1"]).withColumn("c2", F.shiftright("m_rank", shift))
    cells = rows.groupBy(*ids, "m_below", "c2").agg(F.sum("size").alias("m_sum"))
    two = materialize(_crossing(cells, "c2"), "cells")
    rows = ranked.withColumn("c2", F.shiftright("m_rank", shift)).join(two, ["m_id", "c2"])
    last = rows.groupBy(*ids, "m_below", "m_rank").agg(F.sum("size").alias("m_sum"))
    w = Window.partitionBy("m_id").orderBy("m_rank")
    run = F.col("m_below") + F.sum("m_sum").over(w)
    last = last.withColumn("m_run", run).withColumn("m_near", F.abs(F.col("m_run") - F.col("m_part"))) \
        .withColumn("m_start", F.abs(F.col("m_below") - F.col("m_part")))
    best = last.groupBy("m_id").agg(F.min(F.struct("m_near", "m_rank")).alias("b"),
                                    F.min("m_start").alias("s"), F.min("m_rank").alias("f"))
    cut = best.select("m_id", F.when(F.col("b.m_near") < F.col("s"), F.col("b.m_rank"))
                      .otherwise(F.col("f") - 1).alias("m_cut"))
    everything = F.when(F.col("m_part") > 0, F.lit((1 << RANK_BITS) + 1)).otherwise(-1)
    return materialize(sources.join(materialize(cut, "cuts"), "m_id", "left")
                       .withColumn("m_cut", F.coalesce("m_cut", everything)).drop("m_id"), "plan")


def _copies(docs: DataFrame, seed: int, importance) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns c0, c1, ... and beside them the size and the number
    of copies the mix takes; the new names of doc_id, source and text."""
    plan = source_plan(docs, seed, importance)
    names = [f"c{k}" for k in range(len(docs.columns))]
    own = [names[docs.columns.index(c)] for c in ("doc_id", "source", "text")]
    ident, source, text = map(F.col, own)
    joined = docs.toDF(*names).join(plan, source.eqNullSafe(F.col("m_source")), "left").withColumn("size", words(text))
    extra = pareto_rank((ident, source, text), F.col("size"), seed, importance) <= F.col("m_cut")
    return joined.withColumn("m_copies", F.col("m_whole") + extra.cast("long")), own


def mixture(docs: DataFrame, seed: int = SEED, importance=default_importance) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row of ``docs(doc_id, source, text)``."""
    out, own = _copies(docs.select("doc_id", "source", "text"), seed, importance)
    return out.select(F.col(own[0]).alias("doc_id"), "size", F.col("m_size").alias("source_size"),
                      F.col("m_target").alias("target"), (F.col("size") * F.col("m_copies")).alias("taken"),
                      F.col("m_copies").alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = SEED, importance=default_importance) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns as they were."""
    out, _ = _copies(docs, seed, importance)
    return (out.filter(F.col("m_copies") > 0)
            .withColumn("m_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m_copies"))))
            .select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)]))
