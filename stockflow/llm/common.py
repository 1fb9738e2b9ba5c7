"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.plans.checkpoint import ensure_checkpoint_dir

#: At most this many keys can each hold more than 1/HEAVY_KEYS of all rows.
HEAVY_KEYS = 1000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor never recomputes what lies
    before, fixes the rows, and gives Catalyst a measured size, by which it
    alone decides whether a side is small enough to broadcast.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot_key(left: DataFrame, right: DataFrame, key: str, counts: str, total: int) -> DataFrame:
    """Left join on ``key`` where a few keys may hold most rows of ``left``.

    ``right`` has one row per key and, in ``counts``, how many rows of
    ``left`` carry it. Keys with more than ``total / HEAVY_KEYS`` rows (so
    at most HEAVY_KEYS of them, whatever the data) are broadcast; the others
    are shuffled, where no key can fill a task. Hot rows take part in the
    shuffle under a spread-out stand-in key that matches nothing.
    """
    cut = max(total // HEAVY_KEYS, 1)
    values = [c for c in right.columns if c not in (key, counts)]
    heavy = right.filter(F.col(counts) > cut).select(
        F.col(key).alias("__hk"), F.struct(*values).alias("__hv"))
    light = right.filter(F.col(counts) <= cut).select(
        F.col(key).alias("__lk"), F.lit(0).alias("__ls"), F.struct(*values).alias("__lv"))
    marked = left.join(F.broadcast(heavy), F.col(key) == F.col("__hk"), "left")
    # by a hash of the row, not by chance: a task that runs again must deal its rows as before
    spread = F.when(F.col("__hk").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(
        F.lit(1) + F.pmod(F.xxhash64(*left.columns), F.lit(1_000_000)).cast("int"))
    joined = marked.withColumn("__s", spread).join(
        light, (F.col(key) == F.col("__lk")) & (F.col("__s") == F.col("__ls")), "left")
    return joined.select(*[F.col(c) for c in left.columns], *[
        F.coalesce(F.col("__hv")[v], F.col("__lv")[v]).alias(v) for v in values])


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text mod 5; rows in fold 0 are held out. A row
    without id counts as held out, so that nothing is learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0).cast("long"))


def labelled_ids(labels: DataFrame, label: str) -> DataFrame:
    """(__id, y) of all labelled rows outside fold 0; of several labels of one id the largest."""
    return (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
            .groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).cast("int").alias("y"))
            .filter(fold(F.col("__id")) != 0))


def class_sizes(labels: DataFrame, label: str) -> dict[int, int]:
    """Number of labelled rows outside fold 0 by class."""
    return {r["y"]: r["count"] for r in labelled_ids(labels, label).groupBy("y").count().collect()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(text, y) of at most ``limit`` labelled documents of each class outside fold 0.

    The sample is the ``limit`` smallest hashes of the id in each class, so
    it is bounded, reproducible and independent of the table's order. Rows
    without label, id or text are left out.
    """
    rows = labelled_ids(labels, label)
    picks = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(limit) for y in (0, 1)]
    ids = picks[0].unionByName(picks[1])
    return (docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
            .select(F.col("doc_id").alias("__d"), "text")
            .join(F.broadcast(ids), F.col("__d") == F.col("__id"))
            .select("__id", "text", "y"))
