"""Joins whose large side may carry a few keys very often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys can each hold more than 1/HEAVY_KEYS of all rows.
HEAVY_KEYS = 1000


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
