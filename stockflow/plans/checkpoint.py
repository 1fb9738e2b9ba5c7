"""Lineage cuts in the shared folder named by ``spark.checkpoint.dir``.

Iterative operators (allocation rounds, carry resolution) cut lineage with
reliable ``DataFrame.checkpoint``; files land in the cluster's shared
checkpoint folder, so a lost executor never loses a materialised round.
``localCheckpoint`` is never used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The session's checkpoint folder, or None when none is configured."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    try:
        return spark.sparkContext.getCheckpointDir()
    except Exception:  # pragma: no cover - older API
        return None


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Make sure the SparkContext checkpoints into the configured folder.

    Reads ``spark.checkpoint.dir`` from the session. Only when it is unset
    *and* the master is local (tests, benches) a fresh folder is created --
    under ``fallback`` if given, else a new temporary folder; on a cluster an
    unset folder is an error.
    """
    sc = spark.sparkContext
    current = None
    try:
        current = sc.getCheckpointDir()
    except Exception:  # pragma: no cover
        current = None
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (HDFS/S3/...) "
                               "for checkpoints; a machine-local folder is only used in local mode")
        d = tempfile.mkdtemp(prefix="stockflow-ckpt-", dir=fallback)
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and return a DataFrame reading it back."""
    spark = df.sparkSession
    if not checkpoint_dir(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; configure a shared folder for iterative operators")
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage as a checkpoint does, but the rows come back with their
    measured size. A checkpoint keeps its plan's estimate, and estimates
    multiply with every join, so loops that join their own results use this.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
