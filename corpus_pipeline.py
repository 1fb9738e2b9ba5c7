"""The corpus pipeline: from raw documents to packed training sequences.

``STAGES`` run in order. Each takes (spark, docs, sf_dir) and works on every
row its predecessor kept; all but the last return the columns of documents.
``run`` writes each stage's result as Parquet in the shared checkpoint folder
and reads it back, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockflow.llm.common import materialize
from stockflow.llm.mixing import mixed_documents
from stockflow.llm.packing import pack_documents
from stockflow.llm.quality import keep_quality
from stockflow.llm.simhash import keep_one_of_each
from stockflow.llm.toxicity import keep_harmless


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the quality classifier predicts as 0 go."""
    _short_batches(spark)
    return keep_quality(docs, _labels(spark, sf_dir))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the toxicity classifier predicts as 1 go."""
    _short_batches(spark)
    return keep_harmless(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each SimHash component stays (3-word shingles, 3 bits)."""
    _short_batches(spark)
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents are left out or repeated so that sources meet their targets."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the rows become pieces of sequences of 2,048 words."""
    _short_batches(spark)
    return pack_documents(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates),
          ("mixing", mixing), ("packing", packing)]

#: Trained models, fingerprints and hashes: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
