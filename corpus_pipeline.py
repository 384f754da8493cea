"""A corpus pipeline of training-data operators; see STAGES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm.common import Scratch, documents
from quarrylight.llm.pipeline_stages import STAGES

#: SQL cannot train the classifier of the first stage; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.sweep()  # what the stage wrote for itself
    return docs
