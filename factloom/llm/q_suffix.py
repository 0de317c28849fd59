"""The query op4 over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import table
from factloom.llm.suffix import remove_repeats


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
