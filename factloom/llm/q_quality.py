"""The query op9 over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import remainder, table
from factloom.llm.quality import fit_quality, score_quality


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = remainder(F.col("doc_id"), 3)
    labels = table(spark, sf_dir, "labels").where(rest != 1)
    model = fit_quality(docs.where(rest != 1), labels)
    # a row without an id is never learned from
    return score_quality(docs, model).select("doc_id", F.coalesce(rest == 1, F.lit(True)).alias("held_out"), "score", "predicted")
