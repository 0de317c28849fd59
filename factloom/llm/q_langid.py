"""The query op10 over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import remainder, table
from factloom.llm.langid import fit_languages, held_out, identify


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = remainder(F.col("doc_id"), 4)
    fitted = fit_languages(docs.where(rest != 2))
    found = identify(docs.select("doc_id", "text"), fitted)
    return found.select("doc_id", held_out(rest).alias("held_out"), "lang_pred", "score", "rejected")
