"""The query op11 over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table
from factloom.llm.licences import scan_licences


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.col("phrase_places.word")
    base = F.concat_ws(",", F.array_sort(F.array_distinct("phrase_places.label")))
    return found.select(
        "doc_id", "n_words", F.size("phrase_places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        base.alias("base_labels"), F.concat_ws(",", "licence_labels").alias("labels"), F.col("licence_score").alias("score"))
