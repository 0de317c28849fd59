"""The query op6 over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.class_lm import count_words, fit_classes, held_out, score_texts
from factloom.llm.common import remainder, table, written


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(remainder(F.col("doc_id"), 7))
    train = docs.where(~out).select(F.col("text").alias("t"))
    counts = written(count_words(train), "words")
    model = fit_classes(train, counts)
    return score_texts(docs.withColumn("held_out", out), model)
