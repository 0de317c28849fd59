"""The query op5 over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table
from factloom.llm.mixing import mix


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").alias("n_bytes"))
    mixed = mix(docs, size="n_bytes", power=0.5, block_bytes=65_536, period=1_024)
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_place")
