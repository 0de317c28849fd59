"""The query op2 over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table
from factloom.llm.token_file import read_documents, write_token_file
from factloom.llm.units import tokenizer


def op2_token_file(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = public_tokenizers.path(vocabulary)
    path = write_token_file(docs, tokens, key="doc_id", end_id=2)
    found = read_documents(spark, path, tokenizer(tokens).get_vocab_size())
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
