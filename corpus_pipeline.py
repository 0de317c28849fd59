"""The training-data pipeline: language, near duplicates, benchmark passages, mixing, token file.

Each stage takes (spark, docs, sf_dir) and gives a dataframe; its rows are written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents.  The mixing
stage drops and repeats nothing: its decision is the order of the rows in its table, which the last
stage takes for the order of the token stream.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import remainder, table, written
from factloom.llm.decontam import clean_only
from factloom.llm.jaccard import one_of_each
from factloom.llm.langid import fit_languages, known_only
from factloom.llm.mixing import in_mixed_order, mix
from factloom.llm.token_file import read_documents, write_token_file
from factloom.llm.units import tokenizer

VOCABULARY = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the language is recognised."""
    fitted = fit_languages(docs.where(remainder(F.col("doc_id"), 4) != 2))
    return known_only(docs, fitted)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of the benchmark."""
    return clean_only(docs, table(spark, sf_dir, "benchmark"), width=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources are mixed to their target weights."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no name can clash
    key, source, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "source", "text"))
    mixed = in_mixed_order(mix(plain, key=key, source=source, text=text, power=0.5), source=source, key=key)
    return mixed.select(*plain.columns).toDF(*docs.columns)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the token file as read back, which holds them in the order of the table's rows.

    docs must be the rows of a table of Parquet files, as that order is in the files' names and row
    numbers only; a dataframe that doesn't come straight from one raises.
    """
    try:
        given = docs.select("doc_id", "text", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException as error:
        raise ValueError("the token file needs the mixed documents as a table of files, whose rows are its order") from error
    given = given.withColumn("file", F.expr("try_cast(file AS bigint)"))
    order = ["file", "name", "row"]
    path = public_tokenizers.path(VOCABULARY)
    found = read_documents(spark, write_token_file(given, path, key="doc_id", order=order, end_id=2), tokenizer(path).get_vocab_size())
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_file", token_file),
]

#: The language models, the token library and the coder can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
