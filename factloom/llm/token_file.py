"""Documents as one stream of token ids in range-ANS blocks, and back.

A token file is a folder of two Parquet tables.  ``frequencies`` (id, count) is the table that all
blocks share.  ``blocks`` has a row for each block: its part, its number within the part, the number
of ids, the coded payload (see ``rans``) and its pieces: which document's ids it holds and how many,
in order.  Parts follow one another in the order of the stream, blocks within a part too; a block
never crosses a part, a long document may cross blocks.  Any block can be decoded without another.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.common import append_columns, discard, shared_dir, ship_package, worker_value, written
from factloom.llm.rans import Frequencies, checkpoint_places, crc32_combine, decode_block, encode_block
from factloom.llm.units import tokenizer, unit_cache

def _table(shared) -> Frequencies:
    """The table of a broadcast (its name, counts, scale_bits), built once a worker."""
    key, counts, scale_bits = shared.value
    return worker_value(key, lambda: Frequencies(counts, scale_bits))


def tokenise(docs: DataFrame, path: str, text: str = "text", end_id: int | None = None) -> DataFrame:
    """docs with the ids of each whole text as little-endian bytes instead of the text (null: empty)."""
    narrow = tokenizer(path).get_vocab_size() <= 1 << 16
    end = b"" if end_id is None else np.asarray([end_id], "<u2" if narrow else "<u4").tobytes()

    def factory():
        cache = unit_cache(path, width=2 if narrow else 4)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([b"".join(x) + end for x in cache.of_texts(batch.column("__text").to_pylist())], pa.binary())]

        return compute

    return append_columns(docs.withColumnRenamed(text, "__text"), {"ids": T.BinaryType()}, factory).drop("__text")


def _counts(tokens: DataFrame, width: str, vocabulary: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), width)
            total += np.bincount(ids, minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "count"])

    return tokens.select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def write_token_file(
    docs: DataFrame,
    tokenizer_path: str,
    path: str | None = None,
    *,
    key: str = "doc_id",
    text: str = "text",
    order: Sequence[str] | None = None,
    end_id: int | None = 2,
    block_ids: int = 1 << 17,
    lanes: int = 1024,
    scale_bits: int = 20,
) -> str:
    """Write a token file of all rows of docs in ascending order of ``order`` (the key by default); its path.

    Null keys come first.  Rows with equal order values follow one another by a hash of their ids, so
    that equal input gives an equal stream.  A null text is empty.  An empty table gives a file
    without blocks.  The frequency table is the only thing that passes the driver: a row for each id
    of the vocabulary.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    order = list(order or [key])
    given = docs.select(F.col(key).alias("key"), F.struct(*order).alias("place"), F.col(text).alias("text"))
    tokens = written(tokenise(given, tokenizer_path, end_id=end_id), "ids")
    vocabulary = max([tokenizer(tokenizer_path).get_vocab_size(), (end_id or 0) + 1])
    width = "<u2" if tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"
    _counts(tokens, width, vocabulary).coalesce(1).write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, _load_counts(spark, path, vocabulary), scale_bits))
    key_type = given.schema["key"].dataType
    piece = T.StructType([T.StructField("key", key_type), T.StructField("row", T.LongType()), T.StructField("count", T.LongType()), T.StructField("whole", T.BooleanType())])
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("n_marks", T.IntegerType()), T.StructField("payload", T.BinaryType()), T.StructField("pieces", T.ArrayType(piece))])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = _table(shared), TaskContext.get().partitionId()
        held, pieces, have, block, row = [], [], 0, 0, 0

        def cut() -> pa.RecordBatch:
            ids = np.concatenate(held) if held else np.zeros(0, width)
            payload = encode_block(ids, table, lanes)
            values = [part], [block], [len(ids)], [len(checkpoint_places(payload)) - 1], [payload], [pieces]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=schema.names)

        for batch in batches:
            for k, data in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                ids, at, row = np.frombuffer(data, width), 0, row + 1
                while True:
                    take = min(len(ids) - at, block_ids - have)
                    held.append(ids[at : at + take])
                    pieces.append({"key": k, "row": row, "count": take, "whole": take == len(ids)})
                    at, have = at + take, have + take
                    if have == block_ids:
                        yield cut()
                        held, pieces, have, block = [], [], 0, block + 1
                    if at == len(ids):
                        break
        if pieces:
            yield cut()

    ordered = tokens.withColumn("tie", F.xxhash64("ids"))
    ordered = ordered.repartitionByRange("place", "tie").sortWithinPartitions("place", "tie")
    ordered.select("key", "ids").mapInArrow(run, schema).write.parquet(f"{path}/blocks")
    discard(tokens)
    return path


def _load_counts(spark: SparkSession, path: str, vocabulary: int) -> np.ndarray:
    counts = np.zeros(vocabulary, np.int64)
    for i, n in spark.read.parquet(f"{path}/frequencies").toLocalIterator():
        counts[i] = n
    return counts


def read_pieces(spark: SparkSession, path: str, vocabulary: int, *, scale_bits: int = 20, with_ids: bool = False) -> DataFrame:
    """The pieces of a token file, decoded: key, part, row, start (ids before it in the stream), n, crc, whole.

    With ``with_ids`` the ids too.  The unit of work is what follows one of a block's checkpoints, up
    to the next, so that a block may be decoded by several tasks; a document that crosses such a
    place comes in several pieces.  A damaged block raises an error.
    """
    ship_package(spark)
    blocks = spark.read.parquet(f"{path}/blocks")
    key_type = blocks.schema["pieces"].dataType.elementType["key"].dataType
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, _load_counts(spark, path, vocabulary), scale_bits))
    fields = [T.StructField("key", key_type), T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("row", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("crc", T.LongType()), T.StructField("whole", T.BooleanType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared)
        for batch in batches:
            for part, block, payload, pieces, mark in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "payload", "pieces", "mark"))):
                places = checkpoint_places(payload)
                first, last, final = places[mark], places[mark + 1], mark + 2 == len(places)
                ids, at, rows = decode_block(payload, table, mark, mark + 1).astype("<u4"), 0, []
                for p in pieces:
                    begin, at = at, at + p["count"]
                    if begin >= last and p["count"]:
                        break
                    low, high = max(begin, first), min(at, last)
                    if low < high or (not p["count"] and first <= begin and (begin < last or final)):
                        own = ids[low - first : high - first]
                        rows.append((p["key"], part, block, p["row"], low, len(own), zlib.crc32(own), p["whole"] and len(own) == p["count"]) + ((own.tolist(),) if with_ids else ()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=schema.names)

    # ids before each part: a row a part, summed along the parts; then along the blocks of a part
    sizes = blocks.groupBy("part", "block").agg(F.sum("n_ids").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("part", "block", within.alias("within")).join(parts, "part").select("part", "block", (F.col("before") + F.col("within")).alias("first"))
    units_ = blocks.withColumn("mark", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), "n_marks") - 1)))
    pieces = units_.mapInArrow(run, schema).join(first, ["part", "block"])
    return pieces.select("key", "part", "row", (F.col("first") + F.col("at")).alias("start"), "n", "crc", "whole", *["ids"] * with_ids)


@F.pandas_udf(T.LongType())
def _joined(pieces: pd.Series) -> pd.Series:
    def one(parts) -> int:
        crc = 0
        for p in parts:
            crc = crc32_combine(crc, p["crc"], 4 * p["n"])
        return crc

    return pieces.map(one)


def read_documents(spark: SparkSession, path: str, vocabulary: int, *, scale_bits: int = 20) -> DataFrame:
    """A row for each document of a token file: key, start, n_tokens, ids_crc32."""
    pieces = written(read_pieces(spark, path, vocabulary, scale_bits=scale_bits), "pieces")  # decoded once
    out = pieces.select("key", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), "whole", "part", "row")
    whole = out.where("whole").select("key", "start", "n_tokens", "ids_crc32")
    # of documents that cross blocks
    split = pieces.where("not whole").groupBy("part", "row").agg(F.min("key").alias("key"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("start", "n", "crc"))).alias("p"))
    return whole.unionByName(split.select("key", "start", "n_tokens", _joined("p").alias("ids_crc32")))
