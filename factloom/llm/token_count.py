"""Token counts of whole texts, huge documents by overlap resynchronisation.

A document of up to ``huge`` characters is counted in one piece.  A longer one is dealt out as
overlapping chunks, which may go to any executor.  Each chunk is encoded with offsets.  In the
overlap of two neighbours, a place is a stable common boundary when white space stands there and
both encodings have the same token ending before it and the same token beginning after it, at the
same offsets: white space is dropped before merging, and neither normalisation nor merging reaches
over it, so what follows such a place does not depend on what precedes it.  The counts are spliced
at the middle one of these places.  Documents of which some overlap holds none are dealt out anew
with overlaps (and chunks) four times as wide, at the end as a single chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import append_columns, ship_package, written
from factloom.llm.units import tokenizer, unit_cache

_CUTS = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("before", T.LongType()), T.StructField("sign", T.LongType())]))
_PLACE = T.StructType([T.StructField("n", T.LongType()), T.StructField("head", _CUTS), T.StructField("tail", _CUTS)])


def cuts(text: str, begin: int, offsets: list[tuple[int, int]], ids: list[int], low: int, high: int) -> list[dict]:
    """Places in [low, high) of a chunk that starts at begin: tokens before them, and a sign of the tokens around them."""
    starts = np.fromiter((a for a, _ in offsets), np.int64, len(offsets))
    ends = np.fromiter((b for _, b in offsets), np.int64, len(offsets))
    out = []
    for at in range(max(low, 1), min(high, len(text) - 1)):
        if text[at].isspace():
            k = int(np.searchsorted(ends, at, side="right"))
            if 0 < k < len(ids) and ends[k - 1] <= at and starts[k] > at:
                around = (int(starts[k - 1]) + begin, int(ends[k - 1]) + begin, ids[k - 1], int(starts[k]) + begin, int(ends[k]) + begin, ids[k])
                out.append({"at": begin + at, "before": k, "sign": hash(around)})  # of integers: the same in any process
    return out


def _count_small(df: DataFrame, text: str, path: str) -> DataFrame:
    def factory():
        cache = unit_cache(path, counts=True)
        return lambda batch: [pa.array([sum(x) for x in cache.of_texts(batch.column(text).to_pylist())], pa.int64())]

    return append_columns(df, {"n_tokens": T.LongType()}, factory)


def _count_chunks(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """chunks(k, n_chunks, begin, piece) with the count of each and the places in its two overlaps."""

    def factory():
        encode = tokenizer(path).encode

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for piece, k, last, begin in zip(*(batch.column(c).to_pylist() for c in ("piece", "k", "n_chunks", "begin"))):
                e = encode(piece, add_special_tokens=False)
                offsets, ids = e.offsets, e.ids
                head = cuts(piece, begin, offsets, ids, 0, overlap) if k else []
                tail = cuts(piece, begin, offsets, ids, len(piece) - overlap, len(piece)) if k + 1 < last else []
                out.append({"n": len(ids), "head": head, "tail": tail})
            place = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64()), ("sign", pa.int64())]))
            return [pa.array(out, pa.struct([("n", pa.int64()), ("head", place), ("tail", place)]))]

        return compute

    return append_columns(chunks, {"found": _PLACE}, factory).drop("piece")


def count_tokens(
    docs: DataFrame,
    path: str,
    *,
    text: str = "text",
    huge: int = 65_536,
    overlap: int = 1_024,
    limit: int = 2_048,
) -> DataFrame:
    """docs without their text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    One row comes out for each row that goes in.  A null text is empty; an empty text has no tokens.
    Columns of docs with the new names are replaced.
    """
    if not 0 < 2 * overlap < huge:
        raise ValueError("chunks must be over twice as long as their overlap")
    ship_package(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    keyed = docs.select(F.struct(*others).alias("row"), F.coalesce(text, F.lit("")).alias("t")).withColumn("n_bytes", F.octet_length("t").cast("long"))
    long_text = F.length("t") > huge
    small = _count_small(keyed.where(~long_text), "t", path).select("row", "n_bytes", "n_tokens")
    # a key for each row, kept in a table so that all later steps see the same
    left = written(keyed.where(long_text).withColumn("key", F.expr("uuid()")), "huge")
    done = left.select("key", F.lit(0).cast("long").alias("n_tokens")).limit(0)
    todo, size = left, huge
    while not todo.isEmpty():
        step = size - overlap
        n = F.greatest(F.lit(1), F.ceil((F.length("t") - overlap) / F.lit(step)).cast("long"))
        chunks = todo.select("key", "t", n.alias("n_chunks")).select("key", "t", "n_chunks", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("k"))
        begin = F.col("k") * step
        end = F.when(F.col("k") + 1 == F.col("n_chunks"), F.length("t").cast("long")).otherwise(begin + size)
        chunks = chunks.select("key", "n_chunks", "k", begin.alias("begin"), F.substring("t", (begin + 1).cast("int"), (end - begin).cast("int")).alias("piece"))
        # a key's chunks go to many tasks
        found = _count_chunks(chunks.repartition("key", "k"), path, overlap)
        of_doc = Window.partitionBy("key").orderBy("k")
        both = found.select("key", "k", "n_chunks", "found.*").withColumn("next", F.lead("head").over(of_doc))
        same = F.filter(F.col("tail"), lambda a: F.exists("next", lambda b: (a["at"] == b["at"]) & (a["sign"] == b["sign"])))
        both = both.withColumn("same", same).withColumn("left", F.get("same", F.floor(F.size("same") / 2).cast("int")))
        right = F.get(F.filter("next", lambda b: b["at"] == F.col("left.at")), F.lit(0))
        both = both.withColumn("right", right).withColumn("from", F.coalesce(F.lag("right.before").over(of_doc), F.lit(0)))
        last = F.col("k") + 1 == F.col("n_chunks")
        ends = F.when(last, F.col("n")).otherwise(F.col("left.before"))
        sums = written(both.groupBy("key").agg(F.sum(ends - F.col("from")).alias("n_tokens"), F.bool_and(last | F.col("left").isNotNull()).alias("whole")), "counted")
        done = done.unionByName(sums.where("whole").select("key", "n_tokens"))
        todo = todo.join(sums.where("not whole").select("key"), "key", "left_semi")
        overlap, size = overlap * 4, size * 4
    large = left.join(done, "key").select("row", "n_bytes", "n_tokens")
    return small.unionByName(large).select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
