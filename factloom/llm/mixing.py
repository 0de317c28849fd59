"""Mixing sources to target weights by Pfair scheduling, with dataframe operations only.

Each source's documents are laid end to end in a pseudo-random order and cut into blocks of
``block_bytes``; a document belongs to the block in which it begins.  Block k (from 1) of a source of
weight w, a fraction of all weights taken exactly, is released at slot floor((k-1) / w) and due before
slot ceil(k / w).  Earliest-deadline-first meets every deadline, since the weights sum to 1.  So after
any number of slots a source has had its weight of them to within less than one block.

The schedule is made on the driver from the weights and the sources' numbers of blocks: one row for
each ``block_bytes`` of the input, in pieces of bounded size.  It gives the slot of block k as a table
lookup.  Places in a source are prefix sums in two levels, so that a source with most of the rows is
worked on by many tasks.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import written

_LAST = 1 << 62  # the slot of what has no weight


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares of a period, in proportion to the weights by largest remainder, each at least 1."""
    positive = {k: float(w) for k, w in weights.items() if w > 0}
    if not positive or len(positive) > period:
        raise ValueError("the period must have a slot for each source of positive weight")
    total, spare = sum(positive.values()), period - len(positive)
    exact = {k: w / total * spare for k, w in positive.items()}
    out = {k: 1 + int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k))[: period - sum(out.values())]:
        out[k] += 1
    return out


def pfair_slots(weights: dict[str, float], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """Source, number of its block, slot, release and deadline of every block, in the order of slots.

    Slots of sources that have run out stay empty where no other block is released.
    """
    exact = {k: Fraction(w) for k, w in weights.items() if w > 0}
    whole = math.lcm(*(x.denominator for x in exact.values()))
    part = {k: int(x * whole) for k, x in exact.items()}
    total = sum(part.values())
    waiting = [(0, k, 1) for k in sorted(part) if blocks.get(k, 0) > 0]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []  # deadline, source, block, release
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, k, n = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-n * total // part[k]), k, n, release))
        due, k, n, release = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        yield k, n, slot, release, due
        if n < blocks[k]:
            heapq.heappush(waiting, (n * total // part[k], k, n + 1))
        slot += 1


def pfair_period(parts: dict[str, int]) -> list[tuple[str, int, int]]:
    """Slot by slot over one period of whole shares: the source, the number of its block, and the block's deadline."""
    return [(k, n, due) for k, n, _, _, due in pfair_slots(parts, parts)]


def slot_table(spark: SparkSession, weights: dict[str, float], blocks: dict[str, int], piece: int = 1 << 20) -> DataFrame:
    """s, n, slot, release, due of every block; broadcast if it has one piece, else written piece by piece."""
    plan, one, out = pfair_slots(weights, blocks), sum(n for k, n in blocks.items() if weights.get(k, 0) > 0) <= piece, []
    while True:
        names, columns = [], [array("q") for _ in range(4)]
        for k, *values in islice(plan, piece):
            names.append(k)
            for column, x in zip(columns, values):
                column.append(min(x, _LAST - 1))
        if out and not names:
            return reduce(DataFrame.unionByName, out)
        # arrow, so that no task runs Python for it
        df = spark.createDataFrame(pa.table([pa.array(names, pa.string()), *(pa.array(np.frombuffer(c, np.int64)) for c in columns)], names=["s", "n", "slot", "release", "due"]))
        if one:
            return F.broadcast(df)
        out.append(written(df, "slots"))


def natural_weights(docs: DataFrame, length: Column, *, source: str = "source", power: float = 1.0, most: int = 100_000) -> dict[str, float]:
    """Weights in proportion to the sources' bytes to a power: 1 as they are, 0 all alike."""
    return _to_power(source_bytes(docs, length, source=source, most=most), power)


def _to_power(sizes: dict[str, int], power: float) -> dict[str, float]:
    return {s: max(1.0, float(n)) ** power for s, n in sizes.items()}


def source_bytes(docs: DataFrame, length: Column, *, source: str = "source", most: int = 100_000) -> dict[str, int]:
    """Each source's bytes; a null source is the source ''."""
    sizes = docs.groupBy(F.coalesce(source, F.lit("")).alias("s")).agg(F.sum(length).alias("n"))
    rows = sizes.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} sources; group them first")
    return {s: n for s, n in rows}


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
    size: str | None = None,
    power: float = 0.5,
    block_bytes: int = 65_536,
    period: int = 1_024,
    bucket_rows: int = 4_000,
) -> DataFrame:
    """docs with mix_block (from 1), mix_slot (from 0), mix_release, mix_deadline and mix_place.

    Sorting by (mix_slot, mix_place) gives the mixed order.  Every row comes out once: while no source
    has run out, the order holds the target weights; after that the others go on at the same rates
    among themselves.  Sources without a positive weight follow after all others, in order of their
    names.  Without ``weights`` the sources' sizes to ``power`` are taken.  A null source is the
    source ''; a null text has no bytes.  ``size`` may name a column of sizes to take instead of the
    text's bytes.  Rows with the same key and size follow one another in an order that their other
    columns give.  Texts of any length are taken whole.  An empty table gives an empty one.  Columns of docs with the new names are replaced.
    ``period`` is taken for callers that give one; the weights are exact and nothing repeats.
    """
    new = ("mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_place")
    docs = docs.drop(*new)
    length = F.coalesce(F.col(size) if size else F.octet_length(text), F.lit(0)).cast("long")
    if weights is None:
        sizes = source_bytes(docs, length, source=source)
        weights = _to_power(sizes, power)
    else:
        weights = {("" if k is None else k): w for k, w in weights.items()}
        mine = F.coalesce(source, F.lit("")).isin([k for k, w in weights.items() if w > 0])
        sizes = source_bytes(docs.where(mine), length, source=source, most=len(weights))
    blocks = {s: n // block_bytes + 1 for s, n in sizes.items()}  # a text without bytes may begin at the very end

    draw = F.xxhash64(F.col(key).cast("string"), length)
    given = docs.select(F.struct("*").alias("row"), F.coalesce(source, F.lit("")).alias("s"), length.alias("b"), draw.alias("draw"))
    # so many buckets that one holds about bucket_rows rows of the largest source
    rows = docs.groupBy(source).count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-rows // bucket_rows))
    given = given.withColumn("bucket", F.pmod("draw", F.lit(buckets)))
    at = Window.partitionBy("s", "bucket").orderBy("draw", F.col(f"row.`{key}`"), F.xxhash64("row"))
    before = F.coalesce(F.sum("b").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = given.groupBy("s", "bucket").agg(F.sum("b").alias("total"))
    earlier = F.coalesce(F.sum("total").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("s", "bucket", earlier.alias("earlier"))
    placed = given.withColumn("mix_place", before).join(sums, ["s", "bucket"]).withColumn("mix_place", F.col("mix_place") + F.col("earlier"))
    placed = placed.withColumn("mix_block", F.floor(F.col("mix_place") / block_bytes) + 1)

    slots = slot_table(docs.sparkSession, weights, blocks).withColumnsRenamed({"s": "s_", "n": "n_"})
    placed = placed.join(slots, (F.col("s") == F.col("s_")) & (F.col("mix_block") == F.col("n_")), "left")
    slot = F.coalesce("slot", F.lit(_LAST))
    return placed.select("row.*", "mix_block", slot.alias("mix_slot"), F.col("release").alias("mix_release"), F.col("due").alias("mix_deadline"), "mix_place")


def in_mixed_order(mixed: DataFrame, *, source: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows of ``mix`` range-partitioned and sorted into the mixed order."""
    order: list[Column] = [F.col("mix_slot"), F.coalesce(F.col(source), F.lit("")), F.col("mix_place"), F.col(key), F.xxhash64(*mixed.columns)]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


