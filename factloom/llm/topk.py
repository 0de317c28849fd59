"""Exact top-k search by no-random-access aggregation over sorted component lists.

Components are turned into whole numbers, so that scores are exact.  The candidates are packed in
blocks.  Within a block each dimension is a list of the vectors sorted by that component; a query
reads a list from the top where its own component is positive and from the bottom where it is
negative, so that contributions fall along every list.  Lists are read in turn, a stretch of each a
round, and what is read is added to the candidates' scores so far.  A candidate then has a lower
bound (what was read, plus the least that each unread list can give) and an upper bound (what was
read, plus what each unread list gives where it now stands).  Candidates whose upper bound is below
the k-th best lower bound, or below the k-th best score of the blocks before, cannot qualify and are
read no further.  When few are left, reading stops and their final scores are resolved from the block.

Queries are a stated set, packed in groups.  Rows are dealt to slots and groups to shards, and each slot and shard
meet in one task: it holds the lists of the slot's blocks, in bounded number, lets the groups pass, and carries each query's
best along the blocks; the lists of k are merged by Spark.  Nothing but counts passes the driver; slots and shards meet by
a shuffle and no join, so Spark has nothing to broadcast there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import discard, met, narrowed, opened, ship_package, slots_and_shards, written

#: Whole numbers below this are exact as doubles.
_EXACT = 1 << 53


class SortedLists:
    """The component lists of a block of whole-number vectors (rows by dimensions)."""

    def __init__(self, block: np.ndarray):
        self.block = block
        self.order = np.argsort(block, axis=0, kind="stable")  # ascending; read from either end
        self.sorted = np.take_along_axis(block, self.order, axis=0)

    def search(self, queries: np.ndarray, k: int, least: np.ndarray, skip: list[np.ndarray], at_once: int = 128) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows that may be among its k best, with their exact scores.

        least: a score that k candidates elsewhere reach (or a very small number); lower scores can't
        qualify.  skip: for each query the rows that are no candidates.
        """
        out = []
        for i in range(0, len(queries), at_once):
            out += self._some(queries[i : i + at_once], k, least[i : i + at_once], skip[i : i + at_once])
        return out

    def _some(self, queries: np.ndarray, k: int, least: np.ndarray, skip: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        (n, width), m = self.block.shape, len(queries)
        largest = max(0, int(self.block.max(initial=0)), -int(self.block.min(initial=0))) * int(np.abs(queries.astype(object)).sum(axis=1).max())
        if largest >= 1 << 63:
            raise OverflowError("a score does not fit into 64 bits")
        kind = np.float64 if largest < _EXACT else np.int64
        nothing = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
        queries, values = queries.astype(kind), self.sorted.astype(kind)
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        sums = np.zeros((m, n), kind)
        barred = np.zeros((m, n), bool)
        for q, rows in enumerate(skip):
            barred[q, rows] = True
        # which entries were read from the top and from the bottom, by row
        read = np.zeros((2, n, width), kind)
        depth, step, open_ = 0, max(1, n // 16), ~barred
        out: list = [None] * m
        active = np.arange(m)
        while len(active):
            end = min(n, depth + step)
            for d in range(width):
                for rows, x, own, seen in (
                    (self.order[n - end : n - depth, d], values[n - end : n - depth, d], plus[active, d], read[0]),
                    (self.order[depth:end, d], values[depth:end, d], minus[active, d], read[1])):
                    use = np.flatnonzero(own)
                    sums[np.ix_(active[use], rows)] += own[use, None] * x
                    seen[rows, d] = 1
            depth, step = end, end  # as much again
            p, q = plus[active], minus[active]
            left = [(p * x).sum(1)[:, None] - (p * x) @ read[0].T + (q * y).sum(1)[:, None] - (q * y) @ read[1].T for x, y in ((values[n - depth], values[depth - 1]), (values[0], values[-1]))]
            upper, lower = sums[active] + left[0], sums[active] + left[1]
            lower[barred[active]] = nothing
            bound = least[active].astype(kind)
            if n > k:
                bound = np.maximum(bound, np.partition(lower, n - k, axis=1)[:, n - k])
            open_[active] &= upper >= bound[:, None]
            few = (open_[active].sum(axis=1) <= max(2 * k, n // 8)) | (depth == n)
            for i in active[few]:
                rows = np.flatnonzero(open_[i])
                out[i] = rows, (self.block[rows].astype(kind) @ queries[i]).astype(np.int64)
            active = active[~few]
        return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _packed(rows: DataFrame, width: int, most: int, by: str) -> DataFrame:
    """rows(id, v, by) as (by, ids, vectors), at most ``most`` in one, none across two values of ``by``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        have, at = 0, None

        def out() -> pa.RecordBatch:
            ids, dense = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([narrowed(dense)], pa.binary())], names=[by, "ids", "vectors"])

        for batch in batches:
            ids, lists, parts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            dense = np.zeros((len(ids), width), np.int64)
            dense[np.arange(width)[None, :] < lists.value_lengths().to_numpy(zero_copy_only=False)[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(ids)]])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                while a < b:
                    if held and (parts[a] != at or have == most):
                        yield out()
                        held, have = [], 0
                    end, at = min(b, a + most - have), int(parts[a])
                    held.append((ids[a:end], dense[a:end]))
                    have, a = have + end - a, end
        if held:
            yield out()

    given = rows.select("id", "v", F.col(by).cast("long"))
    return given.repartition(by).sortWithinPartitions(by).mapInArrow(run, f"{by} long, ids binary, vectors binary")


def _found(pairs: DataFrame, k: int, width: int) -> DataFrame:
    """What met() gives of blocks(ids, vectors) and asked(q_ids, q_vectors) to query_id, vec_id, score: each query's k best of a slot's blocks."""

    def group(own: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, SortedLists]]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own]
        for ids, order, lists in blocks:
            least = np.array([s[-1] if len(s) == k else np.iinfo(np.int64).min for _, s in best], np.int64)
            low, high = (np.searchsorted(ids[order], own, side) for side in ("left", "right"))
            for i, (at, scores) in enumerate(lists.search(queries, k, least, [order[a:b] for a, b in zip(low, high)])):
                best[i] = _best(np.concatenate([best[i][0], ids[at]]), np.concatenate([best[i][1], scores]), k)
        n = [len(x) for x, _ in best]
        if sum(n):
            columns = np.repeat(own, n), np.concatenate([x for x, _ in best]), np.concatenate([s for _, s in best])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for n in range(b.num_rows) for r in b.slice(n, 1).to_pylist())
        for _, met_ in groupby(rows, key=lambda r: r["task"]):
            blocks: list[tuple[np.ndarray, np.ndarray, SortedLists]] = []
            for r in met_:
                ids = np.frombuffer(r["q_ids"] if r["is_asked"] else r["ids"], np.int64)
                if r["is_asked"]:
                    yield from group(ids, opened(r["q_vectors"], len(ids), width), blocks)
                else:
                    blocks.append((ids, np.argsort(ids, kind="stable"), SortedLists(opened(r["vectors"], len(ids), width))))

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    block_rows: int = 4_096,
    query_rows: int = 1_024,
    blocks_a_slot: int = 4,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row the k other rows of highest inner product.

    Components become floor(scale * x), x as double; ties go to the smaller id.  Rows with a null id,
    and vectors that are null or hold null or non-finite components, take no part.  A shorter vector
    counts as filled up with zeros.  A query's own id is no candidate, in whatever rows; rows with
    the same id and vector count once.  Scores are exact; one beyond 64 bits raises an error.  Other
    columns play no part.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    given = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fit)
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    given = given.select(F.col(key).cast("long").alias("id"), whole.alias("v"), is_query.alias("q")).dropDuplicates(["id", "v"])
    given = written(given, "vectors")
    rows, n, width = given.agg(F.count("*"), F.count_if("q"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    slots, shards = slots_and_shards(rows, n, width, block_rows, query_rows, blocks_a_slot)
    dealt = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n))
    asked = _packed(given.where("q").withColumn("shard", dealt(shards)), width, query_rows, "shard").withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})
    blocks = _packed(given.withColumn("slot", dealt(slots)), width, block_rows, "slot")
    found = written(_found(met(asked, blocks, slots, shards), k, width), "found")
    discard(given)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
