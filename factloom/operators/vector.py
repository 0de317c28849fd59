"""Exact nearest neighbours over evidence units, and distances between workspace names.

One query, or a few, is a driver-side literal: a filter and a projection with a top-k.  Batch search
takes a stated, bounded set of anchors through the driver.  For all units of a table see ``nearest``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import strings

#: Rows that are compared with a block of anchors at once, differences taken at once, and blocks that one scan of the units serves.
ROWS, PAIRS, BLOCKS = 1_024, 16_384, 64

# Words that name no project by themselves.
GENERIC_TERMS = ["实施计划", "项目二期", "经营方案", "月报", "周报", "复盘", "总结", "方案", "计划", "报告", "汇报", "纪要", "notes", "note",
                 "plan", "report", "draft", "misc", "temp", "tmp", "project", "projects", "工作", "文档", "资料", "通用"]
DEFAULT_TERMS = ["", "default", "默认", "none", "null", "unknown", "未知"]


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine; null if a vector has no length."""
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def knn(units: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """The k nearest of rows that were filtered before, ties by id."""
    return units.withColumn("distance", l2(F.col("embedding"), vector(query))).orderBy("distance", "unit_id").limit(k)


def memory_scores(hits: DataFrame) -> DataFrame:
    """hits(memory_id, unit_id, kind, distance): best score, and something for further kinds among ranks 2 to 4."""
    rank = F.row_number().over(Window.partitionBy("memory_id").orderBy("distance", "unit_id"))
    ranked = hits.withColumn("score", 1 - F.col("distance")).withColumn("rank", rank)
    best = ranked.where("rank = 1").select("memory_id", F.col("score").alias("best"))
    kind = F.row_number().over(Window.partitionBy("memory_id", "kind").orderBy("rank"))
    more = ranked.where("rank between 2 and 4").withColumn("turn", kind).where("turn = 1")
    extra = more.groupBy("memory_id").agg(F.sum(F.greatest(F.lit(0.0), F.col("score") - 0.45)).alias("extra"))
    return best.join(extra, "memory_id", "left").select("memory_id", "best", (F.col("best") + 0.08 * F.coalesce("extra", F.lit(0.0))).alias("score"))


def _dense(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


class Nearest:
    """The k nearest rows of other memories that each anchor has met so far; memory for the anchors, their k and some rows at a time."""

    def __init__(self, ids: np.ndarray, memories: np.ndarray, vectors: np.ndarray, k: int, block: int):
        self.ids, self.memories, self.vectors, self.k, self.block = ids, memories, vectors, k, block
        self.squares = (vectors * vectors).sum(1)
        self.unit, self.distance = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), np.inf)

    def meet(self, unit: np.ndarray, memory: np.ndarray, x: np.ndarray) -> None:
        squares = (x * x).sum(1)
        fine = np.isfinite(squares)
        for s in range(0, int(fine.sum()), ROWS):
            some = np.flatnonzero(fine)[s : s + ROWS]
            for t in range(0, len(self.ids), self.block):
                self._compare(slice(t, t + self.block), unit[some], memory[some], x[some], squares[some])

    def _compare(self, own: slice, unit: np.ndarray, memory: np.ndarray, x: np.ndarray, squares: np.ndarray) -> None:
        a = self.vectors[own]
        near = self.squares[own, None] + squares[None, :] - 2 * (a @ x.T)
        near[self.memories[own, None] == memory[None, :]] = np.inf
        # products are rounded: what may be among the nearest is worked out by differences
        cut = np.square(self.distance[own, -1])
        if len(unit) > self.k and np.isinf(cut).any():
            cut = np.minimum(cut, np.partition(near, self.k - 1, axis=1)[:, self.k - 1])
        slack = 1e-9 * (self.squares[own] + squares.max(initial=0) + 1)
        i, j = np.nonzero((near <= (cut + slack)[:, None]) & np.isfinite(near))
        for s in range(0, len(i), PAIRS):
            self._keep(own.start, i[s : s + PAIRS], j[s : s + PAIRS], a, x, unit)

    def _keep(self, start: int, i: np.ndarray, j: np.ndarray, a: np.ndarray, x: np.ndarray, unit: np.ndarray) -> None:
        d = np.sqrt(((a[i] - x[j]) ** 2).sum(-1))
        met, turn = np.unique(i, return_inverse=True)
        turn = np.concatenate([np.repeat(np.arange(len(met)), self.k), turn])
        d, unit = np.concatenate([self.distance[start + met].ravel(), d]), np.concatenate([self.unit[start + met].ravel(), unit[j]])
        order = np.lexsort((unit, d, turn))
        first = order[(np.searchsorted(turn[order], np.arange(len(met)))[:, None] + np.arange(self.k)).ravel()].reshape(-1, self.k)
        self.distance[start + met], self.unit[start + met] = d[first], unit[first]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(self.ids), PAIRS):
            d = self.distance[s : s + PAIRS]
            i, j = np.nonzero(np.isfinite(d))
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[s + i]), pa.array(self.unit[s + i, j]), pa.array(d[i, j])], names=["anchor_id", "unit_id", "distance"])


def batch_knn(units: DataFrame, anchors: DataFrame, k: int, block: int = 1_024) -> DataFrame:
    """For each anchor unit its k nearest units of other memories: anchor_id, unit_id, distance, rank.

    Anchors are broadcast, 64 blocks of at most ``block`` for a scan of the units; each task keeps k candidates an anchor from
    its own rows by matrix products of a block and some rows, and Spark merges those.  For a bounded set of anchors:
    they pass the driver, a partition at a time.  Null vectors take no part.  ``nearest.nearest_units`` takes all units.
    """
    spark = units.sparkSession
    given = lambda df: df.select("unit_id", "memory_id", "embedding").where("embedding is not null")
    parts, held = [], []

    def scan() -> None:
        shared = spark.sparkContext.broadcast(tuple(np.concatenate(x) for x in zip(*held)))
        held.clear()

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Nearest(*shared.value, k, block)
            for b in batches:
                if b.num_rows:
                    found.meet(b.column("unit_id").to_numpy(), b.column("memory_id").to_numpy(), _dense(b.column("embedding"), found.vectors.shape[1]))
            yield from found.batches()

        parts.append(given(units).mapInArrow(near, "anchor_id long, unit_id long, distance double"))

    rows = given(anchors).toLocalIterator()
    while some := list(islice(rows, block)):
        ids, memories, vectors = (np.array([r[c] for r in some]) for c in ("unit_id", "memory_id", "embedding"))
        held.append((ids, memories, vectors.astype(float)))
        if len(held) == BLOCKS:
            scan()
    if held:
        scan()
    if not parts:
        return spark.createDataFrame([], "anchor_id long, unit_id long, distance double, rank int")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy("distance", "unit_id"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank).where(F.col("rank") <= k)


def _fold(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"(?U)[\W_]+", ""))


def _words(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(x), r"(?U)[\W_]+"), lambda w: w != ""))


def guarded_distance(query: Column, record: Column, distance: Column, least: int = 3) -> Column:
    """0 for equal names; null where closeness shows nothing: reserved or short names, containment, generic words only."""
    q, r = F.trim(query), F.trim(record)
    reserved = F.lower(q).isin(*DEFAULT_TERMS) | F.lower(r).isin(*DEFAULT_TERMS)
    fq, fr = _fold(q), _fold(r)
    inside = (fq != "") & (fr != "") & (fq != fr) & (F.contains(fq, fr) | F.contains(fr, fq))
    generic, wq, wr = strings(GENERIC_TERMS), _words(q), _words(r)
    common = F.array_intersect(wq, wr)
    only_generic = (F.size(common) > 0) & (F.size(F.array_except(common, generic)) == 0)
    return (
        F.when((q == "") | (r == ""), None).when(q == r, 0.0).when(reserved, None)
        .when((F.length(q) < least) | (F.length(r) < least), None).when(inside | only_generic, None).otherwise(distance)
    )


def weak_weight(distance: Column) -> Column:
    """0.30 below 0.15, falling in a line to 0 at 0.30."""
    return F.when(distance < 0.15, 0.30).when(distance <= 0.30, 0.30 * (0.30 - distance) / 0.15).otherwise(0.0)
