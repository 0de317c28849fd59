"""Exact nearest neighbours of many units among all units, pruned by pivots and the triangle inequality.

Equal vectors are searched for once, and of each only as many units are kept as any search can ask for, so a
large group of copies is not compared with itself.  Vectors are dealt to the nearest of a few
pivots, put in order of their distance to it, and cut into blocks of one cell and a narrow range of
distances.  A vector's own block gives a first bound on its k-th distance.  A vector a with bound t and distance d to a
block's pivot can have a neighbour there only if the block's range meets d - t to d + t, and if half of what d
is over a's distance to its own pivot is within t.  So each vector meets those blocks alone, and there those
rows alone; how many distances were worked out comes with the result.

Vectors stay together by neighbouring blocks, in groups, and the blocks that a group needs are dealt out in slots.  A task reads a group
once for a slot and lets its blocks pass, with bounds that fall as it goes on, so what is sent is a copy of a block for a group, not for a vector,
and what is found is a vector's best of a slot, not of each block.

Only the pivots and a row for each block pass the driver; both are of bounded number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.commits import written

#: Most pivots.
PIVOTS = 64
#: Rows of a block, and the most blocks that are told to all tasks; with more rows than both allow, blocks grow.
BLOCK_ROWS, MOST_BLOCKS = 4_096, 100_000
#: Asked vectors of a group and rows of a slot, about.
GROUP_ROWS, SLOT_ROWS = 16_384, 65_536
_ENTRY = "vid long, cell int, d double, unit_id long, memory_id long, asked boolean, embedding array<double>"
_BLOCK = "block long, cell int, low double, high double, n long, n_asked long, ids binary, vectors binary, d binary"


def _dense(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _distances(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Between matching rows; where exact values are compared they all come from here."""
    return np.sqrt(((a - x) ** 2).sum(axis=1))


def _thinned(i: np.ndarray, ids: np.ndarray, memories: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Which entries stay, in order of i, distance and id: of each i and memory the first k."""
    order = np.lexsort((ids, d, i))
    i, memories = i[order], memories[order]
    # the place of each entry among those of its memory
    own = np.lexsort((np.arange(len(i)), memories, i))
    new = np.ones(len(i), bool)
    new[1:] = (i[own][1:] != i[own][:-1]) | (memories[own][1:] != memories[own][:-1])
    place = np.empty(len(i), np.int64)
    place[own] = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
    return order[place < k]


def best_entries(a: np.ndarray, rows: np.ndarray, ids: np.ndarray, memories: np.ndarray, k: int, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector of a the entries it may need: (number of a, number of the row, distance), at most 2 k each.

    No distance is over ``within``.  Of one memory at most k entries count, so whichever memory is left out, k stay if there are.
    """
    squares = (a * a).sum(1)[:, None] + (rows * rows).sum(1)[None, :] - 2 * (a @ rows.T)
    slack = 1e-9 * (np.abs(squares).max(initial=0) + 1)
    n = min(2 * k, len(rows))
    while True:
        cut = np.partition(squares, n - 1, axis=1)[:, n - 1]
        i, j = np.nonzero(squares <= (np.minimum(cut, np.square(within)) + slack)[:, None])
        d = np.concatenate([_distances(a[i[s : s + 65_536]], rows[j[s : s + 65_536]]) for s in range(0, len(i), 65_536)] or [np.zeros(0)])
        fit = d <= within[i]
        i, j, d = i[fit], j[fit], d[fit]
        kept = _thinned(i, ids[j], memories[j], d, k)
        i, j, d = i[kept], j[kept], d[kept]
        short = (np.bincount(i, minlength=len(a)) < 2 * k) & (cut < np.square(within))
        if n == len(rows) or not short.any():
            break
        n = min(4 * n, len(rows))  # one memory fills the places: look further
    keep = np.arange(len(i)) - np.searchsorted(i, i) < 2 * k
    return i[keep], j[keep], d[keep]


def _blocks(entries: DataFrame, block: int) -> DataFrame:
    """Entries in order of cell and distance, cut into rows of at most ``block`` of one cell; asked vectors are marked at one entry of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        have, at = 0, -1

        def out() -> pa.RecordBatch:
            ids, vectors, d = (np.concatenate(x) for x in zip(*held))
            values = [at, float(d.min()), float(d.max()), len(d), int(ids[:, 3].sum()), ids.tobytes(), vectors.tobytes(), d.tobytes()]
            names = ["cell", "low", "high", "n", "n_asked", "ids", "vectors", "d"]
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

        for b in batches:
            cells, d = b.column("cell").to_numpy(), b.column("d").to_numpy()
            ids = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vid", "unit_id", "memory_id", "asked")], axis=1)
            vectors = _dense(b.column("embedding"))
            cut = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for s, e in zip(cut[:-1], cut[1:]):
                while s < e:
                    if held and (cells[s] != at or have >= block):
                        yield out()
                        held, have = [], 0
                    end, at = min(e, s + block - have), int(cells[s])
                    held.append((ids[s:end], vectors[s:end], d[s:end]))
                    have, s = have + end - s, end
        if held:
            yield out()

    ordered = entries.repartitionByRange("cell", "d", "unit_id").sortWithinPartitions("cell", "d", "unit_id")
    packed = ordered.select(*(x.split()[0] for x in _ENTRY.split(", "))).mapInArrow(run, _BLOCK.replace("block long, ", ""))
    return packed.withColumn("block", F.monotonically_increasing_id())


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64).reshape(-1, 4)
    return ids, np.frombuffer(row["vectors"], float).reshape(len(ids), -1), np.frombuffer(row["d"], float)


_FOUND = "vid long, unit_id long, memory_id long, distance double, evaluated long"


_STRIP = "grp int, home long, to array<long>, a_vids binary, a_vectors binary, a_bounds binary, a_d binary"


class _Strip:
    """Some asked vectors of one block, with the bounds they have and the best entries that they have met in other blocks."""

    def __init__(self, row: dict, k: int):
        self.home, self.k = row["block"], k
        self.vids, self.bounds, self.d = (np.frombuffer(row[c], t) for c, t in (("a_vids", np.int64), ("a_bounds", float), ("a_d", float)))
        self.bounds = self.bounds.copy()
        self.x = np.frombuffer(row["a_vectors"], float).reshape(len(self.vids), -1)
        self.evaluated = np.zeros(len(self.vids), np.int64)
        none = np.zeros(0, np.int64)
        self.i, self.units, self.memories, self.distances = none, none, none, np.zeros(0)

    def meet(self, row: dict, ids: np.ndarray, x: np.ndarray, d: np.ndarray, centre: np.ndarray) -> None:
        if row["block"] == self.home:
            return
        reach, to = self.bounds * (1 + 1e-9) + 1e-9, _distances(self.x, centre[None, :])
        g = np.flatnonzero((to - reach <= row["high"]) & (to + reach >= row["low"]) & (to - self.d <= 2 * reach))
        if not len(g):
            return
        s, e = (int(f(np.searchsorted(d, v, side))) for f, v, side in ((np.min, (to - reach)[g], "left"), (np.max, (to + reach)[g], "right")))
        if s == e:
            return
        i, j, found = best_entries(self.x[g], x[s:e], ids[s:e, 1], ids[s:e, 2], self.k, self.bounds[g])
        self.evaluated[g] += e - s
        i, units, memories, distances = (np.concatenate(v) for v in ((self.i, g[i]), (self.units, ids[s:e, 1][j]), (self.memories, ids[s:e, 2][j]), (self.distances, found)))
        kept = _thinned(i, units, memories, distances, self.k)
        kept = kept[np.arange(len(kept)) - np.searchsorted(i[kept], i[kept]) < 2 * self.k]
        self.i, self.units, self.memories, self.distances = i[kept], units[kept], memories[kept], distances[kept]
        full = np.flatnonzero(np.bincount(self.i, minlength=len(self.vids)) == 2 * self.k)
        last = self.distances[np.searchsorted(self.i, full, side="right") - 1]
        self.bounds[full] = np.minimum(self.bounds[full], last)

    def found(self) -> pa.RecordBatch:
        ids = np.stack([self.vids[self.i], self.units, self.memories], axis=1)
        return _found_batch(self.vids, ids, self.i, np.arange(len(self.i)), self.distances, self.evaluated)


def _found_batch(vids: np.ndarray, ids: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray, evaluated: np.ndarray) -> pa.RecordBatch:
    """Found entries, and a row without one for each vector with its number of distances."""
    none = [None] * len(vids)
    columns = [np.concatenate([vids[i], vids]), ids[j, 1].tolist() + none, ids[j, 2].tolist() + none, d.tolist() + none, np.concatenate([np.zeros(len(i), np.int64), evaluated])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["vid", "unit_id", "memory_id", "distance", "evaluated"])


def nearest_units(units: DataFrame, k: int, *, pivots: int | None = None, block_rows: int = BLOCK_ROWS, strip: int = 256) -> DataFrame:
    """For each unit that is ``asked`` its k nearest units of other memories: anchor_id, unit_id, distance, rank, evaluated.

    units(unit_id, memory_id, embedding, asked); ties go to the smaller unit_id.  evaluated is the number of
    distances worked out for the unit's vector, which units with equal vectors share.  Vectors are of one
    length; null ones take no part.  There is a pivot for each 1,024 units, up to 64, unless a number is given.
    units are read twice: best a written table.
    """
    spark = units.sparkSession
    given = units.where("embedding is not null").select("unit_id", "memory_id", "embedding", "asked")
    vectors = given.groupBy("embedding").agg(F.min("unit_id").alias("vid"), F.bool_or("asked").alias("vector_asked"), F.count("*").alias("copies"))
    named = written(given.join(vectors, "embedding"), "named")
    by = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy("unit_id"))
    # of equal vectors the first 2 k units, and of one memory the first k of them
    some = named.withColumn("own", by("vid", "memory_id")).where(F.col("own") <= k).withColumn("turn", by("vid")).where(F.col("turn") <= 2 * k)
    pivots = pivots or min(PIVOTS, 1 + named.count() // 1_024)
    chosen = [r.embedding for r in named.where("vid = unit_id").orderBy(F.xxhash64("vid"), "vid").limit(pivots).select("embedding").collect()]
    if not chosen:
        return spark.createDataFrame([], "anchor_id long, unit_id long, distance double, rank int, evaluated long")
    centres = spark.sparkContext.broadcast(np.array(chosen, float))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _dense(b.column("embedding"))
            every = np.stack([_distances(x, p[None, :]) for p in c], axis=1)
            cell = every.argmin(axis=1)
            columns = [b.column("vid"), pa.array(cell.astype(np.int32)), pa.array(every[np.arange(len(x)), cell]), b.column("unit_id"), b.column("memory_id"), b.column("asked"), b.column("embedding")]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ENTRY.split(", ")])

    first = some.withColumn("asked", F.col("vector_asked") & (F.col("turn") == 1)).select("vid", "unit_id", "memory_id", "asked", "embedding")
    entries = written(first.mapInArrow(to_cells, _ENTRY), "entries")
    size = max(block_rows, -(-entries.count() // MOST_BLOCKS))
    blocks = written(_blocks(entries, size), "blocks")
    ranges = spark.sparkContext.broadcast(tuple(np.array(x) for x in zip(*sorted(blocks.select("block", "cell", "low", "high").collect(), key=lambda r: (r.cell, r.low, r.block)))))
    n_blocks = len(ranges.value[0])
    together = max(1, min(GROUP_ROWS // size, n_blocks // 16))
    slot = F.pmod(F.xxhash64("block"), F.lit(-(-n_blocks * size // SLOT_ROWS))).cast("int")

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each asked vector within its own block, and the bound on its distances that this gives; and where else it has to go."""
        centre, (block, cell, low, high) = centres.value, ranges.value
        for row in (r for b in batches for r in b.to_pylist()):
            ids, x, d = _opened(row)
            asked = np.flatnonzero(ids[:, 3])
            for s in range(0, len(asked), strip):
                own = asked[s : s + strip]
                i, j, found = best_entries(x[own], x, ids[:, 1], ids[:, 2], k, np.full(len(own), np.inf))
                bound = np.full(len(own), np.inf)
                full = np.bincount(i, minlength=len(own)) == 2 * k
                last = np.searchsorted(i, np.arange(len(own)), side="right") - 1
                bound[full] = found[last[full]]
                near = np.stack([_distances(x[own], p[None, :]) for p in centre], axis=1)
                reach = bound * (1 + 1e-9) + 1e-9
                to = near[:, cell]
                go = (to - reach[:, None] <= high) & (to + reach[:, None] >= low) & (to - d[own][:, None] <= 2 * reach[:, None]) & (block != row["block"])
                values = _found_batch(ids[own, 0], ids, i, j, found, np.full(len(own), len(x), np.int64))
                yield pa.RecordBatch.from_arrays([*values.columns, *(pa.nulls(values.num_rows, t) for t in kinds)], names=names)
                if go.any():
                    group = int(np.flatnonzero(block == row["block"])[0]) // together
                    sent = [group, int(row["block"]), block[go.any(axis=0)].tolist(), ids[own, 0].tobytes(), x[own].tobytes(), bound.tobytes(), d[own].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())] + [pa.array([v], t) for v, t in zip(sent, kinds)], names=names)

    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
    names = [*(x.split()[0] for x in _FOUND.split(", ")), *(x.split()[0] for x in _STRIP.split(", "))]
    seeded = written(blocks.where("n_asked > 0").mapInArrow(seed, f"{_FOUND}, {_STRIP}"), "seeded")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The strips of a group, and then the blocks of a slot as they pass, against those of their rows that the triangle inequality leaves."""
        at, strips = None, []
        for row in (r for b in batches for n in range(b.num_rows) for r in b.slice(n, 1).to_pylist()):
            if (row["grp"], row["slot"]) != at:
                yield from (s.found() for s in strips)
                at, strips = (row["grp"], row["slot"]), []
            if row["ids"] is None:
                strips.append(_Strip(row, k))
            else:
                block = _opened(row)
                for s in strips:
                    s.meet(row, *block, centres.value[row["cell"]])
        yield from (s.found() for s in strips)

    strips = seeded.where("grp is not null").select(*(x.split()[0] for x in _STRIP.split(", ")))
    to = strips.select("grp", F.explode("to").alias("block")).distinct().withColumn("slot", slot)
    near_blocks = blocks.select("block", "cell", "low", "high", "ids", "vectors", "d").join(to, "block")
    near_strips = strips.join(to.select("grp", "slot").distinct(), "grp").drop("to").withColumnRenamed("home", "block")
    met = near_strips.unionByName(near_blocks, allowMissingColumns=True).repartition("grp", "slot")
    visited = met.sortWithinPartitions("grp", "slot", F.col("ids").isNotNull(), "block").mapInArrow(visit, _FOUND)
    found = written(seeded.where("grp is null").select(*(x.split()[0] for x in _FOUND.split(", "))).unionByName(visited), "found")
    order = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy("distance", "unit_id"))
    evaluated = found.groupBy("vid").agg(F.sum("evaluated").alias("evaluated"))
    best = found.where("unit_id is not null").drop("evaluated").withColumn("own", order("vid", "memory_id")).where(F.col("own") <= k)
    best = best.withColumn("turn", order("vid")).where(F.col("turn") <= 2 * k).select("vid", "unit_id", "memory_id", "distance").join(evaluated, "vid")
    anchors = named.where("asked").select("vid", F.col("unit_id").alias("anchor_id"), F.col("memory_id").alias("anchor_memory"))
    near = anchors.join(best, "vid").where("memory_id <> anchor_memory")
    return near.withColumn("rank", order("anchor_id")).where(F.col("rank") <= k).select("anchor_id", "unit_id", "distance", "rank", "evaluated")
