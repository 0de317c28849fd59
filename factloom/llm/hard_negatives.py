"""Hard negatives from rotated one-bit codes with stored alignments and exact intervals.

Vectors of whole numbers are turned by one fixed rotation, and a row keeps the sign of each turned component
(its code), its length, and its alignment: the cosine between the row and the code's own direction.
What the code leaves out of a row is then a residual at right angles to the code, of known length.
An anchor is turned too and rounded to bit planes, so that its product with a code is a sum of
popcounts.  The product of anchor and row is the code's part, which that gives up to the rounding, and
the product of both residuals, which by Cauchy and Schwarz is at most that of their lengths.  So
every row has an interval that surely holds its score.  Rows whose interval lies outside what is asked,
or below the k-th best score found so far, are left out; the others are scored as whole numbers.

Two such searches follow each other: each anchor's best rows of its own label, its positives; then for each
positive the best rows of other labels within a range of scores that the positive sets.  Anchors are a stated
set, packed in groups.  Rows are dealt to slots and groups to shards, and each slot and shard meet in one task: it holds the
slot's rows and their codes, in bounded number, lets the groups pass, and carries each group's best along its blocks; the
short lists are merged by Spark.  Nothing but counts passes the driver; slots and shards meet by a shuffle and no join,
so Spark has nothing to broadcast there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import discard, met, narrowed, opened, ship_package, slots_and_shards, written

#: Bit planes of an anchor's turned components.
PLANES = 8
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Whole numbers below this are exact as doubles.
_EXACT = 1 << 53


def rotation(width: int) -> np.ndarray:
    """A fixed random rotation."""
    return np.linalg.qr(np.random.default_rng(width).normal(size=(width, width)))[0]


def _packed_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of truth values as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


class Codes:
    """One-bit codes of rows of whole numbers, with their lengths and alignments."""

    def __init__(self, rows: np.ndarray, turn: np.ndarray):
        turned = rows.astype(float) @ turn
        self.bits = _packed_bits(turned >= 0)
        self.ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.length = np.linalg.norm(turned, axis=1)
        self.aligned = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[0])  # length times alignment
        self.residual = np.sqrt(np.maximum(self.length**2 - self.aligned**2, 0))

    def intervals(self, anchors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds that surely hold the product of each anchor with each row."""
        turned = anchors.astype(float) @ turn
        width = turn.shape[0]
        low = turned.min(axis=1, keepdims=True)
        step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-300)
        levels = np.rint((turned - low) / step).astype(np.int64)
        rounded = np.linalg.norm(turned - (low + step * levels), axis=1)[:, None]
        # the sum of the levels where the code is 1, plane by plane
        inside = np.zeros((len(anchors), len(self.ones)), np.int64)
        for j in range(PLANES):
            plane = _packed_bits((levels >> j) & 1 == 1)
            for word in range(plane.shape[1]):
                inside += np.bitwise_count(plane[:, word, None] & self.bits[None, :, word]).astype(np.int64) << j
        signed = 2 * inside - levels.sum(axis=1, keepdims=True)
        along = (low * (2 * self.ones[None, :] - width) + step * signed) / np.sqrt(width)
        length = np.linalg.norm(turned, axis=1)[:, None]
        across = np.sqrt(np.maximum(length**2 - np.maximum(np.abs(along) - rounded, 0) ** 2, 0))
        reach = rounded * self.aligned[None, :] + across * self.residual[None, :]
        reach += 1e-9 * length * self.length[None, :] + 1e-6  # for the rounding of doubles
        centre = along * self.aligned[None, :]
        return centre - reach, centre + reach


class _Block:
    """Rows of a slot, as they are held while groups of anchors pass."""

    def __init__(self, r: dict, width: int, turn: np.ndarray):
        self.ids, self.labels = np.frombuffer(r["b_id"], np.int64), np.frombuffer(r["b_label"], np.int64)
        self.rows = opened(r["b_v"], len(self.ids), width)
        self.largest = max(int(self.rows.max(initial=0)), -int(self.rows.min(initial=0)))
        self.codes = Codes(self.rows, turn)


def best_within(
    block: np.ndarray, ids: np.ndarray, allowed: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray,
    ranges: list[tuple[int, int]], k: int, held: list[tuple[np.ndarray, np.ndarray]],
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each range (least, most) the k best of what is held (ids, scores) and the block's allowed rows of least <= score <= most.

    low, high: the rows' intervals.  A range's rows of the highest upper bound are scored first, as those
    reached bound all others.  A row is scored once for all ranges.
    """
    at = np.flatnonzero(allowed)
    ids, low, high = ids[at], low[at], high[at]
    scores, known = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    reached = lambda least, s: max(least, int(np.partition(s, len(s) - k)[len(s) - k])) if len(s) >= k else least
    floors = [reached(least, s) for (least, _), (_, s) in zip(ranges, held)]
    for rest in (False, True):
        new = np.zeros(len(ids), bool)
        for (_, most), floor in zip(ranges, floors):
            open_ = np.flatnonzero((high >= floor) & (low <= most))
            if not rest and len(open_) > 4 * k:
                open_ = open_[np.argpartition(-high[open_], 4 * k)[: 4 * k]]
            new[open_] = True
        new = np.flatnonzero(new & ~known)
        if not len(new):
            break
        # of many rows the products are taken without picking rows first
        scores[new] = block[at[new]] @ anchor if len(new) < len(block) // 4 else (block @ anchor)[at[new]]
        known[new] = True
        s = scores[known]
        floors = [reached(floor, np.concatenate([old, s[(s >= floor) & (s <= most)]])) for (_, most), floor, (_, old) in zip(ranges, floors, held)]
    out = []
    for (_, most), floor, (old_ids, old) in zip(ranges, floors, held):
        fit = np.flatnonzero(known & (scores >= floor) & (scores <= most))
        own, s = np.concatenate([old_ids, ids[fit]]), np.concatenate([old, scores[fit]])
        order = np.lexsort((own, -s))[:k]
        out.append((own[order], s[order]))
    return out


def _pack(rows: DataFrame, columns: list[str], lists: dict[str, int], most: int) -> DataFrame:
    """rows(part, columns ..., lists ...) as blocks of one part: each column's numbers as bytes, and the lists, filled up with zeros to their width."""
    names = [*columns, *lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have, at = [], 0, 0

        def out() -> pa.RecordBatch:
            whole = [np.concatenate(x) for x in zip(*held)]
            whole = [narrowed(x) if c in lists else x.tobytes() for c, x in zip(names, whole)]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64())] + [pa.array([x], pa.binary()) for x in whole], names=["part", *names])

        for batch in batches:
            numbers = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
            for c, width in lists.items():
                dense = np.zeros((batch.num_rows, width), np.int64)
                dense[np.arange(width)[None, :] < batch.column(c).value_lengths().to_numpy(zero_copy_only=False)[:, None]] = batch.column(c).flatten().to_numpy(zero_copy_only=False)
                numbers.append(dense)
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)]]).tolist()
            for a, b in zip(cut[:-1], cut[1:]):
                while a < b:
                    if held and (parts[a] != at or have >= most):
                        yield out()
                        held, have = [], 0
                    end, at = min(b, a + most - have), int(parts[a])
                    held.append([x[a:end] for x in numbers])
                    have, a = have + end - a, end
        if held:
            yield out()

    ordered = rows.select("part", *names).repartition("part").sortWithinPartitions("part", columns[0])
    return ordered.mapInArrow(run, "part long, " + ", ".join(f"{c} binary" for c in names))


def _search(pairs: DataFrame, width: int, k: int, per_anchor: int = 0) -> DataFrame:
    """anchor, id, score: for each asked row the k best rows of its label among a slot's blocks.

    pairs: what met() gives of blocks(b_id, b_label, b_v) and asked(anchor, label, v).  With per_anchor, asked has also n and
    ranges, each row's positives as up to so many (positive, positive_score, least, most); for each comes the k best of other labels
    from least to most, with positive and positive_score.
    """
    names = ["anchor", "positive", "positive_score"] if per_anchor else ["anchor"]

    def group(r: dict, blocks: list[_Block], turn: np.ndarray) -> Iterator[pa.RecordBatch]:
        anchors, labels = np.frombuffer(r["anchor"], np.int64), np.frombuffer(r["label"], np.int64)
        own = opened(r["v"], len(anchors), width).astype(np.int64)
        named, ranges = [(a,) for a in anchors], [[(_LEAST, _MOST)]] * len(anchors)
        if per_anchor:
            given = [x[:n].tolist() for x, n in zip(opened(r["ranges"], len(anchors), 4 * per_anchor).reshape(-1, per_anchor, 4), np.frombuffer(r["n"], np.int64))]
            named, ranges = [(a, p, s) for a, x in zip(anchors, given) for p, s, *_ in x], [[(least, most) for *_, least, most in x] for x in given]
        held = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(x) for x in ranges]
        length = max(sum(map(abs, x)) for x in own.tolist())
        for block in blocks:
            if (largest := block.largest * length) >= 1 << 63:
                raise OverflowError("a score does not fit into 64 bits")
            kind = np.float64 if largest < _EXACT else np.int64
            rows, asked = block.rows.astype(kind), own.astype(kind)
            low, high = block.codes.intervals(own, turn)
            for i in range(len(anchors)):
                allowed = ((block.labels == labels[i]) != bool(per_anchor)) & (block.ids != anchors[i])
                held[i] = best_within(rows, block.ids, allowed, asked[i], low[i], high[i], ranges[i], k, held[i])
        best = [x for some in held for x in some]
        n = [len(x) for x, _ in best]
        if sum(n):
            values = [np.repeat(np.array(x, np.int64), n) for x in zip(*named)] + [np.concatenate(x) for x in zip(*best)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in values], names=[*names, "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(width)
        rows = (r for b in batches for n in range(b.num_rows) for r in b.slice(n, 1).to_pylist())
        for _, own in groupby(rows, key=lambda r: r["task"]):
            blocks: list[_Block] = []
            for r in own:
                if r["is_asked"]:
                    yield from group(r, blocks, turn)
                else:
                    blocks.append(_Block(r, width, turn))

    return pairs.mapInArrow(run, "".join(f"{c} long, " for c in names) + "id long, score long")


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    *,
    key: str = "vec_id",
    label: str | Column = "label",
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
    block_rows: int = 4_096,
    group_rows: int = 256,
    blocks_a_slot: int = 64,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Each anchor's positives are its first other rows of the same label by score, ties to the smaller id; for
    each of them come the first rows of other labels whose score is at least ``least_percent`` and at most ``most_percent``
    hundredths of the positive's.  Components become floor(scale * x), x as double; scores are exact, one beyond 64 bits
    raises an error.  Rows with a null id or label, and vectors that are null or hold null or
    non-finite components, take no part.  A shorter vector counts as filled up with zeros, an empty one as
    zeros alone.  A row's own id is no candidate, in whatever rows; rows with the same id, label and vector
    count once.  A positive of a negative score has no negatives.  Other columns play no part.  An empty
    table gives an empty result.
    """
    spark = rows.sparkSession
    ship_package(spark)
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    named = F.col(label) if isinstance(label, str) else label
    given = rows.where(F.col(key).isNotNull() & named.isNotNull() & F.col(vector).isNotNull() & fit)
    given = given.select(F.col(key).cast("long").alias("id"), named.cast("long").alias("label"), whole.alias("v"), is_anchor.alias("asked")).dropDuplicates(["id", "label", "v"])
    given = written(given, "vectors")
    n, anchors, width = given.agg(F.count("*"), F.count_if("asked"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    slots, shards = slots_and_shards(n, anchors, width, block_rows, group_rows, blocks_a_slot)
    blocks = _pack(given.withColumn("part", F.pmod(F.xxhash64("id", "label", "v"), F.lit(slots))), ["id", "label"], {"v": width}, block_rows)
    blocks = written(blocks.withColumnsRenamed({"part": "slot", "id": "b_id", "label": "b_label", "v": "b_v"}), "blocks")

    def search(asked: DataFrame, columns: list[str], lists: dict[str, int], k: int, per_anchor: int = 0) -> DataFrame:
        asked = asked.withColumn("part", F.pmod(F.xxhash64("anchor", "v"), F.lit(shards)))
        packed = _pack(asked, columns, {"v": width, **lists}, group_rows).withColumnRenamed("part", "shard")
        return _search(met(packed, blocks, slots, shards), width, k, per_anchor)

    own = given.where("asked").select(F.col("id").alias("anchor"), "label", "v")
    first = _ranked(search(own, ["anchor", "label"], {}, positives), ["anchor"], positives)
    # 100 * s between the percentages of the positive's score, as whole numbers of s
    low, high = f"{least_percent} * positive_score", f"{most_percent} * positive_score"
    pairs = first.select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    pairs = pairs.withColumns({"least": F.expr(f"({low} + pmod(-({low}), 100L)) div 100"), "most": F.expr(f"({high} - pmod({high}, 100L)) div 100")})
    pairs = written(pairs.where("least <= most"), "positives")
    ranges = F.collect_list(F.array("positive", "positive_score", "least", "most"))
    ranged = pairs.groupBy("anchor").agg(F.count("*").alias("n"), F.flatten(ranges).alias("ranges")).join(own.hint("merge"), "anchor")
    found = written(search(ranged, ["anchor", "label", "n"], {"ranges": 4 * positives}, negatives, positives), "found")
    discard(given, blocks, pairs)
    out = _ranked(found, ["anchor", "positive"], negatives)
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
