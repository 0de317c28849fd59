"""Repeated byte strings by distributed prefix doubling over content-defined positions.

A text's positions at which a hash of the next bytes is the least of its neighbourhood are chosen by
content alone, so equal strings have equal positions inside.  The text between two of them is a
block.  Spark ranks the blocks, then pairs of ranks at growing offsets (1, 2, 4 ... blocks), sorting
the pairs and reranking those that occur again; a run of blocks that is unique, or whose neighbour
is, is not followed further, nor one longer than the threshold.  A string of the threshold's length
that holds a unique run is unique itself.  What is left, strings all of whose runs occur again, goes
in stretches: neighbouring strings with the same blocks inside.  Stretches that are equal as a whole
are repeated, with one comparison for all their strings; where stretches have the blocks in common
but not what is around them, as at the ends of a passage, their strings are compared one by one.
Comparisons are of 128-bit digests of all the bytes; a task sends each digest once, so a passage that
a third of all texts hold is a row a task.

Texts that are equal as a whole are ranked once: all their strings are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import discard, keep_matching, ship_package, written

GRAM = 8
_BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5)
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
_SPAN = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    key = (base, inverse)
    if key not in _POWERS or len(_POWERS[key]) < n:
        b = pow(base, -1, 1 << 64) if inverse else base
        size = max(n, 1 << 16)
        _POWERS[key] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]))
    return _POWERS[key][:n]


def prefix_sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums of byte values times powers of a base, modulo 2**64, with which any string's hash is two look-ups."""
    return np.concatenate([[np.uint64(0)], np.add.accumulate(_RANDOM[which][data] * _powers(_BASES[which], len(data)))])


def string_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    h = (sums[end] - sums[begin]) * _powers(_BASES[which], len(sums), True)[begin]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sync_positions(data: np.ndarray, reach: int) -> np.ndarray:
    """Positions whose hash of the next bytes is below all within reach before and not above any after."""
    n = len(data) - GRAM + 1
    if n < 2 * reach + 1:
        return np.zeros(0, np.int64)
    words = np.zeros(n, np.uint64)
    for k in range(GRAM):
        words |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    words = (words ^ (words >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    words = (words ^ (words >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    words ^= words >> np.uint64(33)
    # least of each run of `reach` hashes, by doubling
    least, size = words, 1
    while size * 2 <= reach:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    run = np.minimum(least[: n - reach + 1], least[reach - size :][: n - reach + 1])
    at = np.arange(reach, n - reach)
    return at[(words[at] < run[at - reach]) & (words[at] <= run[at + 1])]


def _blocks(texts: DataFrame, length: int, reach: int) -> DataFrame:
    """texts(key, t) to key, n, at (block ends and starts as bytes), names (of the blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = np.frombuffer(t.encode(), np.uint8)
                at = sync_positions(data, reach)
                names = string_hashes(prefix_sums(data), at[:-1], at[1:]) if len(at) > 1 else np.zeros(0, np.uint64)
                rows.append((key, len(data), at.astype("<i4").tobytes(), names.view(np.int64)))
            kinds = pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=["key", "n", "at", "names"])

    return texts.mapInArrow(run, "key long, n long, at binary, names array<long>")


def _rerank(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written runs(key, i, x, y, first, second) split into those that occur again, reranked, and the unique ones; and the ranks."""
    again = runs.groupBy("first", "second").count().where("count > 1").drop("count")
    order = again.repartitionByRange("first", "second").sortWithinPartitions("first", "second")
    ranks = written(order.withColumn("rank", F.monotonically_increasing_id()), "ranks")
    marked = runs.join(ranks, ["first", "second"], "left")
    return marked.where("rank is not null").select("key", "i", "x", "y", "rank"), marked.where("rank is null").select("key", "x", "y"), ranks


def _windows(held: DataFrame, length: int, reach: int) -> DataFrame:
    """held(key, n, at, alive, breaks) to (key, open): where strings begin that may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, opens = [], []
            for key, n, data, alive, breaks in zip(*(c.to_pylist() for c in b.columns)):
                at = np.frombuffer(data, "<i4").astype(np.int64)
                single = np.ones(max(0, len(at) - 1), bool)
                single[alive or []] = False
                x, y = at[:-1][single] if len(at) else at, at[1:][single] if len(at) else at
                if breaks:
                    x = np.concatenate([x, [p["a"] for p in breaks]])
                    y = np.concatenate([y, [p["b"] for p in breaks]])
                # the choice of x and y depends on bytes from x - reach to y + reach + GRAM: a string that
                # holds all these has the same run wherever it is, and is unique if the run is
                low, high = np.maximum(0, y + reach + GRAM - length), np.minimum(x - reach, n - length)
                ok = low <= high
                shut = np.zeros(n - length + 2, np.int64)
                np.add.at(shut, low[ok], 1)
                np.add.at(shut, high[ok] + 1, -1)
                free = np.concatenate([[0], (np.cumsum(shut)[:-1] == 0).astype(np.int8), [0]])
                edge = np.flatnonzero(np.diff(free))
                if len(edge):
                    keys.append(key)
                    opens.append([{"a": int(a), "b": int(z)} for a, z in zip(edge[::2], edge[1::2])])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(opens, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], names=["key", "open"])

    return held.mapInArrow(run, T.StructType([T.StructField("key", T.LongType()), T.StructField("open", T.ArrayType(_SPAN))]))


def _stretches(texts: DataFrame, length: int, reach: int) -> DataFrame:
    """texts(key, t, open) to stretches: neighbouring strings with the same first and last sync position inside.

    Equal strings have both at the same places, so they lie in stretches with the same ``middle``, the
    bytes around and between the two positions, by whose digest (m1, m2) stretches are grouped; what
    is before and after it (head, tail) tells the strings of a stretch apart.  Three kinds of rows:
    each stretch, with its key, where it begins (a), how many strings it has (n) and the digest of
    all its bytes (c1, c2); for each task once, what is to be known of each digest (with head, tail
    and how often the task met it, times); and places (key, a, n) already known to be repeated.

    A string without a sync position inside is a stretch of its own and all middle, in one row; they
    come from words said over and over, so those that a text has several times are told at once.
    """
    names = ["key", "a", "n", "c1", "c2", "m1", "m2", "head", "tail", "times"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.binary(), pa.int32()]

    def halves(data: bytes) -> tuple[int, int]:
        d = xxhash.xxh3_128_intdigest(data)
        return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list] = {}
        rows: list[tuple] = []

        def out(all_: bool) -> Iterator[pa.RecordBatch]:
            if all_ or len(known) > 100_000:
                rows.extend((None, None, n, *c, *halves(middle), head, tail, times) for c, (n, middle, head, tail, times) in known.items())
                known.clear()
            if rows and (all_ or len(rows) > 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)
                rows.clear()

        def meet(key: int, raw: bytes, p: int, n: int, x: int, y: int) -> None:
            """The stretch of n strings from p on, of which x to y is the middle."""
            end = p + n - 1 + length
            c = halves(b"%d %d " % (n, x - p) + raw[p:end])
            if c in known:
                known[c][4] += 1
            else:
                known[c] = [n, raw[x:y], raw[p:x], raw[y:end], 1]
            rows.append((key, p, n, *c, None, None, None, None, None))

        for b in batches:
            for key, t, spans in zip(*(c.to_pylist() for c in b.columns)):
                raw = t.encode()
                data = np.frombuffer(raw, np.uint8)
                sync = sync_positions(data, reach)
                at = np.concatenate([np.arange(s["a"], s["b"]) for s in spans])
                first = np.searchsorted(sync, at + reach)
                last = np.searchsorted(sync, at + (length - reach - GRAM), "right") - 1
                inside = first <= last
                lone = at[~inside]
                if len(lone):
                    h = string_hashes(prefix_sums(data), lone, lone + length) ^ (string_hashes(prefix_sums(data, 1), lone, lone + length, 1) << np.uint64(1))
                    _, place, back, k = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                    for p, times in zip(lone[place].tolist(), k.tolist()):
                        c = halves(raw[p : p + length])
                        rows.append((*((key, p) if times == 1 else (None, None)), 1, *c, *c, None, None, times))
                    again = lone[k[back] > 1]
                    if len(again):
                        cut = np.flatnonzero(np.diff(again) != 1) + 1
                        rows.extend((key, int(r[0]), len(r), None, None, None, None, None, None, None) for r in np.split(again, cut))
                at, first, last = at[inside], first[inside], last[inside]
                if len(at):
                    cut = np.concatenate([[0], np.flatnonzero((np.diff(at) != 1) | (np.diff(first) != 0) | (np.diff(last) != 0)) + 1])
                    n = np.diff(np.concatenate([cut, [len(at)]]))
                    for p, k, x, y in zip(at[cut].tolist(), n.tolist(), (sync[first[cut]] - reach).tolist(), (sync[last[cut]] + reach + GRAM).tolist()):
                        meet(key, raw, p, k, x, y)
                yield from out(False)
        yield from out(True)

    schema = "key long, a int, n int, c1 long, c2 long, m1 long, m2 long, head binary, tail binary, times int"
    return texts.select("key", "t", "open").mapInArrow(run, schema)


def _each_string(stretches: DataFrame, length: int) -> DataFrame:
    """Stretches (m1, m2, c1, c2, n, head, tail) to a row for each string: its digest (s1, s2), c1, c2, i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, owners, places = [], [], []
            for j, (m1, m2, n, head, tail) in enumerate(zip(*(b.column(c).to_pylist() for c in ("m1", "m2", "n", "head", "tail")))):
                seed = b"%d %d " % (m1, m2)
                for i in range(n):
                    digests.append(xxhash.xxh3_128_digest(b"%s%d " % (seed, len(head) - i) + head[i:] + tail[: len(tail) - (n - 1 - i)]))
                owners += [j] * n
                places += range(n)
            if digests:
                s = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                owner = pa.array(owners)
                columns = [pa.array(s[:, 0]), pa.array(s[:, 1]), b.column("c1").take(owner), b.column("c2").take(owner), pa.array(places, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["s1", "s2", "c1", "c2", "i"])

    return stretches.select("m1", "m2", "c1", "c2", "n", "head", "tail").mapInArrow(run, "s1 long, s2 long, c1 long, c2 long, i int")


def _repeated(stretches: DataFrame, length: int) -> DataFrame:
    """The written rows of _stretches to (key, a, b): repeated strings begin from a up to, but not with, b."""
    told = stretches.where("head is not null")
    digest, middle, string = ["c1", "c2"], ["m1", "m2"], ["s1", "s2"]
    met = written(stretches.where("m1 is not null").groupBy(*digest, *middle).agg(F.sum("times").alias("times")), "met")
    # where a middle has several stretches, their strings are compared one by one; each stretch is taken once
    several = met.groupBy(*middle).count().where("count > 1").drop("count")
    # some task's row of each digest will do, the rest are alike
    open_ = told.join(several, middle, "left_semi").dropDuplicates(digest)
    strings = written(_each_string(open_, length), "strings")
    again = strings.groupBy(*string).count().where("count > 1").drop("count")
    some = strings.join(again, string).groupBy(*digest).agg(F.array_sort(F.collect_list("i")).alias("at"))
    sure = met.where("times > 1").select(*digest, F.lit(None).cast("array<int>").alias("at"))
    verdict = sure.unionByName(some.join(sure, digest, "left_anti"))
    each = stretches.where("key is not null")
    known = each.where("c1 is null").select("key", F.col("a").cast("long").alias("a"), (F.col("a") + F.col("n")).cast("long").alias("b"))
    found = written(each.where("c1 is not null").select("key", "a", "n", *digest).join(verdict, digest).select("key", "a", "n", "at"), "repeated")
    whole = found.where("at is null").select("key", F.col("a").cast("long").alias("a"), (F.col("a") + F.col("n")).cast("long").alias("b"))
    partly = found.where("at is not null").select("key", "a", F.explode("at").alias("i")).select("key", (F.col("a") + F.col("i")).cast("long").alias("a"))
    discard(met, strings)
    return known.unionByName(whole).unionByName(partly.select("key", "a", (F.col("a") + 1).alias("b")))


def _spans(repeated: DataFrame, length: int) -> DataFrame:
    """(key, a, b) to (key, spans): the maximal runs of covered bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        keys, lists = [], []
        for key, group in groupby(rows, key=lambda r: r[0]):
            spans: list[dict] = []
            for _, a, b in group:
                end = b - 1 + length
                if spans and a <= spans[-1]["b"]:
                    spans[-1]["b"] = max(end, spans[-1]["b"])
                else:
                    spans.append({"a": a, "b": end})
            keys.append(key)
            lists.append(spans)
            if len(keys) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lists, kind)], names=["key", "spans"])
                keys, lists = [], []
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lists, kind)], names=["key", "spans"])

    ordered = repeated.repartition("key").sortWithinPartitions("key", "a")
    return ordered.mapInArrow(run, T.StructType([T.StructField("key", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN))]))


def cut_bytes(text: str, spans: list[tuple[int, int]]) -> bytes:
    """The bytes of a text outside the spans."""
    data, out, last = text.encode(), [], 0
    for a, b in spans:
        out.append(data[last:a])
        last = b
    return b"".join([*out, data[last:]])


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 400, reach: int = 32, with_spans: bool = False) -> DataFrame:
    """A row for each row of docs: key, n_bytes, n_removed, n_spans, kept_sha256 (and spans).

    A byte is removed if a string of ``length`` bytes that covers it also begins anywhere else, in the
    same text or another; texts are whole, and strings never cross them.  A null text is empty;
    texts shorter than the threshold lose nothing.  Rows with equal texts lose all of it if it is long
    enough.  Texts of any length are taken whole; other columns of docs play no part, whatever their
    names.  An empty table gives an empty result.
    """
    if length < 2 * (2 * reach + GRAM):
        raise ValueError("the threshold must be well above the reach")
    ship_package(docs.sparkSession)
    t = F.coalesce(text, F.lit(""))
    given = docs.select(F.col(key).alias("id"), t.alias("t")).select("id", "t", F.octet_length("t").cast("long").alias("n"), F.xxhash64("t").alias("h1"), F.xxhash64("t", F.lit(1)).alias("h2"))
    name = ["n", "h1", "h2"]
    facts = written(given.select("id", *name, F.sha2(F.col("t").cast("binary"), 256).alias("sha")), "facts")
    classes = facts.groupBy(*name).agg(F.min("id").alias("id"), F.count("*").alias("k")).where(F.col("n") >= length)
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    # one text of each class; rows that share an id and a text are the same text
    long_texts = given.where(F.col("n") >= length)
    # only where rows share both is there something to drop, for which whole texts are shuffled
    once = facts.where(F.col("n") >= length).groupBy("id", *name).count().where("count > 1").isEmpty()
    single = (lambda df: df) if once else (lambda df: df.dropDuplicates(["key"]))
    chosen = single(keep_matching(long_texts, classes.drop("k"), ["id", *name])).select("key", "t")
    blocks = written(_blocks(chosen, length, reach), "blocks")

    places = blocks.select("key", F.posexplode("names").alias("i", "first")).withColumn("i", F.col("i").cast("long"))
    again = places.groupBy("first").count().where("count > 1").select("first")
    alive = written(places.join(again, "first").select("key", "i", "first"), "alive")
    # where each living block begins and ends, from the positions of its text
    ends = _block_places(alive.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "first"))).alias("blocks")).join(blocks.select("key", "at"), "key"))
    now = written(ends, "level")
    breaks, step, used = None, 1, []
    while step * (reach + 1) * 2 <= length and not now.isEmpty():
        ahead = now.select("key", (F.col("i") - step).alias("i"), F.col("y").alias("y2"), F.col("rank").alias("second"))
        pairs = now.join(ahead, ["key", "i"]).where(F.col("y2") - F.col("x") <= length - 2 * reach - GRAM).select("key", "i", "x", F.col("y2").alias("y"), F.col("rank").alias("first"), "second")
        runs = written(pairs, "runs")
        kept, unique, ranks = _rerank(runs)
        last, now, unique = now, written(kept, "level"), written(unique, "unique")
        discard(last, runs, ranks)
        used.append(unique)
        breaks = unique if breaks is None else breaks.unionByName(unique)
        step *= 2
    living = alive.groupBy("key").agg(F.collect_list("i").alias("alive"))
    held = blocks.select("key", "n", "at").join(living, "key", "left")
    if breaks is None:
        held = held.withColumn("breaks", F.lit(None).cast(T.ArrayType(_SPAN)))
    else:
        held = held.join(breaks.groupBy("key").agg(F.collect_list(F.struct(F.col("x").alias("a"), F.col("y").alias("b"))).alias("breaks")), "key", "left")
    open_ = written(_windows(held.select("key", "n", "at", "alive", "breaks"), length, reach), "open")
    discard(now, alive, blocks, *used)
    wanted = classes.join(open_, "key").select("key", "id", *name, "open")
    some = single(keep_matching(long_texts, wanted, ["id", *name]))
    stretches = written(_stretches(some, length, reach), "stretches")
    spans = written(_spans(_repeated(stretches, length), length), "spans")
    discard(stretches, open_)

    # whole texts that occur again are gone; of others the spans
    found = classes.join(spans, "key", "left").select(*name, "k", "spans")
    told = written(facts.join(found, name, "left").withColumn("all", F.coalesce(F.col("k") > 1, F.lit(False))), "told")
    cut = told.where("not all and spans is not null")
    texts = keep_matching(long_texts, cut.select("id", *name, "spans").dropDuplicates(["id", *name]), ["id", *name])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [hashlib.sha256(cut_bytes(x, [(s["a"], s["b"]) for s in y])).hexdigest() for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array(out, pa.string())], names=["h1", "h2", "kept"])

    kept = texts.select("t", "spans", "h1", "h2").mapInArrow(hashed, "h1 long, h2 long, kept string").dropDuplicates(["h1", "h2"])
    out = told.join(kept, ["h1", "h2"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    spans_ = F.when(F.col("all"), whole).otherwise(F.coalesce("spans", F.array().cast(T.ArrayType(_SPAN))))
    empty = hashlib.sha256(b"").hexdigest()
    out = out.withColumn("spans", spans_).select(
        F.col("id").alias(key), F.col("n").alias("n_bytes"), F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.when(F.col("all"), F.lit(empty)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"), "spans")
    return out if with_spans else out.drop("spans")


def _block_places(lists: DataFrame) -> DataFrame:
    """(key, blocks, at) to a row for each block: key, i, x, y, rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, blocks, data in zip(*(b.column(c).to_pylist() for c in ("key", "blocks", "at"))):
                at = np.frombuffer(data, "<i4").astype(np.int64)
                i = np.array([x["i"] for x in blocks], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), key)), pa.array(i), pa.array(at[i]), pa.array(at[i + 1]), pa.array([x["first"] for x in blocks], pa.int64())], names=["key", "i", "x", "y", "rank"])

    return lists.mapInArrow(run, "key long, i long, x long, y long, rank long")
