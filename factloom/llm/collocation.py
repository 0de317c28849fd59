"""Phrase collocations from a weighted de Bruijn graph of words, per language.

Texts fall into pieces at signs, pieces into words.  Nodes are runs of size - 1 words, edges runs of
``size`` words that lead from their first node to the one that overlaps it.  Only edges are counted,
besides the piece ends: the last runs of each piece, which no edge begins with.  So every word of a
text gives one row.  A task splits its texts with arrays of offsets, numbers its words and counts equal
rows before anything is shuffled.

Counts of shorter runs are never gathered from the texts: a run of k - 1 words occurs as often as the
runs of k words that begin with it (the flow out of the node) and, besides, as often as it ends a
piece.  Runs below the least count drop out once they have been added to their node.

Nodes that a single edge enters and a single edge leaves, and where no piece begins or ends, are
inner nodes of a path: its edges and nodes all have one count.  Such paths are compacted by pointer
doubling, and nodes inside a path of candidates are dropped with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import discard, ship_package, written

#: What each byte of UTF-8 is: 2 ends a piece, 1 a word, 0 belongs to a word.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words that are numbered at once, so that numbers of three fit into 64 bits.
_AT_ONCE = 1 << 19


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of all words in order, their offsets, and for each word its row and whether it is the last of its piece."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    line = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _KIND[line]
    # before and after: what stands around each byte, with an end of piece at the bounds of texts
    before, after = np.full(len(line), 2, np.uint8), np.full(len(line), 2, np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    bounds = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(line))]
    before[bounds], after[bounds - 1] = 2, 2
    inside = kind == 0
    starts, ends = np.flatnonzero(inside & (before > 0)), np.flatnonzero(inside & (after > 0)) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    # pieces before each word: signs and bounds of texts passed so far
    signs = np.cumsum(kind == 2, dtype=np.int32)
    piece = signs[starts] if len(starts) else np.zeros(0, np.int64)
    last = np.ones(len(starts), bool)
    last[:-1] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    return _LOWER[line[inside]], np.concatenate([[0], np.cumsum(ends - starts)]), row, last


def edge_counts(texts: pa.Array, langs: pa.Array, size: int = 3) -> Iterator[tuple[pa.LargeBinaryArray, np.ndarray]]:
    """Equal edges and piece ends of a batch, and how often they are there: words between blanks, a line end, the language."""
    body, offsets, row, last = split_words(texts)
    names = pc.dictionary_encode(langs)
    lang = names.indices.to_numpy(zero_copy_only=False)[row].astype(np.int64)
    for a in range(0, len(row), _AT_ONCE):
        b, end = min(len(row), a + _AT_ONCE), min(len(row), a + _AT_ONCE + size - 1)
        at = (offsets[a : end + 1] - offsets[a]).astype(np.int64)
        words = _binary(body[offsets[a] : offsets[end]], at)
        coded = words.dictionary_encode()
        ids = coded.indices.to_numpy().astype(np.int64)
        none = len(coded.dictionary)  # stands where the piece is over
        width, place = none + 1, np.arange(b - a)
        _, keys = np.unique(lang[a:b] * width + ids[: b - a], return_inverse=True)
        over, columns = np.zeros(b - a, bool), []
        for k in range(1, size):
            there = np.minimum(place + k, end - a - 1)
            over |= last[a + there - 1] | (place + k > end - a - 1)
            columns.append(np.where(over, none, ids[there]))
            if k > 2:  # numbers of three words fit, of more they are made dense again
                _, keys = np.unique(keys, return_inverse=True)
            keys = keys * width + columns[-1]
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        dictionary = pa.concat_arrays([coded.dictionary, pa.nulls(1, pa.large_binary())])
        parts = [dictionary.take(pa.array(c[first])) for c in (ids[: b - a], *columns)]
        gram = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()), null_handling="skip")
        whose = names.dictionary.cast(pa.large_binary()).take(pa.array(lang[a:b][first]))
        yield pc.binary_join_element_wise(gram, whose, pa.scalar(b"\n", pa.large_binary())), counts


def _binary(body: np.ndarray, offsets: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())])


def _raw(keys: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all keys in order, and their offsets."""
    offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    body = keys.buffers()[2]
    line = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
    return line, offsets - offsets[0]


def _summed(keys: pa.LargeBinaryArray, counts: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Equal keys once, with the sums of their counts."""
    coded = keys.dictionary_encode()
    sums = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(sums, coded.indices.to_numpy(), counts)
    return coded.dictionary, sums


#: Odd numbers that the bytes of a key are weighed with, by their places.
_WEIGHTS = np.random.default_rng(12).integers(1 << 62, size=1 << 12, dtype=np.uint64) * 2 + 1


def _buckets(line: np.ndarray, offsets: np.ndarray, buckets: int, at_once: int = 1 << 16) -> np.ndarray:
    """A bucket for each key by a hash of its bytes; some keys at a time, as it takes eight bytes for each of theirs."""
    out = []
    for a in range(0, len(offsets) - 1, at_once):
        at = offsets[a : a + at_once + 1]
        part = line[at[0] : at[-1]]
        place = np.arange(len(part)) - np.repeat(at[:-1] - at[0], np.diff(at))
        mixed = np.add.reduceat(_WEIGHTS[place % len(_WEIGHTS)] * (part + np.uint64(1)), at[:-1] - at[0])
        out.append(((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(buckets))
    return np.concatenate(out).astype(np.int64)


def _dealt(keys: pa.LargeBinaryArray, counts: np.ndarray, buckets: int) -> Iterator[dict]:
    """The keys by their buckets, those of one bucket in one row of compressed arrays."""
    if not len(keys):
        return
    bucket = _buckets(*_raw(keys), buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, counts = bucket[order], counts[order]
    line, offsets = _raw(keys.take(pa.array(order)))
    cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(cut[:-1], cut[1:]):
        sizes = np.diff(offsets[a : b + 1]).astype(np.int32)
        parts = sizes, counts[a:b], line[offsets[a] : offsets[b]]
        sizes, numbers, body = (pa.compress(x.tobytes(), "zstd", asbytes=True) for x in parts)
        yield {"bucket": int(bucket[a]), "done": False, "n": b - a, "length": int(offsets[b] - offsets[a]), "sizes": sizes, "counts": numbers, "body": body}


_DEALT = "bucket long, done boolean, n long, length long, sizes binary, counts binary, body binary"


def _dealt_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "done": pa.bool_(), "n": pa.int64(), "length": pa.int64(), "sizes": pa.binary(), "counts": pa.binary(), "body": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], names=list(kinds))


def _joined(rows: list[dict]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    whole = lambda r, c, size: pa.decompress(r[c], size, "zstd", asbytes=True)
    sizes = np.concatenate([np.frombuffer(whole(r, "sizes", 4 * r["n"]), np.int32) for r in rows]).astype(np.int64)
    counts = np.concatenate([np.frombuffer(whole(r, "counts", 8 * r["n"]), np.int64) for r in rows])
    body = np.frombuffer(b"".join(whole(r, "body", r["length"]) for r in rows), np.uint8)
    return _binary(body, np.concatenate([[0], np.cumsum(sizes)])), counts


def _without(line: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.LargeBinaryArray:
    """The keys without their bytes a to b (places in line)."""
    step = np.zeros(len(line) + 1, np.int8)
    step[a] += 1
    step[b] -= 1
    keep = np.cumsum(step[:-1], dtype=np.int8) == 0
    return _binary(line[keep], np.concatenate([[0], np.cumsum(np.diff(offsets) - (b - a))]))


def _bounds(line: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key where its words end, how many they are, and where the last of them begins, with the blank before it."""
    start = offsets[:-1]
    ends, blanks = np.flatnonzero(line == 10), np.flatnonzero(line == 32)
    stop = ends[np.searchsorted(ends, start)] if len(start) else start
    until, since = np.searchsorted(blanks, stop), np.searchsorted(blanks, start)
    n = np.where(stop > start, until - since + 1, 0)
    tail = np.where(until > since, blanks[until - 1] if len(blanks) else 0, start)
    return stop, n, tail


def flow(keys: pa.LargeBinaryArray, counts: np.ndarray, k: int, least: int) -> tuple[tuple[pa.LargeBinaryArray, np.ndarray], tuple[pa.LargeBinaryArray, np.ndarray]]:
    """Those of k words that occur least times or more; and all, those of k words as the node that they begin with."""
    keys, counts = _summed(keys, counts)
    line, offsets = _raw(keys)
    stop, n, tail = _bounds(line, offsets)
    frequent = pa.array(np.flatnonzero((n == k) & (counts >= least)))
    nodes = _without(line, offsets, np.where(n == k, tail, stop), stop)
    return (keys.take(frequent), counts[frequent.to_numpy()]), _summed(nodes, counts)


def _texts(keys: pa.LargeBinaryArray, counts: np.ndarray) -> pa.RecordBatch:
    line, offsets = _raw(keys)
    stop, _, _ = _bounds(line, offsets)
    gram, lang = _without(line, offsets, stop, offsets[1:]), _without(line, offsets, offsets[:-1], stop + 1)
    return pa.RecordBatch.from_arrays([lang.cast(pa.large_string()).cast(pa.string()), gram.cast(pa.large_string()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])


def _n_words() -> Column:
    return F.length("gram") - F.length(F.translate("gram", " ", "")) + 1


def count_grams(docs: DataFrame, *, text: str = "text", lang: str = "lang", size: int = 3, least: int = 10, bucket_bytes: int = 4 << 20) -> DataFrame:
    """lang, gram, n: all runs of 1 to ``size`` words that occur ``least`` times or more, and under the empty gram all words of a language.

    Equal edges meet in buckets by a hash of the whole edge, so that no frequent node makes one large; there are as
    many as keep the words of ``bucket_bytes`` of text in each.  A bucket is summed in arrays; it keeps
    its frequent edges and sends what flows into the nodes on, in sums again, to the buckets of the nodes.
    """
    spark = docs.sparkSession
    ship_package(spark)
    given = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    buckets = max(1, -(-(given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in edge_counts(batch.column(0), batch.column(1), size):
                yield _dealt_batch(list(_dealt(keys, counts, buckets)))

    def onward(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple | dict]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for (bucket, done), lot in groupby(rows, key=lambda r: (r["bucket"], r["done"])):
            if done:
                yield from lot
            else:
                yield bucket, *flow(*_joined(list(lot)), k, least)

    def level(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in onward(batches, k):
                if isinstance(x, dict):
                    yield _dealt_batch([x])
                    continue
                bucket, own, nodes = x  # what is done stays in its bucket
                yield _dealt_batch([r | {"bucket": bucket, "done": True} for r in _dealt(*own, 1)] + list(_dealt(*nodes, buckets)))

        return run

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in onward(batches, 1):
            for keys, counts in [_joined([x])] if isinstance(x, dict) else x[1:]:
                yield _texts(keys, counts)

    dealt = given.mapInArrow(edges, _DEALT)
    for k in range(size, 0, -1):
        met = dealt.repartition("bucket", "done").sortWithinPartitions("bucket", "done")
        dealt = met.mapInArrow(level(k), _DEALT) if k > 1 else met.mapInArrow(finish, "lang string, gram string, n long")
    # what is left are frequent runs, and each bucket's share of a language's words
    return dealt.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def cut_candidates(grams: DataFrame) -> DataFrame:
    """lang, gram, n, k, left, right, l, r: every cut of every run of two words or more into its first k words and the rest, with their counts."""
    several = grams.where(_n_words() > 1).select("lang", "gram", "n", F.explode(F.sequence(F.lit(1), _n_words() - 1)).alias("k"))
    several = several.withColumn("rest", F.col("k") - _n_words())
    cuts = several.withColumns({"left": F.expr("substring_index(gram, ' ', k)"), "right": F.expr("substring_index(gram, ' ', rest)")}).drop("rest")
    counts = lambda gram, n: grams.select("lang", F.col("gram").alias(gram), F.col("n").alias(n))
    return cuts.join(counts("left", "l"), ["lang", "left"]).join(counts("right", "r"), ["lang", "right"])


def compact_paths(cuts: DataFrame, size: int = 3) -> DataFrame:
    """lang, node, edge, next, last, steps, n: every inner node of a path of edges of ``size`` words.

    edge leads to the node and next leaves it; last is the edge that ends the path and steps the number of
    edges from edge to it.  A node is inside a path if its count is that of an edge into it and of one
    out of it: then it has no others, and no piece begins or ends there.  (A ring of inner nodes would have no
    piece that begins, so there is none.)  Pointers are doubled until none moves on: log2 of the edges of
    the longest path times, each a join of the edges at inner nodes.
    """
    edges = cuts.where(_n_words() == size)
    into = edges.where("k = 1 and n = r").select("lang", F.col("right").alias("node"), F.col("gram").alias("edge"), "n")
    out = edges.where((F.col("k") == size - 1) & (F.col("n") == F.col("l"))).select("lang", F.col("left").alias("node"), F.col("gram").alias("next"))
    links = written(into.join(out, ["lang", "node"]), "links")
    now = written(links.select("lang", "edge", F.col("next").alias("last"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open")), "pointers")
    for _ in range(max(1, links.count()).bit_length()):
        ahead = now.select("lang", F.col("edge").alias("last"), F.col("last").alias("then"), F.col("steps").alias("more"))
        further = now.join(ahead, ["lang", "last"], "left")
        then = written(further.select("lang", "edge", F.coalesce("then", "last").alias("last"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("then").isNotNull().alias("open")), "pointers")
        discard(now)
        now = then
        if not now.where("open").limit(1).count():
            break
    return links.join(now.drop("open"), ["lang", "edge"]).select("lang", "node", "edge", "next", "last", "steps", "n")


def mine_collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", size: int = 3, least: int = 10, inside: int = 50, most: int = 2_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``most`` best phrases of 2 to ``size`` words.

    a is the phrase's count, at least ``least``; l and r are those of the parts of its weakest cut, n that of all words, score
    floor(1000000 * a * a / (l * r)), exact for counts below 10^14 (more raise an error).  A phrase drops
    out if a longer candidate around it has at least ``inside`` hundredths of its count; it is enough to look at those longer by
    one word, as a longer candidate holds one of them that is no rarer.  Order: score and a descending, phrase by its bytes.

    A null text counts as empty and gives nothing; a null language is ``und``.  Texts of any length are taken
    whole, repeated rows count each time, other columns play no part whatever their names, an empty table
    gives an empty result.
    """
    grams = written(count_grams(docs, text=text, lang=lang, size=size, least=least), "grams")
    cuts = written(cut_candidates(grams.where("gram != ''")), "cuts")
    paths = compact_paths(cuts, size)
    covers = lambda part: F.col("n") * 100 >= F.col(part) * inside
    # runs one word shorter that an edge covers; those inside paths first, and of the other edges either end
    dropped = paths.select("lang", F.col("node").alias("gram")).union(cuts.where((F.col("k") == _n_words() - 1) & (F.col("k") > 1) & covers("l")).select("lang", "left"))
    dropped = dropped.union(cuts.where((F.col("k") == 1) & (_n_words() > 2) & covers("r")).select("lang", "right")).distinct()
    number = lambda x: f"cast({x} as decimal(14, 0))"
    score = F.expr(f"({number('n')} * {number('n')} * cast(1000000 as decimal(7, 0))) div ({number('l')} * {number('r')})")
    weakest = cuts.withColumn("score", score).groupBy("lang", "gram").agg(F.min_by(F.struct("score", "l", "r", "n"), F.struct("score", "k")).alias("cut")).select("lang", "gram", "cut.*")
    kept = weakest.join(dropped, ["lang", "gram"], "left_anti")
    order = [F.desc("score"), F.desc("n"), F.asc("gram")]
    # the best of each share first, so that no task ranks a whole language
    share = kept.withColumn("share", F.pmod(F.xxhash64("gram"), F.lit(64)))
    share = share.withColumn("at", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("at") <= most)
    ranked = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    total = grams.where("gram = ''").select("lang", F.col("n").alias("total"))
    return ranked.join(total, "lang").select("lang", "rank", F.col("gram").alias("phrase"), F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")
