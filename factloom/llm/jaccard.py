"""Near-duplicate groups by an exact Jaccard join of word n-gram sets, through prefix trees.

Two sets of n and m elements with similarity of at least t, both in one global order, have their
first common element among the first n - ceil(t n) + 1 of either.  Documents with equal sets are
joined through the set's signature, and one stands for all.  For the others the order is used twice:

1. First come the n-grams of the lower half of the hash range, those of one document alone before
   all others.  Each task sends every n-gram of that half once, packed by hash range; a range tells
   which of them other tasks have too, and a document whose first elements are all its own has no
   partner and is done.  Most are.
2. The documents left are put in order among themselves, by how many of them have each element.

A prefix element with the documents that hold it is a group.  The documents' prefixes are put into a
prefix tree, which is traversed for each of them, sharing the overlap counted so far among all sets
below a node, and leaving subtrees that are too short, too long or too far on to reach the needed
overlap; at a leaf, sketches of both whole sets bound what may still be common.  The first traversal
ends at a document's first candidate and deals a large group out in blocks; it leaves few components
of a large group of copies.  The second takes the groups whose documents are still in several
components, and as many pairs as would join them; the third every pair of what is still apart then,
so that a pair that turned out to be no link keeps nothing apart.  A large group is dealt out as
pairs of blocks.  Candidates are verified on the whole sets.  Pairs within a component need no test:
they change nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import discard, drop_worker_value, keep_matching, ship_package, written
from factloom.llm.components import components
from factloom.llm.words import shingle_sets, text_slices

#: n-grams that a task packs together, at most (but for a single document).
_PACK = 1 << 20
#: Stands for an n-gram that several documents of a pack have.
_SEVERAL = 0xFFFF


def prefix_length(n: int | np.ndarray, percent: int):
    """How many of a set's n first elements hold its first one in common with any similar set."""
    return n - (n * percent + 99) // 100 + 1


def _signature(items: np.ndarray) -> tuple[int, int]:
    data = items.tobytes()
    return xxhash.xxh3_64_intdigest(data) - (1 << 63), xxhash.xxh64_intdigest(data, 1) - (1 << 63)


def _packs(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """docs(id, t, h) to two kinds of rows, told apart by bucket.

    Without a bucket, a document: pack, key, id, h, n, two signatures of its set, how many elements
    it has in the lower half of the hash range (low), and how many of those another document of the
    pack has (met).  With a bucket, one of 2**bits ranges of that half: the pack's distinct n-grams
    in it as 32-bit tokens, and the number within the pack of the document of each.
    """
    names = ["pack", "bucket", "key", "id", "h", "n", "s1", "s2", "low", "met", "tokens", "owners"]
    kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 8 + [pa.binary()] * 2

    def packed(pack: int, rows: list, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        items = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(items, kind="stable")
        items, owner = items[order], owner[order].astype(np.uint16)
        fresh = np.concatenate([[True], items[1:] != items[:-1]]) if len(items) else np.zeros(0, bool)
        several = ~(fresh & np.concatenate([fresh[1:], [True]])) if len(items) else fresh
        met = np.bincount(owner[several], minlength=len(sets))
        columns = list(zip(*(r + (len(s), int(m)) for r, s, m in zip(rows, sets, met))))
        none = [None] * len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip([[pack] * len(rows), none, *columns, none, none], kinds)], names=names)
        owner[several] = _SEVERAL
        items, owner = items[fresh], owner[fresh]
        ranges = (items >> np.uint64(63 - bits)).astype(np.int64)
        tokens = ((items << np.uint64(bits + 1)) >> np.uint64(32)).astype("<u4")
        cut = np.concatenate([[0], np.flatnonzero(np.diff(ranges)) + 1, [len(ranges)]]) if len(ranges) else np.zeros(1, int)
        parts = [(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        none = [None] * len(parts)
        values = [[pack] * len(parts), ranges[cut[:-1]].tolist() if parts else [], *[none] * 8, [tokens[a:b].tobytes() for a, b in parts], [owner[a:b].astype("<u2").tobytes() for a, b in parts]]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_value()
        key = pack = TaskContext.get().partitionId() << 40
        rows, sets, held = [], [], 0
        for batch in batches:
            for b in text_slices(batch, 1):
                for i, h, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), shingle_sets(b.column(1), size)):
                    rows.append((key, i, h, len(s), *_signature(s)))
                    low = s[: np.searchsorted(s, np.uint64(1 << 63))]
                    sets.append(low)
                    key, held = key + 1, held + len(low)
                    if held >= _PACK or len(rows) == _SEVERAL:
                        yield from packed(pack, rows, sets)
                        pack, rows, sets, held = key, [], [], 0
        if rows:
            yield from packed(pack, rows, sets)

    schema = "pack long, bucket int, key long, id long, h long, n long, s1 long, s2 long, low long, met long, tokens binary, owners binary"
    return docs.select("id", "t", "h").mapInArrow(run, schema)


def _met_elsewhere(packs: DataFrame) -> DataFrame:
    """The packs to (key, elsewhere): how many of a document's own n-grams some other pack has."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for _, group in groupby(rows, key=lambda r: r[0]):
            _, packs_, tokens, owners = zip(*group)
            tokens = [np.frombuffer(x, "<u4") for x in tokens]
            sizes = [len(x) for x in tokens]
            token, owner = np.concatenate(tokens), np.concatenate([np.frombuffer(x, "<u2") for x in owners])
            order = np.argsort(token, kind="stable")
            same = token[order[1:]] == token[order[:-1]]
            again = np.zeros(len(token), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            again &= owner != _SEVERAL
            edges = np.concatenate([[0], np.cumsum(sizes)])
            out = [(p, owner[a:b][again[a:b]].tobytes()) for p, a, b in zip(packs_, edges[:-1].tolist(), edges[1:].tolist())]
            out = [x for x in out if x[1]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), (pa.int64(), pa.binary()))], names=["pack", "owners"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for pack, group in groupby(rows, key=lambda r: r[0]):
            total = np.zeros(_SEVERAL, np.int64)
            for _, owners in group:
                total += np.bincount(np.frombuffer(owners, "<u2"), minlength=_SEVERAL)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(pack + at), pa.array(total[at])], names=["key", "elsewhere"])

    ranges = packs.where("bucket is not null").select("bucket", "pack", "tokens", "owners")
    found = ranges.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "pack long, owners binary")
    return found.repartition("pack").sortWithinPartitions("pack").mapInArrow(count, "key long, elsewhere long")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """docs(key, t, s1, s2) to (key, items, sketch), of those whose set has these signatures.

    The sketch tells for each of a power of two of hash values whether an odd number of elements has
    it; as many sketch bits as two sets differ in, so many elements at least are not common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch, 1):
                rows = []
                for key, s1, s2, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), shingle_sets(b.column(1), size)):
                    if (s1, s2) == _signature(s):
                        rows.append((key, s.view(np.int64), sketch(s)))
                kinds = pa.int64(), pa.list_(pa.int64()), pa.binary()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=["key", "items", "sketch"])

    return docs.select("key", "t", "s1", "s2").mapInArrow(run, "key long, items array<long>, sketch binary")


def sketch(items: np.ndarray) -> bytes:
    """Parities of a set's elements by the low bits of their hashes, four to eight bits an element."""
    width = max(6, min(17, int(len(items)).bit_length() + 2))
    odd = np.bincount((items & np.uint64((1 << width) - 1)).astype(np.int64), minlength=1 << width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _differing(a: int, wide_a: int, b: int, wide_b: int) -> int:
    """How many elements at least are in one of two sets only, by their sketches of so many bits."""
    while wide_a > wide_b:
        wide_a >>= 1
        a = (a >> wide_a) ^ (a & ((1 << wide_a) - 1))
    while wide_b > wide_a:
        wide_b >>= 1
        b = (b >> wide_b) ^ (b & ((1 << wide_b) - 1))
    return (a ^ b).bit_count()


class PrefixTree:
    """Sets of one group, as what follows the group's element in their prefixes.

    A set is given as its number of elements n, the place of the group's element in it, and the
    elements that follow it within the prefix, in the global order, at the next places.  A node knows
    the least and most elements of the sets below it, and the least place of the group's element in
    them, so that subtrees without a set that can still reach the overlap are left out.  Where only
    one set goes on, it is a leaf; a second one that comes along makes a node of it.
    """

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = self._node()

    @staticmethod
    def _node() -> list:
        return [{}, [], 1 << 62, 0, 1 << 62]  # children (nodes, or sets), sets that end here, least n, most n, least place

    def add(self, name, n: int, place: int, prefix: list[int]) -> None:
        self._put(self.root, 0, (name, n, place, prefix))

    def _put(self, node: list, depth: int, one: tuple) -> None:
        name, n, place, prefix = one
        while True:
            node[2], node[3], node[4] = min(node[2], n), max(node[3], n), min(node[4], place)
            if depth == len(prefix):
                node[1].append(one)
                return
            element = prefix[depth]
            child = node[0].get(element)
            if child is None:
                node[0][element] = one
                return
            depth += 1
            if type(child) is tuple:
                leaf, child = child, self._node()
                node[0][element] = child
                child[2], child[3], child[4] = leaf[1], leaf[1], leaf[2]
                if depth == len(leaf[3]):
                    child[1].append(leaf)
                else:
                    child[0][leaf[3][depth]] = leaf
            node = child

    def candidates(self, n: int, place: int, prefix: list[int], percent: int) -> Iterator:
        """Names of sets that may be similar to such a set, shared elements first.

        The group's element counts as the first in common.
        """
        both, length = 100 + percent, len(prefix)
        low, high = -(-n * percent // 100), n * 100 // percent  # sizes of similar sets
        # node, elements of the probe passed, elements of the sets below passed, overlap so far
        stack = [(self.root, 0, 0, 1)]
        while stack:
            node, k, depth, overlap = stack.pop()
            mine = n - 1 - place - k
            if type(node) is tuple:
                name, m, at, _ = node
                if low <= m <= high and (overlap + min(mine, m - 1 - at - depth)) * both >= percent * (n + m):
                    yield name
                continue
            children, sets, least, most, first = node
            least = max(least, low)
            if most < least or least > high or (overlap + min(mine, most - 1 - first - depth)) * both < percent * (n + least):
                continue
            for name, m, at, _ in sets:
                if low <= m <= high and (overlap + min(mine, m - 1 - at - depth)) * both >= percent * (n + m):
                    yield name
            shared = []
            for element, child in children.items():
                j = bisect_left(prefix, element, k)
                if j == length:  # past the probe's prefix, elements of the sets may still be common
                    stack.append((child, j, depth, overlap))
                elif prefix[j] == element:
                    shared.append((child, j + 1, depth + 1, overlap + 1))
                else:
                    stack.append((child, j, depth + 1, overlap))
            stack += shared  # on top: they are followed first


def _tree_pairs(rows: DataFrame, percent: int, which: str) -> DataFrame:
    """Candidate pairs of rows(token, left, right, block, key, component, n, unique, prefix, sketch), by tree.

    which: "first", the first candidate of each document alone, among those of smaller keys;
    "joining", of components those pairs that make one of them if all hold; "all".
    """
    first_only = which == "first"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # names of documents are (key, component, n, sketch, its bits, elements before the group's)
        each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        found: set[tuple[int, int]] = set()

        def top(component: int) -> int:
            while joined.get(component, component) != component:
                component = joined[component]
            return component

        def may(one: tuple, two: tuple) -> bool:
            if top(one[1]) == top(two[1]):
                return False
            if not one[5].isdisjoint(two[5]):
                return False  # the group of an element before this one has the pair
            n = one[2] + two[2]
            return n - _differing(one[3], one[4], two[3], two[4]) >= 2 * -(-n * percent // (100 + percent))

        for (token, left, right), group in groupby(each, key=lambda r: r[:3]):
            tree, probes = PrefixTree(), []
            joined: dict[int, int] = {}  # components, by those that they were joined to
            for _, _, _, block, key, component, n, unique, prefix, bits in group:
                at = prefix.index(token)
                name = key, key if component is None else component, n, int.from_bytes(bits, "little"), 8 * len(bits), frozenset(prefix[:at])
                given = n, unique + at, prefix[at + 1 :]
                if first_only:
                    for other in tree.candidates(*given, percent):
                        if may(name, other):
                            found.add((other[0], key))
                            break
                if block == left:
                    tree.add(name, *given)
                if block == right and not first_only:
                    probes.append((name, given))
            for name, given in probes:
                for other in tree.candidates(*given, percent):
                    if (left != right or other[0] < name[0]) and may(name, other):
                        found.add((min(name[0], other[0]), max(name[0], other[0])))
                        if which == "joining":
                            joined[top(name[1])] = top(other[1])
            if len(found) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found)], names=["a", "b"])
                found.clear()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found)], names=["a", "b"])

    ordered = rows.repartition("token", "left", "right").sortWithinPartitions("token", "left", "right", "key")
    ordered = ordered.select("token", "left", "right", "block", "key", "component", "n", "unique", "prefix", "sketch")
    return ordered.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = pairs.join(sets.select(F.col("key").alias("a"), F.col("items").alias("x")), "a")
    both = one.join(sets.select(F.col("key").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("all"))
    return both.where(F.col("shared") * 100 >= F.col("all") * percent).select("a", "b")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """sets(key, items) to (key, n, unique, prefix).

    In the global order elements of one set alone come first, ``unique`` of them in this set; then
    those that occur again, rarest first, as numbers that tell how many sets have them (up to half a
    million) and the upper bits of their hash.  Two elements of the same number count as one, which
    may only add a candidate.
    """
    n = F.size("items").cast("long")
    elements = sets.select("key", n.alias("n"), F.explode("items").alias("item"))
    counts = elements.groupBy("item").count().where("count > 1")
    order = F.shiftleft(F.least("count", F.lit((1 << 19) - 1)), 44).bitwiseOR(F.shiftrightunsigned("item", 20))
    shared = elements.join(counts, "item").groupBy("key", "n").agg(F.array_sort(F.collect_list(order)).alias("x"))
    unique = F.col("n") - F.size("x")
    length = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - unique)
    return shared.select("key", "n", unique.alias("unique"), F.slice("x", F.lit(1), length.cast("int")).alias("prefix")).where(F.size("prefix") > 0)


def near_duplicates(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    size: int = 4,
    percent: int = 85,
    block: int = 512,
) -> DataFrame:
    """A row for each row of docs: key, row_id (a number of the row), text_hash, n_shingles, group_id
    (a row_id that stands for the component) and component_id.

    The component is the smallest key that can be reached over links of at least ``percent``
    similarity.  Rows without a text or words have no n-grams and no links; their component is their
    own key.  Equal rows, of one key or of several, are linked as equal sets.  A null key never names
    a component that has another key.  Texts of any length are taken whole.  Other columns of docs
    play no part, whatever their names.  An empty table gives an empty result.

    N-grams are told apart by 64-bit hashes: a set of 100,000 has two that are taken for one with a
    chance of about 1 in 4 thousand million.
    """
    spark = docs.sparkSession
    ship_package(spark)
    given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    volume = given.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = max(0, (volume // (16 << 20)).bit_length())  # hash ranges of a million n-grams or so
    packs = written(_packs(given, size, min(31, bits)), "packs")
    prepared = packs.where("bucket is null").select("key", "id", "h", "n", "s1", "s2", "low", "met")
    # equal sets: the row of the smallest key stands for all
    same = ["n", "s1", "s2"]
    classes = prepared.where("n > 0").groupBy(*same).agg(F.min("key").alias("key"), F.min("id").alias("least"))
    classes = written(classes, "classes")
    alone = F.col("low") - F.col("met") - F.coalesce("elsewhere", F.lit(0))
    length = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    may = prepared.join(classes.select("key"), "key", "left_semi").join(_met_elsewhere(packs), "key", "left").where(alone < length)
    wanted = written(may.select("key", "id", "h", *same), "wanted")

    # whole sets of the documents that may have a link, put in order once more among themselves
    sides = wanted.select("id", "h", "key", "s1", "s2")
    sets = _sets(keep_matching(given, sides, ["id", "h"]), size)
    rows_alike = prepared.join(wanted.select("id", "h"), ["id", "h"], "left_semi").groupBy("id", "h").count().where("count > 1")
    if not rows_alike.isEmpty():  # rows that share key and text have one set
        sets = sets.dropDuplicates(["key"])
    sets = written(sets, "items")
    prefixes = written(_prefixes(sets, percent).join(sets.select("key", "sketch"), "key"), "prefixes")

    postings = prefixes.select("key", F.explode(F.array_distinct("prefix")).alias("token"))
    groups = postings.groupBy("token").agg(F.min("key").alias("least"), F.count("*").alias("k"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("who")).where("k > 1")
    # of elements with the same documents the first one is enough: no other is the first in common
    kept = groups.groupBy("least", "k", "who").agg(F.min("token").alias("token")).select("k", "token")
    members = written(postings.join(kept, "token"), "members")
    blocks = F.ceil(F.col("k") / block).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key", "token"), F.col("blocks")).cast("int"))

    tried = dealt.withColumns({"left": F.col("block"), "right": F.col("block"), "component": F.lit(None).cast("long")}).join(prefixes, "key")
    best = _tree_pairs(tried, percent, "first").groupBy("a", "b").count()
    pairs = best.groupBy("b").agg(F.max(F.struct("count", (-F.col("a")).alias("m"))).alias("best")).select((-F.col("best.m")).alias("a"), "b")
    found = written(_verified(pairs, sets, percent), "links")

    # then between components: enough pairs to join them if all hold, and all pairs of what is still apart
    label: Column = F.coalesce("component", "key")
    for which in ("joining", "all"):
        open_ = dealt.join(components(found), "key", "left").withColumn("component", label)
        mixed = open_.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
        rows = open_.join(mixed, "token").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("*", F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right")).join(prefixes, "key")
        links, found = found, written(found.unionByName(_verified(_tree_pairs(rows, percent, which).distinct(), sets, percent)), "links")
        discard(links)

    ids = components(found)
    rep = classes.join(ids, "key", "left").select(*same, "least", label.alias("component"))
    names = rep.groupBy("component").agg(F.min("least").alias("component_id"))
    rep = rep.join(names, "component").select(*same, "component", "component_id")
    linked = F.col("n") > 0
    out = prepared.select("key", "id", "h", *same).join(rep, same, "left")
    out = out.select(
        F.col("id").alias(key), F.col("key").alias("row_id"), F.col("h").alias("text_hash"), F.col("n").alias("n_shingles"),
        F.when(linked, F.col("component")).otherwise(F.col("key")).alias("group_id"), F.when(linked, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    out = written(out, "groups")
    discard(packs, classes, wanted, sets, prefixes, members, found)
    return out


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the smallest key, and its columns."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no name can clash
    k, t = (f"c{docs.columns.index(c)}" for c in (key, text))
    found = near_duplicates(plain, key=k, text=t, **options)
    best = found.groupBy("group_id").agg(F.min(F.struct(F.col(k).isNull(), F.col(k).alias("id"), "row_id", F.col("text_hash").alias("h"))).alias("best"))
    stay = best.select(F.col("best.id").alias(k), F.col("best.h").alias("h")).groupBy(k, "h").agg(F.count("*").alias("times"))
    stay = written(stay, "stay")
    kept = keep_matching(plain.withColumn("h", F.xxhash64(t)), stay, [k, "h"])
    # rows that share key and text: as many stay as were chosen
    several = kept.groupBy(k, "h", "times").count().where(F.col("count") > F.col("times"))
    if not several.isEmpty():
        turn = F.row_number().over(Window.partitionBy(k, "h").orderBy(*plain.columns))
        kept = kept.withColumn("turn", turn).where("turn <= times")
    return kept.select(*plain.columns).toDF(*docs.columns)
