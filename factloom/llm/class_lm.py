"""Language-model scoring with Brown's class-based bigrams and exchange clustering.

Words are counted over all training texts.  The ``core``, the most frequent words, is put into
classes by exchange: starting from ranks dealt out in turn, each word is moved to the class that most
raises the likelihood of the class bigrams, given where all others are; words are worked on by many
tasks at once, and in each round one half of them may move: a half chosen by a hash, then the other
one.  Rounds go on until such a pair of them brings less than a thousandth of the rise so far.  Every
other training word then joins the class that most raises the same likelihood, by the classes that it
stands between in all of its occurrences.  Class bigrams are counted over all words' classes, and

    p(w | previous) = (1 - new) p(class(w) | class(previous)) n(w) / n(class(w)),

with transitions smoothed by the classes' own frequencies.  ``new`` is the chance of a word that
training has not seen, by Good and Turing from the words seen once; it is shared out evenly among as
many words as training has and one more.  Every count is taken over the whole training corpus.

Texts are split and words numbered a batch at a time, as arrays; Spark sums, groups and joins.
Scoring reads each text once.  The ``head``, the most frequent words with their classes, is broadcast
(a table bounded by that parameter); the classes of other words are joined from the vocabulary and
put into their places of the text's row of classes.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import discard, ship_package, worker_value, written

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Stands for a word whose class is not known yet.
_HOLE = 255


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, cut at ASCII white space; none of null."""
    return text.encode().translate(_FOLD).split() if text else []


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words that tokens() gives of each text, all in one line, as numbers; the words that the numbers stand for; how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    codes, n = coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy()
    blank = pc.index(coded.dictionary, "").as_py()  # before and after white space at the ends of a text
    if blank >= 0:
        kept = codes != blank
        n = np.diff(np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(n)])])
        codes = codes[kept]
    return codes, coded.dictionary, n


def numbered(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Each word's place in known; the one after the last for all others."""
    return pc.fill_null(pc.index_in(words, known), len(known)).to_numpy()


def line_of(values: np.ndarray, n: np.ndarray, end: int) -> np.ndarray:
    """The texts' values with the end before the first, between any two and after the last."""
    line = np.full(len(values) + len(n) + 1, end, np.int64)
    line[np.arange(len(values)) + np.repeat(np.arange(1, len(n) + 1), n)] = values
    return line


def _cells(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of binary cells, one after another, and how many each cell has."""
    values = np.frombuffer(b"".join(column.to_pylist()), kind)
    return values, pc.binary_length(column).to_numpy() // values.itemsize


def _binary(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """Cells of so many values each."""
    offsets = np.concatenate([[0], np.cumsum(n) * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _lists(values: pa.Array, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)


@dataclass
class ClassModel:
    """Classes 0.. hold all training words; the class after them is the end of a text."""

    name: str
    vocabulary: DataFrame  # word, n, class
    classes: int
    transition: np.ndarray  # log10 p(class | previous class); the last row is for a new word before
    emission: np.ndarray  # log10 of how often a class occurs, by class
    new: float
    n_tokens: int
    n_types: int
    n_texts: int


def count_words(texts: DataFrame, most: int = 150_000) -> DataFrame:
    """texts(t) to (word, n): summed in each task first, then by Spark."""

    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def summed() -> tuple[pa.Array, np.ndarray]:
            words = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
            n = np.bincount(words.indices.to_numpy(), np.concatenate([n for _, n in held]), len(words.dictionary))
            return words.dictionary, n.astype(np.int64)

        for b in batches:
            codes, words, _ = cut(b.column(0))
            n = np.bincount(codes, minlength=len(words))
            held.append((words.filter(pa.array(n > 0)), n[n > 0]))
            if sum(len(w) for w, _ in held) > most:
                held = [summed()]
                if len(held[0][0]) > most:
                    yield pa.RecordBatch.from_arrays([held[0][0], pa.array(held[0][1])], names=["word", "n"])
                    held = []
        if held:
            words, n = summed()
            yield pa.RecordBatch.from_arrays([words, pa.array(n)], names=["word", "n"])

    return texts.select("t").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bigrams(texts: DataFrame, shared) -> DataFrame:
    """texts(t) to (u, v, n): bigrams of the core's numbers, one for all other words, and the end, which also begins a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = pa.array([w.decode() for w in shared.value], pa.string())
        other = len(core)
        end, size = other + 1, np.int64(other + 2)
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code // size), pa.array(code % size), pa.array(n)], names=["u", "v", "n"])

        for b in batches:
            codes, words, n = cut(b.column(0))
            line = line_of(numbered(words, core)[codes], n, end)
            held.append(line[:-1] * size + line[1:])
            if sum(map(len, held)) > 2_000_000:
                yield out()
                held = []
        if held:
            yield out()

    return texts.select("t").mapInArrow(run, "u long, v long, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))


def _packed(bigrams: DataFrame, buckets: int) -> DataFrame:
    """A row for each bucket of words: all bigrams that begin or end with one of them."""
    sides = bigrams.select(F.col("u").alias("w"), F.col("v").alias("o"), "n", F.lit(1).alias("right")).unionByName(bigrams.select(F.col("v").alias("w"), F.col("u").alias("o"), "n", F.lit(0).alias("right")))

    def pack(x):
        import pandas as pd

        return pd.DataFrame({c: [x[c].to_numpy(np.int64).tobytes()] for c in ("w", "o", "n", "right")})

    return sides.withColumn("bucket", F.pmod("w", F.lit(buckets))).groupBy("bucket").applyInPandas(pack, "w binary, o binary, n binary, right binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("w", "o", "n", "right"))):
            yield [np.frombuffer(x, np.int64) for x in row]


def _class_bigrams(packed: DataFrame, shared, size: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = shared.value, np.zeros(size * size)
        for w, o, n, right in _rows(batches):
            k = right == 1
            total += np.bincount(of[w[k]] * size + of[o[k]], n[k], size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["c", "n"])

    out = np.zeros(size * size)
    for c, n in packed.mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toLocalIterator():
        out[c] = n
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange_gains(left: np.ndarray, right: np.ndarray, own: int, bigrams: np.ndarray, classes: int) -> np.ndarray:
    """The change of the likelihood if a word moved from its class to each clustered class.

    left and right: how often the word follows and precedes each class.  bigrams also has rows and
    columns for what is in no class to move to.
    """
    rows, cols = np.flatnonzero(right), np.flatnonzero(left)
    before, after = bigrams[:classes][:, rows], bigrams[cols][:, :classes].T
    add_r, add_l = right[rows], left[cols]
    gain = (_xlogx(before + add_r) - _xlogx(before)).sum(1) + (_xlogx(after + add_l) - _xlogx(after)).sum(1)
    loss = (_xlogx(before[own]) - _xlogx(np.maximum(before[own] - add_r, 0))).sum() + (_xlogx(after[own]) - _xlogx(np.maximum(after[own] - add_l, 0))).sum()
    out_n, in_n, r, l = bigrams[:classes].sum(1), bigrams[:, :classes].sum(0), right.sum(), left.sum()
    gain -= _xlogx(out_n + r) - _xlogx(out_n) + _xlogx(in_n + l) - _xlogx(in_n)
    loss -= _xlogx(out_n[own]) - _xlogx(out_n[own] - r) + _xlogx(in_n[own]) - _xlogx(in_n[own] - l)
    gain -= loss
    gain[own] = 0.0
    return gain


def may_move(word: int, turn: int) -> bool:
    """Turns come in pairs: in each a fresh half of the words, then the other half."""
    return (hashlib.blake2b(b"%d,%d" % (word, turn // 2), digest_size=1).digest()[0] + turn) % 2 == 1


def _moves(packed: DataFrame, shared, words: int, classes: int, size: int, turn: int) -> list[tuple[int, int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, bigrams = shared.value
        found: list[tuple[int, int]] = []
        for w, o, n, right in _rows(batches):
            mine, place = np.unique(w, return_inverse=True)
            context = np.bincount((place * 2 + right) * size + of[o], n, len(mine) * 2 * size).reshape(len(mine), 2, size)
            for k, word in enumerate(mine):
                if word < words and may_move(int(word), turn):
                    gain = exchange_gains(context[k, 0], context[k, 1], int(of[word]), bigrams, classes)
                    best = int(gain.argmax())
                    if gain[best] > 1e-9:
                        found.append((int(word), best))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["w", "c"])

    return [tuple(r) for r in packed.mapInArrow(run, "w long, c long").collect()]


def likelihood(bigrams: np.ndarray) -> float:
    """The class bigrams' part of the log-likelihood, which exchange raises."""
    return float(_xlogx(bigrams).sum() - _xlogx(bigrams.sum(1)).sum() - _xlogx(bigrams.sum(0)).sum())


def _contexts(texts: DataFrame, shared, classes: int) -> DataFrame:
    """Words outside the core: (word, codes, following) with the classes on both sides of each occurrence, and the
    words that follow it where they are outside too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other, end, size = classes, classes + 1, classes + 2
        core, of = pa.array([w.decode() for w in shared.value], pa.string()), np.array([*shared.value.values(), other])
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            every = pa.concat_arrays([w for w, *_ in held]).dictionary_encode()
            number, first = every.indices.to_numpy(), np.cumsum([0, *(len(w) for w, *_ in held)])
            word = np.concatenate([number[k + x] for k, (_, x, _, _) in zip(first, held)])
            after = np.concatenate([np.where(x < 0, -1, number[k + x]) for k, (_, _, _, x) in zip(first, held)])
            order = np.argsort(word)
            codes, after, n = np.concatenate([c for _, _, c, _ in held])[order], after[order], np.bincount(word)
            present = np.flatnonzero(n)
            n = n[present]
            follow = np.add.reduceat(after >= 0, np.cumsum(n) - n, dtype=np.int64)
            lists = _lists(every.dictionary.take(pa.array(after[after >= 0])), follow)
            made = pa.RecordBatch.from_arrays([every.dictionary.take(pa.array(present)), _binary(codes, n), lists], names=["word", "codes", "following"])
            yield from (made.slice(k, 50_000) for k in range(0, len(present), 50_000))

        for b in batches:
            codes, words, n = cut(b.column(0))
            c, x = line_of(of[numbered(words, core)[codes]], n, end), line_of(codes, n, -1)
            at = np.flatnonzero(c == other)
            if len(at):
                held.append((words, x[at], (c[at - 1] * size + c[at + 1]).astype("<u2"), np.where(c[at + 1] == other, x[at + 1], -1)))
            if sum(len(x) for _, x, _, _ in held) > 1_000_000:
                yield from out()
                held = []
        if held:
            yield from out()

    return texts.select("t").mapInArrow(run, "word string, codes binary, following array<string>")


def join_gains(entries: np.ndarray, word: np.ndarray, n: np.ndarray, words: int, before: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The change of one side's part of the likelihood if each word joined each class.

    entries: the class on that side, word: whose (in order, each word has some), n: how often.
    before[x]: how often each class has x on that side; total: how often each class occurs.
    """
    first = np.flatnonzero(np.diff(word, prepend=-1))
    few = min(16, int(n.max(initial=1)))  # most contexts come a few times
    rises = np.stack([_xlogx(before + k) - _xlogx(before) for k in range(1, few + 1)])
    gain = np.empty((words, len(total)))
    for k in range(0, words, 1_024):
        own = slice(first[k], first[k + 1_024] if k + 1_024 < words else len(word))
        rise = rises[np.minimum(n[own], few) - 1, entries[own]]
        more = np.flatnonzero(n[own] > few)
        x = before[entries[own][more]]
        rise[more] = _xlogx(x + n[own][more, None]) - _xlogx(x)
        gain[k : k + 1_024] = np.add.reduceat(rise, first[k : k + 1_024] - first[k])
    own = np.bincount(word, n, words)
    sizes, which = np.unique(own, return_inverse=True)
    return gain - (_xlogx(total + sizes[:, None]) - _xlogx(total))[which]


def joined_classes(every: np.ndarray, n: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """The class that each word joins, given the codes of its n occurrences, one word's after another's.

    Words with one occurrence are many and have few different codes: each code is worked out once.
    """
    size, once = classes + 2, n == 1
    alone = np.repeat(once, n)
    code, same = np.unique(every[alone], return_inverse=True)
    several, words = int((~once).sum()), int((~once).sum()) + len(code)
    at = np.concatenate([every[~alone], code])
    whose = np.concatenate([np.repeat(np.arange(several), n[~once]), np.arange(several, words)])
    gain = np.zeros((words, classes))
    sides = (at // size, table[:, :classes], table.sum(0)), (at % size, table[:classes].T, table.sum(1))
    for x, before, total in sides:
        key, k = np.unique(whose * size + x, return_counts=True)
        gain += join_gains(key % size, key // size, k, words, np.ascontiguousarray(before), total[:classes])
    best, out = gain.argmax(1), np.empty(len(n), np.int64)
    out[~once], out[once] = best[:several], best[several:][same]
    return out


def _joined(contexts: DataFrame, shared, classes: int) -> DataFrame:
    """(word, codes, following) to three kinds of rows: (word, n, class); (word, before) for each time a word follows
    one of the class before; and without a word (n, class): how often two classes (a code) follow one another there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size, names = shared.value, classes + 2, ["word", "n", "class", "before"]
        met = np.zeros(size * size)

        def out(rows: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Rows in the order of their words; first: each word's first row."""
            every, n = _cells(rows.column("codes").combine_chunks(), "<u2")
            every, n = every.astype(np.int64), np.add.reduceat(n, first)
            best = joined_classes(every, n, table, classes)
            own, left, right = np.repeat(best, n), every // size, every % size
            for code, x in ((left * size + own, left), (own * size + right, right)):
                met[:] += np.bincount(code[x != classes], minlength=size * size)
            words = rows.column("word").combine_chunks().take(pa.array(first))
            yield pa.RecordBatch.from_arrays([words, pa.array(n), pa.array(best), pa.nulls(len(n), pa.int64())], names=names)
            lists = rows.column("following").combine_chunks()
            times = np.add.reduceat(pc.list_value_length(lists).to_numpy(), first, dtype=np.int64)
            none = pa.nulls(int(times.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([lists.flatten(), none, none, pa.array(np.repeat(best, times))], names=names)

        def chunks() -> Iterator[tuple[pa.Table, np.ndarray]]:
            """All rows of some words at a time."""
            held, have = [], 0
            for b in batches:
                held.append(b)
                have += b.num_rows
                if have >= 20_000:
                    rows, first = begun(held)
                    if len(first) > 1:
                        yield rows.slice(0, first[-1]), first[:-1]
                    held = rows.slice(first[-1]).to_batches()
                    have = 0
            if held:
                rows, first = begun(held)
                if len(first):
                    yield rows, first

        def begun(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
            rows = pa.Table.from_batches(held).combine_chunks()
            words = rows.column("word").combine_chunks()
            return rows, np.concatenate([np.zeros(min(1, len(words)), np.int64), 1 + np.flatnonzero(pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False))])

        for rows, first in chunks():
            yield from out(rows, first)
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.array(met[at].astype(np.int64)), pa.array(at), pa.nulls(len(at), pa.int64())], names=names)

    ordered = contexts.repartition("word").sortWithinPartitions("word")
    return ordered.mapInArrow(run, "word string, n long, class long, before long")


def fit_classes(
    texts: DataFrame,
    counts: DataFrame,
    *,
    core: int = 8_192,
    classes: int = 128,
    rounds: int | None = None,
    smoothing: float = 8.0,
    buckets: int = 64,
) -> ClassModel:
    """The model of training texts(t), given their word counts(word, n).

    ``core`` words find their classes together, by exchange, all others one by one; ``rounds`` ends
    the exchange early.
    """
    if not 0 < classes < _HOLE:
        raise ValueError(f"classes must be fewer than {_HOLE}")
    spark = texts.sparkSession
    ship_package(spark)
    n_types, n_once, n_words = counts.agg(F.count("*"), F.count_if(F.col("n") == 1), F.coalesce(F.sum("n"), F.lit(0))).first()
    first = counts.orderBy(F.desc("n"), "word").limit(core).collect()
    words = [r["word"].encode() for r in first]
    packed = written(_packed(_bigrams(texts, spark.sparkContext.broadcast(words)), buckets), "bigrams")
    other, end, size = classes, classes + 1, classes + 2
    of = np.concatenate([np.arange(len(words)) % classes, [other, end]])
    best, table, rises, turn = None, None, [], 0
    while True:
        bigrams = _class_bigrams(packed, spark.sparkContext.broadcast(of), size)
        now = likelihood(bigrams)
        if best is None or now > best[0]:
            best, table = (now, of.copy()), bigrams
        rises.append(best[0])  # by turn, the most so far
        settled = turn and turn % 2 == 0 and rises[-1] - rises[-3] <= 1e-3 * (rises[-1] - rises[0])
        if settled or turn == rounds or not words:
            break
        of = of.copy()
        for w, c in _moves(packed, spark.sparkContext.broadcast((of, bigrams)), len(words), classes, size, turn):
            of[w] = c
        turn += 1
    discard(packed)
    of = best[1][: len(words)].tolist()

    # the other words, and all class bigrams that they are part of
    contexts = _contexts(texts, spark.sparkContext.broadcast(dict(zip(words, of))), classes)
    joined = written(_joined(contexts, spark.sparkContext.broadcast(table), classes), "joined")
    known = spark.createDataFrame([(r["word"], r["n"], c) for r, c in zip(first, of)], "word string, n long, class long")
    others = joined.where("word is not null and class is not null").select("word", "n", "class")
    vocabulary = written(others.unionByName(known), "vocabulary")
    whole = table.copy()
    whole[other] = 0
    whole[:, other] = 0
    for code, n in joined.where("word is null").groupBy("class").agg(F.sum("n")).collect():
        whole[code // size, code % size] += n
    pairs = joined.where("before is not null").select("word", F.col("before").alias("a"))
    pairs = pairs.join(vocabulary.select("word", F.col("class").alias("b")), "word").groupBy("a", "b").agg(F.count("*").alias("n"))
    for a, b, n in pairs.collect():
        whole[a, b] += n
    discard(joined)
    whole = np.delete(np.delete(whole, other, 0), other, 1)
    n_class = whole.sum(0)
    prior = (n_class + 1) / (n_class.sum() + classes + 1)
    transition = (whole + smoothing * prior) / (whole.sum(1, keepdims=True) + smoothing)
    n_texts = int(n_class[classes])
    new = (n_once + 1) / (n_words + n_texts + 2)
    return ClassModel(uuid.uuid4().hex, vocabulary, classes, np.log10(np.vstack([transition, prior])), np.log10(np.maximum(n_class, 1.0)), new, n_words + n_texts, n_types + bool(n_texts), n_texts)


def _head(shared) -> tuple:
    """The head's words; by their places the classes, and the counts; the last is that of all others."""
    name, joined, classes, counts = shared.value

    def build() -> tuple:
        words = pa.array(joined.decode().split("\n") if joined else [], pa.string())
        return words, np.append(classes, _HOLE).astype(np.uint8), np.append(counts, 0)

    return worker_value(name, build)


def score_texts(docs: DataFrame, model: ClassModel, *, text: str = "text", head: int = 200_000) -> DataFrame:
    """docs without their text, with n_tokens, n_known, train_tokens, base_score and score.

    One row comes out for each row that goes in; columns of docs with the new names are replaced.  A
    null text is empty: its only token is the end.  Without training texts every token is new.
    """
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = model.vocabulary
    levels = sorted((r["n"], r["k"]) for r in vocabulary.groupBy("n").agg(F.count("*").alias("k")).toLocalIterator())
    most, least = 0, 1
    for n, k in reversed(levels):
        most, least = most + k, n
        if most > head:
            least = n + 1
            break
    top = [(r["word"].encode(), r["class"], r["n"]) for r in vocabulary.where(F.col("n") >= least).toLocalIterator()]
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, b"\n".join(w for w, _, _ in top), np.array([c for _, c, _ in top], np.uint8), np.array([n for _, _, n in top], np.int64)))
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    others = [c for c in docs.columns if c not in (text, *names)]
    given = docs.select(F.struct(*others).alias("row"), F.col(text).alias("t"))
    kind = given.schema["row"].dataType.simpleString()
    end, n_texts = model.classes, model.n_texts

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_words, of, counts = _head(shared)
        base_log, model_log = np.log10(counts + 1), np.log10(np.maximum(counts, 1))
        key = TaskContext.get().partitionId() << 40
        for b in (b.slice(i, 1_000) for b in batches for i in range(0, b.num_rows, 1_000)):
            codes, words, n = cut(b.column("t"))
            x = numbered(words, head_words)[codes]
            text = np.repeat(np.arange(len(n)), n)
            line = np.full(len(x) + len(n), end if n_texts else _HOLE, np.uint8)
            line[np.arange(len(x)) + text] = c = of[x]
            open_ = np.flatnonzero(c == _HOLE)
            at = open_ - (np.cumsum(n) - n)[text[open_]]
            holes = pa.StructArray.from_arrays([words.take(pa.array(codes[open_])), pa.array(at, pa.int32())], ["word", "at"])
            sums = (pa.array(np.bincount(text, logs[x], len(n)).astype(float)) for logs in (base_log, model_log))  # whole numbers if all texts are empty
            columns = [b.column("row"), pa.array(np.arange(key, key + len(n))), _binary(line, n + 1), _lists(holes, np.bincount(text[open_], minlength=len(n))), *sums]
            key += len(n)
            yield pa.RecordBatch.from_arrays(columns, names=["row", "key", "classes", "holes", "base", "own"])

    looked = written(given.mapInArrow(look_up, f"row {kind}, key long, classes binary, holes array<struct<word:string,at:int>>, base double, own double"), "looked")
    rest = looked.select("key", F.inline("holes")).join(vocabulary.where(F.col("n") < least), "word")
    filled = rest.groupBy("key").agg(F.collect_list("at").alias("at"), F.collect_list(F.col("class").cast("int")).alias("class"), F.collect_list("n").alias("n"))
    transition, emission, new = model.transition, model.emission, model.new
    denominator, n_types, train = math.log10(model.n_tokens + model.n_types + 1), model.n_types, model.n_tokens

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_log, new_log = math.log10(1 - new), math.log10(new / (n_types + 1))
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            c, n = _cells(b.column("classes"), np.uint8)
            c, start, text = c.astype(np.int64), np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
            total = b.column("base").to_numpy() + math.log10(n_texts + 1) - n * denominator
            own = b.column("own").to_numpy() + math.log10(max(1, n_texts))
            # places are in the order in which the join gave them; each has one
            filled = np.repeat(np.arange(len(n)), pc.fill_null(pc.list_value_length(b.column("at")), 0).to_numpy())
            if len(filled):
                times = b.column("n").flatten().to_numpy()
                c[start[filled] + b.column("at").flatten().to_numpy()] = b.column("class").flatten().to_numpy()
                total = total + np.bincount(filled, np.log10(times + 1.0), len(n))
                own = own + np.bincount(filled, np.log10(np.maximum(times, 1.0)), len(n))
            seen = c != _HOLE
            before = np.where(seen, c, end + 1)
            before = np.concatenate([[end], before[:-1]])
            before[start] = end
            gain = np.bincount(text[seen], transition[before[seen], c[seen]] - emission[c[seen]], len(n))
            k = np.bincount(text[seen], minlength=len(n))
            model_score = own + gain + k * known_log + (n - k) * new_log
            columns = (n, k, np.full(len(n), train), total, model_score)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(v, t) for v, t in zip(columns, types))], names=["row", *names])

    schema = f"row {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return looked.drop("holes").join(filled, "key", "left").mapInArrow(score, schema).select("row.*", *names)


def held_out(rest: Column) -> Column:
    """Held out are rows of remainder 2, and rows without an id, which are never learned from."""
    return F.coalesce(rest == 2, F.lit(True))
