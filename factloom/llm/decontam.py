"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

The words of an item (A-Z lower-cased, everything but digits, letters and non-ASCII bytes taken as
a separator) give its windows: every run of ``width`` words, or all words if there are fewer.  The
windows of all items are the patterns of one automaton.  A document is normalised once into a
string of words between single blanks, that string is run through the automaton once, and matches
are mapped back to word numbers and to byte offsets of the original text.

The automaton is broadcast as its patterns, whose total size is checked first: items are dealt to
as many automata as keep each below ``max_pattern_bytes`` (one for any usual benchmark), and a
document is scanned once by each of them.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import append_columns, worker_value

#: Maps bytes of UTF-8: A-Z to a-z, digits, a-z and non-ASCII to themselves, the rest to a blank.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[^ ]+")

_HITS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text; none of null."""
    return text.encode().translate(_FOLD).split() if text else []


def item_windows(text: str | None, width: int) -> set[str]:
    """The windows of an item as pattern strings, one character a byte."""
    w = words(text)
    return {b"".join((b" ", b" ".join(w[i : i + width]), b" ")).decode("latin-1") for i in range(max(1, len(w) - width + 1))} if w else set()


def _automaton(shared) -> tuple[ahocorasick.Automaton, list[list[str]]]:
    key, patterns = shared.value

    def build() -> tuple[ahocorasick.Automaton, list[list[str]]]:
        built, owners = ahocorasick.Automaton(), []
        for pattern, items in patterns:
            built.add_word(pattern, (len(owners), len(pattern), pattern.count(" ") - 1))
            owners.append(items)
        if owners:
            built.make_automaton()
        return built, owners

    return worker_value(key, build)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(built, owners, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    w = words(text)
    if not w or not owners:
        return len(w), [], set()
    line = b"".join((b" ", b" ".join(w), b" ")).decode("latin-1")
    found = list(built.iter(line))
    if not found:
        return len(w), [], set()
    starts = list(accumulate((len(x) + 1 for x in w), initial=0))  # of the blank before each word
    spans, items = [], set()
    for end, (owner, size, count) in found:
        first = bisect_right(starts, end - size + 1) - 1
        spans.append((first, first + count))
        items.update(owners[owner])
    return len(w), _merge(spans), items


def _offsets(text: str | None, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as byte ranges of the original text."""
    if not hits:
        return []
    at = [m.span() for m in _WORD.finditer(text.encode().translate(_FOLD))]
    return [(at[a][0], at[b - 1][1]) for a, b in hits]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    max_pattern_bytes: int = 32 << 20,
) -> DataFrame:
    """docs with n_words, hit_words (runs of word numbers), hit_spans (byte ranges of the original
    text), n_hit, items (sorted ids of the items found) and contaminated.

    One row comes out for each row that goes in, whatever else it holds; columns of docs with those
    names are replaced.  Texts of any length are taken whole.  A null or wordless text has no words and no hits; an item without words or
    id has no window; repeated items and ids count once.  Either table may be empty.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    # a text of n bytes has at most n/2 windows, each shorter than the text and than its longest words
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size * (width + 1) // max_pattern_bytes))
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hit_words": F.lit(None).cast(_HITS), "hit_spans": F.lit(None).cast(_SPANS), "items": F.array().cast("array<string>")})
    for k in range(parts):
        patterns: dict[str, set[str]] = {}
        for i, t in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).toLocalIterator():
            for p in item_windows(t, width):
                patterns.setdefault(p, set()).add(i)
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(p, sorted(v)) for p, v in patterns.items()]))

        def factory(shared=shared):
            built, owners = _automaton(shared)

            def compute(batch: pa.RecordBatch) -> list[pa.Array]:
                n_words, runs, spans, ids = [], [], [], []
                before = zip(batch.column("hit_words").to_pylist(), batch.column("items").to_pylist())
                for t, (run, known) in zip(batch.column(text).to_pylist(), before):
                    n, hits, found = _scan(built, owners, t)
                    hits = _merge([*hits, *((x["first"], x["end"]) for x in run or ())])
                    n_words.append(n)
                    runs.append([{"first": a, "end": b} for a, b in hits])
                    spans.append([{"start": a, "end": b} for a, b in _offsets(t, hits)])
                    ids.append(sorted(found.union(known)))
                pair = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
                return [pa.array(n_words, pa.int64()), pa.array(runs, pair("first", "end")), pa.array(spans, pair("start", "end")), pa.array(ids, pa.list_(pa.string()))]

            return compute

        out = append_columns(out, {"n_words": T.LongType(), "hit_words": _HITS, "hit_spans": _SPANS, "items": T.ArrayType(T.StringType())}, factory)
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", F.col("n_hit") > 0)


def clean_only(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents without any window of the benchmark, with the columns of docs."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no name can clash
    marked = decontaminate(plain, benchmark, text=f"c{docs.columns.index(text)}", **options)
    return marked.where(~F.col("contaminated")).select(*plain.columns).toDF(*docs.columns)
