"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

Text becomes symbols of a small alphabet: a boundary, white space, digits, other signs, letters by
script for letters that are rare in training, and the most frequent letters (lower-cased).  Each
language has an n-gram model over it.  The counts of the longest n-grams are summed by Spark over
the training texts; lower orders use continuation counts, every order its own discount.  A model is a
pair of sorted arrays of 64-bit hashes for each order: n-grams with their discounted probability, and
histories with the weight of the next lower order; unseen entries give 0 and 1.

A text gets the language of the lowest cross-entropy a symbol.  It is rejected when that is above
what the language's own calibration texts, kept out of training, show, or when it has no letter.

The fit is of a bounded sample: about ``sample_docs`` texts of each language, chosen by a hash of the
id, whole.  Scoring covers every text, whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import append_columns, ship_package, worker_value, written

BITS, ORDER = 6, 4
SPACE, DIGIT, OTHER, SCRIPT, LETTER = 1, 2, 3, 4, 8  # symbol 0 is the boundary


@lru_cache(maxsize=2)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its class symbol, and its lower-case form."""
    kind, low = np.full(0x110000, OTHER, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            y = ord(x.lower()[0])
            kind[c], low[c] = SCRIPT + (y >> 8) % (LETTER - SCRIPT), y
        elif x.isspace():
            kind[c] = SPACE
        elif x.isdigit():
            kind[c] = DIGIT
    return kind, low


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def symbol_table(letters: list[int]) -> np.ndarray:
    """Code point to symbol, given the letters that have one of their own."""
    kind, low = _characters()
    own = np.zeros(0x110000, np.uint8)
    own[letters] = np.arange(LETTER, LETTER + len(letters))
    folded = own[low]
    return np.where((kind >= SCRIPT) & (folded > 0), folded, kind)


def grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram code that ends at each symbol (and at each text's end), where each text's begin, and the symbols."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = ORDER - 1
    at = np.arange(lengths.sum()) + np.repeat((pad + 1) * np.arange(len(texts)) + pad, lengths)
    line = np.zeros(int(lengths.sum()) + (pad + 1) * len(texts), np.uint32)
    line[at] = table[code_points(texts)]
    code = line.copy()
    for k in range(1, ORDER):
        code[k:] |= line[:-k] << np.uint32(BITS * k)
    begin = np.concatenate([[0], np.cumsum(lengths + pad + 1)[:-1]]).astype(np.int64) + pad
    keep = np.ones(len(line), bool)
    for k in range(1, pad + 1):
        keep[begin - k] = False
    return code[keep], begin - pad * (np.arange(len(texts)) + 1), line[keep]


def _hash(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class HashArray:
    """Values of codes, kept as sorted hashes."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, values: np.ndarray) -> HashArray:
        keys = _hash(codes)
        order = np.argsort(keys)
        return cls(keys[order], values[order])

    def get(self, codes: np.ndarray, missing: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(codes), missing)
        h = _hash(codes)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.values[at], missing)


@dataclass
class KneserNey:
    """One language's model."""

    grams: list[HashArray] = field(default_factory=list)  # order 1 first
    histories: list[HashArray] = field(default_factory=list)

    @classmethod
    def fit(cls, codes: np.ndarray, counts: np.ndarray) -> KneserNey:
        model, levels = cls(), [(codes, counts)]
        for n in range(ORDER - 1, 0, -1):
            longer = levels[0][0]
            levels.insert(0, np.unique(longer & np.uint64((1 << (BITS * n)) - 1), return_counts=True))
        for n, (c, k) in enumerate(levels, 1):
            once, twice = int((k == 1).sum()), int((k == 2).sum())
            d = once / (once + 2 * twice) if once and twice else 0.5
            history, place = np.unique(c >> np.uint64(BITS), return_inverse=True)
            total = np.bincount(place, k)
            model.grams.append(HashArray.of(c, (k - d) / total[place]))
            model.histories.append(HashArray.of(history, d * np.bincount(place) / total))
        return model

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), 1.0 / (1 << BITS))
        for n in range(1, ORDER + 1):
            c = codes & np.uint64((1 << (BITS * n)) - 1)
            p = self.grams[n - 1].get(c, 0.0) + self.histories[n - 1].get(c >> np.uint64(BITS), 1.0) * p
        return np.log(p)


@dataclass
class LanguageModels:
    name: str
    languages: list[str]
    letters: list[int]
    models: list[KneserNey]
    limits: np.ndarray  # the highest cross-entropy of a text that is kept, by language


class Scorer:
    """Cross-entropies of texts under all models; the log-probabilities of n-grams met before are kept."""

    def __init__(self, fitted: LanguageModels):
        self.fitted, self.table = fitted, symbol_table(fitted.letters)
        self.place = np.zeros(1 << (BITS * ORDER), np.int32)  # from 1; pages that no text touches take no memory
        self.known = np.zeros((0, len(fitted.languages)), np.float32)

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: nats a symbol by language, its symbols, and whether it has a letter."""
        code, begin, line = grams(texts, self.table)
        new = np.unique(code[self.place[code] == 0])
        if len(new):
            rows = np.stack([m.log_probability(new.astype(np.uint64)) for m in self.fitted.models], 1).astype(np.float32)
            self.place[new] = np.arange(len(self.known), len(self.known) + len(new)) + 1
            self.known = np.concatenate([self.known, rows])
        at = self.place[code] - 1
        sums = np.stack([np.add.reduceat(self.known[:, j][at], begin, dtype=np.float64) for j in range(self.known.shape[1])], 1)
        size = np.diff(np.append(begin, len(code)))
        return -sums / size[:, None], size, np.logical_or.reduceat(line >= SCRIPT, begin)

    def of(self, texts: list[str | None], at_once: int = 1 << 20) -> list[tuple[str, float, bool]]:
        """Language, score and rejection of each text."""
        out: list[tuple[str, float, bool]] = []
        group, have = [], 0
        for k, t in enumerate(texts):
            group.append(t or "")
            have += len(group[-1])
            if have >= at_once or k + 1 == len(texts):
                out += self._some(group)
                group, have = [], 0
        return out

    def _some(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        if not self.fitted.languages:
            return [("und", 0.0, True)] * len(texts)
        h, size, letter = self.cross_entropies(texts)
        best = h.argmin(1)
        least = h[np.arange(len(h)), best]
        # the share of the best language, as if symbols beyond some dozens gave no further evidence
        share = 1 / np.exp(-(h - least[:, None]) * np.minimum(size, 64)[:, None]).sum(1)
        high = least > self.fitted.limits[best] + 4 / np.sqrt(size)
        return [(self.fitted.languages[b], float(s), bool(r)) if x else ("und", 0.0, True) for b, s, r, x in zip(best, share, high, letter)]


def _scorer(fitted: LanguageModels) -> Scorer:
    return worker_value(fitted.name, lambda: Scorer(fitted))


def fit_languages(
    labelled: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_docs: int = 2_000,
    calibration: float = 0.1,
    quantile: float = 0.999,
    slack: float = 0.6,
    most_languages: int = 2_000,
) -> LanguageModels:
    """Models of the languages of labelled rows with a text and a language.

    About ``sample_docs`` rows of each language are used (all, if there are fewer), a tenth of them
    for calibration.
    """
    spark = labelled.sparkSession
    ship_package(spark)
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"over {most_languages} languages")
    if not sizes:
        return LanguageModels(uuid.uuid4().hex, [], [], [], np.zeros(0))
    draw = F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1_000_000))
    shares = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, max(1, round(1_000_000 * min(1.0, sample_docs / n))))])
    kept = rows.where(draw < shares[F.col("lang")])
    kept = written(kept.withColumn("fold", F.pmod(F.xxhash64("k", F.lit("fold")), F.lit(1000)) < int(1000 * calibration)), "sample")
    # a language of few rows may have all of them in one fold; then both folds are the same for it
    train, other = kept.where("not fold"), kept.where("fold")
    folds = {(r["lang"], r["fold"]) for r in kept.select("lang", "fold").distinct().collect()}
    untrained, unmeasured = ([k for k in sizes if (k, fold) not in folds] for fold in (False, True))
    if untrained:
        train = train.unionByName(other.where(F.col("lang").isin(untrained)))
    if unmeasured:
        other = other.unionByName(kept.where(F.col("lang").isin(unmeasured)))

    def letters_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, low = _characters()
        total = np.zeros(0x110000, np.int64)
        for b in batches:
            points = code_points(b.column(0).to_pylist())
            total += np.bincount(low[points[kind[points] >= SCRIPT]], minlength=0x110000)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["c", "n"])

    counted = train.select("t").mapInArrow(letters_of, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    letters = [r["c"] for r in counted.orderBy(F.desc("n"), "c").limit((1 << BITS) - LETTER).collect()]

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table(letters)
        for b in batches:
            by: dict[str, list[str]] = {}
            for t, k in zip(b.column("t").to_pylist(), b.column("lang").to_pylist()):
                by.setdefault(k, []).append(t)
            for k, texts in by.items():
                code, n = np.unique(grams(texts, table)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(code)), pa.array(code.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "code", "n"])

    counts = train.select("t", "lang").mapInArrow(grams_of, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    models = []
    for k in languages:
        own = counts[counts["lang"] == k].sort_values("code")
        models.append(KneserNey.fit(own["code"].to_numpy(np.uint64), own["n"].to_numpy(np.float64)))
    fitted = LanguageModels(uuid.uuid4().hex, languages, letters, models, np.full(len(languages), np.inf))
    shared = spark.sparkContext.broadcast(fitted)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for b in batches:
            if b.num_rows:
                h, size, _ = scorer.cross_entropies(b.column("t").to_pylist())
                own = [languages.index(k) for k in b.column("lang").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(h[np.arange(len(h)), own]), pa.array(size, pa.int64())], names=["lang", "h", "size"])

    measured = other.select("t", "lang").mapInArrow(entropies, "lang string, h double, size long").toPandas()
    limits = []
    for k in languages:
        own = measured[measured["lang"] == k]
        steady = own[own["size"] >= 200]
        steady = steady if len(steady) else own
        limits.append(float(steady["h"].quantile(quantile)) + slack if len(steady) else np.inf)
    fitted.limits, fitted.name = np.array(limits), uuid.uuid4().hex
    return fitted


def identify(docs: DataFrame, fitted: LanguageModels, *, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected.

    One row comes out for each row that goes in; columns of docs with those names are replaced.  A
    text that is null or has no letter gets the language ``und``, score 0, and is rejected; so does
    every text if no language was learned.  A rejected text with letters keeps its best language.
    Texts of any length are taken whole.  An empty table gives an empty result.
    Ties go to the language whose name sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def factory():
        scorer = _scorer(shared.value)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            found = scorer.of(batch.column(text).to_pylist())
            return [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]

        return compute

    return append_columns(docs, {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}, factory)


def known_only(docs: DataFrame, fitted: LanguageModels, *, text: str = "text") -> DataFrame:
    """The documents whose language is recognised, with the columns of docs."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no name can clash
    marked = identify(plain, fitted, text=f"c{docs.columns.index(text)}")
    return marked.where(~F.col("rejected")).select(*plain.columns).toDF(*docs.columns)


def held_out(rest: Column) -> Column:
    """Held out are rows of remainder 2, and rows without an id, which are never learned from."""
    return F.coalesce(rest == 2, F.lit(True))
