"""A quality classifier by positive-unlabelled learning with a non-negative risk.

Trusted positives are the texts labelled 1; the unlabelled ones are a sample of all training texts,
whatever their label.  The class prior is estimated as the share of 1 among the training labels.
With prior pi, loss l and scores g, the risk to minimise is

    pi E_P[l(g, +1)] + max(0, E_U[l(g, -1)] - pi E_P[l(g, -1)]),

the non-negative form of the unbiased risk (Kiryo et al., 2017): where the second part falls below
zero on a batch, a step is taken against it.  The scorer is a small network over signals of the text
itself: sizes, shares of kinds of characters and words, repetition and compressibility.

The fit is of a bounded, hash-chosen sample: about ``fit_rows`` positives and as many unlabelled
texts, whole.  Scoring covers every text, whole.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import append_columns, ship_package

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SIGN = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_RARE = b"#$%&*@^~|\\<>{}[]=_+`"
_MARK = b"!?"
_HIGH = bytes(range(128, 256))
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SIGNALS = 30


def signals(text: str | None) -> list[float]:
    """The numbers by which a text is judged, all of the whole text."""
    data = (text or "").encode()
    size = max(1, len(data))
    words = data.split()
    n = max(1, len(words))
    low = data.translate(_FOLD).split()
    seen = Counter(low)
    of = lambda chars: 1 - len(data.translate(None, chars)) / size if data else 0.0
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    pairs = len(set(zip(low, low[1:])))
    ends = Counter(w[-1] for w in words)
    starts = Counter(w[0] for w in words)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    sign_words = sum(v for k, v in ends.items() if k in _RARE)
    capital = sum(v for k, v in starts.items() if k in _UPPER)
    shouted = sum(1 for w in words if len(w) > 1 and w.isupper())
    same = sum(map(bytes.__eq__, low, low[1:]))
    top = seen.most_common(3)
    return [
        math.log1p(len(data)), math.log1p(len(words)), math.log1p(len(lines)),
        lengths.mean(), lengths.std(), float((lengths > 16).mean()), float((lengths <= 3).mean()),
        of(_UPPER), of(_DIGIT), of(_SIGN), of(_RARE), of(_MARK), of(_HIGH), of(b"|"), of(b" \n\t\r"),
        sign_words / n, capital / n, shouted / n, same / n,
        sum(ends[c] for c in b".") / n, sum(ends[c] for c in b"!?") / n, sum(ends[c] for c in b",;:") / n,
        len(seen) / n ** 0.85, pairs / n, (top[0][1] if top else 0) / n, sum(v for _, v in top) / n,
        len(set(lines)) / n_lines, math.log1p(len(data) / n_lines), len(zlib.compress(data, 1)) / size,
        sum(1 for w in low if w == b"|") / n,
    ]


def signal_rows(texts: list[str | None]) -> np.ndarray:
    return np.array([signals(t) for t in texts], np.float64).reshape(len(texts), SIGNALS)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._input(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def _input(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def pu_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk with the logistic loss: of positives as such, and of negatives, estimated
    from unlabelled logits less the positives among them; the second is below zero only by overfitting."""
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def pu_slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> np.ndarray:
    """The slope of the risk by each logit, positives first; where the negative part is below zero, that of its rise alone."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    up = -prior * sigmoid(-zp) / len(zp)
    down = np.concatenate([-prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)])
    return down + np.concatenate([up, np.zeros(len(zu))]) if pu_risk(zp, zu, prior)[1] >= 0 else -down


def fit_positive_unlabelled(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, hidden: int = 24, steps: int = 3_000, batch: int = 1_024, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> QualityModel:
    """Minimise the non-negative risk by Adam; deterministic for a seed."""
    r = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    d = positive.shape[1]
    m = QualityModel(mean, scale, r.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), math.log(prior / (1 - prior)))
    p, u = m._input(positive), m._input(unlabelled)
    theta = [m.w1, m.b1, m.w2, np.array([m.b2])]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        xp, xu = p[r.integers(0, len(p), min(batch, len(p)))], u[r.integers(0, len(u), min(batch, len(u)))]
        x = np.concatenate([xp, xu])
        h = np.tanh(x @ theta[0] + theta[1])
        z = h @ theta[2] + theta[3][0]
        g = pu_slopes(z[: len(xp)], z[len(xp) :], prior)
        gh = np.outer(g, theta[2]) * (1 - h * h)
        grads = [x.T @ gh + decay * theta[0], gh.sum(0), h.T @ g + decay * theta[2], np.array([g.sum()])]
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for i, gr in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * gr
            second[i] = 0.999 * second[i] + 0.001 * gr * gr
            theta[i] = theta[i] - pace * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = theta[0], theta[1], theta[2], float(theta[3][0])
    return m


def _collected(rows: DataFrame) -> np.ndarray:
    """The signals of a bounded sample of texts(t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = signal_rows(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary())], names=["x"])

    return np.array([np.frombuffer(bytes(r["x"])) for r in rows.mapInArrow(run, "x binary").collect()]).reshape(-1, SIGNALS)


def fit_quality(train: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = 12_000) -> QualityModel | None:
    """A model from training rows (id and text) and their labels (id and 0 or 1); None without positives.

    Rows and labels without an id are left out; of repeated labels of an id the highest counts.  Only
    ids of train are looked up among the labels' positives, so labels of other rows teach nothing.
    """
    ship_package(train.sparkSession)
    ids = train.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    marks = marks.join(ids.select("k").distinct(), "k", "left_semi")
    n, ones = marks.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)), F.lit(0))).first()
    rows = ids.count()
    if not ones or not rows:
        return None
    draw = F.pmod(F.xxhash64("k", F.lit("fit")), F.lit(1_000_000))
    within = lambda total: draw < max(1, round(1_000_000 * min(1.0, fit_rows / total)))
    chosen = marks.where((F.col("y") == 1) & within(ones)).select("k")  # about fit_rows ids
    positive = _collected(ids.join(F.broadcast(chosen), "k", "left_semi").select("t"))
    unlabelled = _collected(ids.where(within(rows)).select("t"))
    if not len(positive) or not len(unlabelled):
        return None
    prior = min(0.98, max(0.02, (ones + 1) / (n + 2)))
    return fit_positive_unlabelled(positive, unlabelled, prior)


def score_quality(docs: DataFrame, model: QualityModel | None, *, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 is likelier) and predicted (1 if score >= 0.5).

    One row comes out for each row that goes in; columns of docs with those names are replaced.  A
    null text counts as empty, and texts of any length are taken whole.  Without a model (no training
    rows, or none labelled 1) every score is 0.5.  An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        fitted = shared.value

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(text).to_pylist()
            return [pa.array(fitted.scores(signal_rows(texts)) if fitted else np.full(len(texts), 0.5))]

        return compute

    return append_columns(docs, {"score": T.DoubleType()}, factory).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
