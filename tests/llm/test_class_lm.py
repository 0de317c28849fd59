"""The passes of op6 over texts and words: whole arrays at a time, with the results of one by one."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from factloom.llm import class_lm


def test_words_of_many_texts_at_once():
    r = random.Random(1)
    texts = ["".join(r.choice(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0aAbÄß\x00.Z0") for _ in range(r.randint(0, 30))) for _ in range(500)] + [None, "", " ", "A"]
    for some in (pa.array(texts, pa.string()), pa.array(texts, pa.string()).slice(7, 90), pa.array([None, " "], pa.string()), pa.array([], pa.string())):
        codes, words, n = class_lm.cut(some)
        got = [words[c].as_py().encode() for c in codes.tolist()]
        assert len(n) == len(some) and [got[sum(n[:i]) : sum(n[: i + 1])] for i in range(len(n))] == [class_lm.tokens(t) for t in some.to_pylist()]


def test_words_that_occur_once_are_worked_out_by_their_place(monkeypatch):
    r = np.random.default_rng(2)
    table, n = r.integers(0, 50, (6, 6)).astype(float), np.where(r.random(3_000) < 0.8, 1, r.integers(2, 60, 3_000))
    every = r.integers(0, 36, n.sum())
    one_by_one = []
    for codes in np.split(every, np.cumsum(n)[:-1]):
        gain = 0
        for at, before, total in ((codes // 6, table[:, :4], table.sum(0)), (codes % 6, table[:4].T, table.sum(1))):
            x, k = np.unique(at, return_counts=True)
            xlogx = lambda v: v * np.log(np.maximum(v, 1.0))
            gain = gain + (xlogx(before[x] + k[:, None]) - xlogx(before[x])).sum(0) - (xlogx(total[:4] + len(codes)) - xlogx(total[:4]))
        one_by_one.append(int(gain.argmax()))
    worked, gains = [], class_lm.join_gains
    monkeypatch.setattr(class_lm, "join_gains", lambda *a: worked.append(a[3]) or gains(*a))
    assert class_lm.joined_classes(every, n, table, 4).tolist() == one_by_one
    assert max(worked) <= (n > 1).sum() + 36  # not all 3,000


def test_contexts_are_a_row_a_word(spark):
    texts = ["the X of y X", None, "x y y the", "", "z"] * 40
    given = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    rows = class_lm._contexts(given, spark.sparkContext.broadcast({b"the": 0, b"of": 1}), 2).collect()
    assert sorted(r.word for r in rows) == ["x", "y", "z"]  # pairs of such words are in these rows too
    around, follow, name = Counter(), Counter(), {"the": 0, "of": 1}
    for t in texts:
        w = [x.decode() for x in class_lm.tokens(t)]
        c = [3, *(name.get(x, 2) for x in w), 3]
        around.update((w[i], c[i] * 4 + c[i + 2]) for i in range(len(w)) if c[i + 1] == 2)
        follow.update((a, b) for a, b in zip(w, w[1:]) if a not in name and b not in name)
    assert Counter((r.word, int(c)) for r in rows for c in np.frombuffer(r.codes, "<u2")) == around
    assert Counter((r.word, x) for r in rows for x in r.following) == follow


def test_counts_are_sent_when_many_and_stay_whole(spark):
    texts = [f"a w{i} W{i % 7} b" for i in range(200)]
    given = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    want = Counter(w.decode() for t in texts for w in class_lm.tokens(t))
    for most in (5, 150_000):
        assert {r.word: r.n for r in class_lm.count_words(given, most).collect()} == want
