"""Odd rows through every operator, models against their definitions, and the pipeline against brute force."""

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factloom.llm import class_lm, decontam, jaccard, langid, mixing, quality, suffix, token_count, token_file, topk, units
from tests.llm.test_llm_small import BYTE, SF, WORD, groups_by_hand, repeats_by_hand, windows_by_hand

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that operators use themselves."""
    long_text = " ".join(f"word{i % 700} of{i % 11}" for i in range(60_000))
    rows = [(1, long_text, "en", "a", None), (2, long_text, None, None, 5), (3, None, "en", "a", 0), (4, "", None, "b", 0), (4, "", None, "b", 0), (None, "some words here", "en", "a", 1), (None, None, None, None, None), (5, "\x00 \t\n", "en", "a", 3), (6, "one two three four five", "fr", "a", 9), (6, "one two three four five", "fr", "a", 9)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("key", "row", "id", "t", "n", "h", "s", "b", "bucket", "place", "ids", "classes")})


def test_odd_rows_through_each_operator(spark, odd):
    n = odd.count()
    bench = spark.createDataFrame([(1, "word1 of1 word2 of2 word3 of3 word4 of4 word5 of5"), (None, "x"), (2, None)], "item_id long, text string")
    marked = decontam.decontaminate(odd, bench).select("doc_id", "n_words", "n_hit").collect()
    assert len(marked) == n and {x.n_words for x in marked if x.doc_id in (1, 2)} == {120_000} and all(x.n_hit > 0 for x in marked if x.doc_id in (1, 2))
    counts = {x.doc_id: x.n_tokens for x in token_count.count_tokens(odd, WORD).collect()}
    assert counts[1] == counts[2] > 120_000 and counts[3] == counts[4] == 0
    gone = suffix.remove_repeats(odd).collect()
    assert len(gone) == n and all(x.n_removed == x.n_bytes for x in gone if x.doc_id in (1, 2)) and all(x.n_removed == 0 for x in gone if x.doc_id not in (1, 2))
    mixed = mixing.mix(odd).collect()
    assert len(mixed) == n and all(x.mix_slot < 1 << 60 for x in mixed)
    near = {x.doc_id: x.component_id for x in jaccard.near_duplicates(odd).collect() if x.doc_id}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    assert jaccard.one_of_each(odd).columns == odd.columns
    train = odd.select(F.col("text").alias("t"))
    model = class_lm.fit_classes(train, class_lm.count_words(train), core=50, classes=3, rounds=2, buckets=2)
    scored = class_lm.score_texts(odd, model).collect()
    assert len(scored) == n and all(x.n_known == x.n_tokens and x.score < 0 for x in scored)
    labels = spark.createDataFrame([(1, 1), (3, 1), (4, 0), (6, 0), (None, 1)], "doc_id long, quality int")
    assert all(0 <= x.score <= 1 for x in quality.score_quality(odd, quality.fit_quality(odd, labels)).collect())
    found = {x.doc_id: x.lang_pred for x in langid.identify(odd, langid.fit_languages(odd)).collect() if x.doc_id}
    assert found[1] == found[2] == "en" and found[3] == found[4] == found[5] == "und" and found[6] == "fr"


def test_empty_tables_through_each_operator(spark, odd):
    none, bench = odd.limit(0), spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(none, bench).count() == 0 and token_count.count_tokens(none, WORD).count() == 0
    assert suffix.remove_repeats(none).count() == 0 and mixing.mix(none).count() == 0 and jaccard.one_of_each(none).count() == 0
    assert token_file.read_documents(spark, token_file.write_token_file(none, BYTE), 50_257).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(none, quality.fit_quality(none, labels)).count() == 0
    assert langid.identify(none, langid.fit_languages(none)).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_risk_and_its_slopes():
    r = np.random.default_rng(5)
    for shift in (-2.0, 3.0):  # a negative part above and below zero
        zp, zu, prior, e = r.normal(shift, 1, 7), r.normal(-3, 1, 9), 0.6, 1e-6
        logistic = lambda z: math.log1p(math.exp(z))
        positive, negative = quality.pu_risk(zp, zu, prior)
        assert math.isclose(positive, prior * sum(logistic(-z) for z in zp) / 7) and math.isclose(negative, sum(map(logistic, zu)) / 9 - prior * sum(map(logistic, zp)) / 7)
        aim = (lambda p, u: sum(quality.pu_risk(p, u, prior))) if negative >= 0 else (lambda p, u: -quality.pu_risk(p, u, prior)[1])
        whole = np.concatenate([zp, zu])
        slopes = [(aim((whole + d)[:7], (whole + d)[7:]) - aim((whole - d)[:7], (whole - d)[7:])) / (2 * e) for d in np.eye(16) * e]
        assert np.allclose(quality.pu_slopes(zp, zu, prior), slopes, atol=1e-6)
    assert quality.pu_risk(np.full(7, 3.0), zu, 0.6)[1] < 0


def test_kneser_ney_by_hand():
    r = np.random.default_rng(7)
    n, bits = langid.ORDER, langid.BITS
    line = r.integers(0, 6, 400).tolist()
    grams = Counter(tuple(line[i : i + n]) for i in range(len(line) - n + 1))
    code = lambda g: sum(x << bits * (len(g) - 1 - i) for i, x in enumerate(g))
    codes = sorted(map(code, grams))
    model = langid.KneserNey.fit(np.array(codes, np.uint64), np.array([{code(g): k for g, k in grams.items()}[c] for c in codes], float))
    # counts of shorter grams: how many symbols come before them
    levels = {n: dict(grams)}
    for m in range(n - 1, 0, -1):
        before = defaultdict(set)
        for g in levels[m + 1]:
            before[g[1:]].add(g[0])
        levels[m] = {g: len(x) for g, x in before.items()}

    def p(g):
        if not g:
            return 1 / (1 << bits)
        level = levels[len(g)]
        once, twice = (sum(k == v for k in level.values()) for v in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        same = {x: k for x, k in level.items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        lower = p(g[1:])
        return lower if not total else max(0, same.get(g, 0) - d) / total + d * len(same) / total * lower

    probes = [tuple(r.integers(0, 7, n).tolist()) for _ in range(60)] + list(grams)[:40]
    assert np.allclose(model.log_probability(np.array([code(g) for g in probes], np.uint64)), [math.log(p(g)) for g in probes])


def test_pipeline_by_hand(spark, tmp_path):
    """Each stage against brute force, on given documents and odd ones."""
    import corpus_pipeline as C

    docs = C.table(spark, SF, "documents").limit(120).toPandas()
    bench = C.table(spark, SF, "benchmark").toPandas()
    quote = max(bench.text, key=len)
    more = pd.DataFrame([(9_001, None, "en", "src0", None), (9_002, "", None, None, 0), (9_003, "12 34 !!", "en", "src1", 8), (9_004, docs.text[3] + "\n" + quote, docs.lang[3], None, None), (9_005, docs.text[5], docs.lang[5], "src2", 1), (9_006, docs.text[5] + " end", docs.lang[5], "src2", 1)], columns=list(docs.columns))
    docs = pd.concat([docs, docs.iloc[:3], more], ignore_index=True)
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in docs.itertuples(index=False)]
    given = spark.createDataFrame([(*r[:1], *r[1:4], None if r[4] is None else int(r[4])) for r in rows], SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "c1", "mix_slot", "times")})
    given.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(bench.itertuples(index=False, name=None)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, sf = dict(C.STAGES), str(tmp_path)
    now = C.table(spark, sf, "documents")

    def step(name):
        nonlocal now
        now = C.written(stages[name](spark, now, sf), name)
        assert now.columns == given.columns
        return sorted((x.doc_id, x.text) for x in now.collect())

    known = step("language_id")
    assert {i for i, _ in known}.isdisjoint({9_001, 9_002, 9_003}) and len(known) >= 0.97 * (len(rows) - 3) and set(known) <= {(r[0], r[1]) for r in rows}
    groups = groups_by_hand([i for i, _ in known], [t for _, t in known], size=5, percent=80)
    single = step("near_duplicates")
    assert single == sorted((i, dict(known)[i]) for i in {c for *_, c in groups})
    items = [(str(i), t) for i, t in zip(bench.item_id, bench.text)]
    clean = step("decontamination")
    assert clean == [(i, t) for i, t in single if not windows_by_hand(items, t)[1]] and 9_004 not in dict(clean)
    assert step("mixing") == clean
    library = units.tokenizer(public_tokenizers.path(C.VOCABULARY))
    out, at = sorted(stages["token_file"](spark, now, sf).collect(), key=lambda x: x.start), 0
    for x in out:
        ids = library.encode(dict(clean)[x.doc_id], add_special_tokens=False).ids
        assert (x.start, x.n_tokens) == (at, len(ids) + 1)
        at += len(ids) + 1
    assert sorted(x.doc_id for x in out) == [i for i, _ in clean]
    # the empty table
    nothing = C.table(spark, sf, "documents").limit(0)
    for name in ("language_id", "near_duplicates", "decontamination", "mixing", "token_file"):
        assert stages[name](spark, nothing, sf).count() == 0


def test_repeats_at_the_length_of_the_query(spark):
    texts = ["x" * 399, "x" * 400, "ab" * 300, "q " + "passage of some words " * 30 + " r", "s " + "passage of some words " * 30 + " t"]
    base = " ".join(f"w{i * 7919 % 1000}" for i in range(300))
    texts += [f"{k} {base[k * 13 :]} {k * 31}" for k in range(6)] + [base[200:599], base[100:500], base[:400] + " new"]
    got = suffix.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    want = repeats_by_hand(texts, 400)
    assert [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in sorted(got, key=lambda x: x.doc_id)] == want
