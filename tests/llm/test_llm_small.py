"""Each training-data operator against brute force, round trips and edge cases on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import class_lm, decontam, jaccard, langid, mixing, quality, rans, suffix, token_count, token_file, topk, units
from factloom.llm.components import components
from factloom.llm.words import shingle_sets

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SF = "/root/testdata/sf0.001"


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


# ---- 1 decontamination


def windows_by_hand(items, text, width=10):
    words = lambda t: decontam.words(t)
    doc, hit, ids = words(text), set(), set()
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for p in range(len(doc) - n + 1):
                if doc[p : p + n] == w[k : k + n]:
                    hit.update(range(p, p + n))
                    ids.add(str(i))
    return len(doc), len(hit), sorted(ids)


def test_decontamination_by_hand(spark):
    r = random.Random(4)
    word = lambda: r.choice(["alpha", "Beta", "c", "été", "9x", "d-e"])
    items = [(i, " ".join(word() for _ in range(r.choice([0, 1, 3, 10, 14])))) for i in range(8)] + [(8, None), (None, "alpha alpha alpha"), (3, "beta c")]
    docs = [(i, "; ".join(word() for _ in range(r.choice([0, 2, 30, 60])))) for i in range(40)] + [(40, None), (41, ""), (41, items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    given = table(spark, docs).withColumn("n_hit", F.lit("clash"))
    want = sorted((d, *windows_by_hand([x for x in items if x[0] is not None], t)) for d, t in docs)
    for most in (32 << 20, 300):  # one automaton, and several
        got = decontam.decontaminate(given, bench, max_pattern_bytes=most).collect()
        assert sorted((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in got) == want
    one = decontam.decontaminate(table(spark, [(1, "Ü x ALPHA beta!")]), spark.createDataFrame([(1, "alpha Beta")], "item_id long, text string")).first()
    span = one.hit_spans[0]
    assert "Ü x ALPHA beta!".encode()[span.start : span.end] == b"ALPHA beta"
    clean = decontam.clean_only(given, bench)
    assert clean.columns == given.columns and clean.count() == sum(not x[2] for x in want)
    assert decontam.decontaminate(given.limit(0), bench).count() == 0
    assert decontam.clean_only(given, bench.limit(0)).count() == len(docs)


# ---- 2 and 3 tokens


def odd_texts(n, seed=1):
    r = random.Random(seed)
    signs = list("ab'1 .\n\t 　é́İß漢\x1c​#!s") + [" "] * 6
    return ["", " ", "a  b\n c", "it's  x", "a <|endoftext|> b", "x <|startoftext|>y", "I'LL don't", "ΑΣ ΑΣ. x", "la.\nEs Été, b"] + ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_units_give_what_the_library_gives(path):
    texts, library = odd_texts(4000), units.tokenizer(path)
    ids, counts = units.UnitCache(path), units.UnitCache(path, counts=True, most=50)
    for t, a, b in zip(texts, ids.of_texts(texts), counts.of_texts(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(a), "<u4").tolist() == want, t
        assert sum(b) == len(want), t
        assert "".join(units.units(t)) == t


def test_rans_round_trip():
    r = np.random.default_rng(0)
    counts = r.zipf(1.3, 5000).astype(float)
    shared = rans.Frequencies(counts)
    for n in (0, 1, 7, 300, 5000):
        ids = r.integers(0, 5000, n)
        block = rans.encode_block(ids, shared, lanes=16, every=5)
        assert (rans.decode_block(block, shared) == ids).all()
        assert (rans.decode_block(block, shared, 1, 3) == ids[80:240]).all()
    with pytest.raises(ValueError):
        rans.decode_block(block[:-1] + bytes([block[-1] ^ 1]), shared)
    with pytest.raises(ValueError):
        rans.decode_block(b"", shared)
    a, b = b"hello" * 9, b"world!" * 77
    assert rans.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_file(spark):
    docs = [(3, None), (1, "a b c " * 50), (1, "a b c " * 50), (None, "x y"), (2, ""), (9, "hello <|endoftext|> you")] + list(enumerate(odd_texts(40, 3), 20))
    given = table(spark, docs).withColumn("key", F.lit(1))
    library, at = units.tokenizer(BYTE), 0
    path = token_file.write_token_file(given, BYTE, block_ids=100, lanes=8)
    got = sorted(token_file.read_documents(spark, path, 50257).collect(), key=lambda r: r.start)
    for row, (i, t) in zip(got, sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)), strict=True):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (row.key, row.start, row.n_tokens, row.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_file.read_documents(spark, token_file.write_token_file(given.limit(0), BYTE), 50257).count() == 0


def test_token_counts(spark):
    r = random.Random(3)
    piece = lambda: r.choice(["a", "b", "é", " ", "  ", "\n", "'s", "x" * r.randint(1, 90), "漢", "1"])
    docs = [(i, "".join(piece() for _ in range(r.choice([0, 5, 80, 300])))) for i in range(40)] + [(100, None), (101, "z" * 1500), (102, " " * 900), (102, "a b")]
    library = units.tokenizer(WORD)
    given = table(spark, docs).withColumn("n_tokens", F.lit("clash"))
    got = token_count.count_tokens(given, WORD, huge=100, overlap=10, limit=20).collect()
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t in docs)
    assert sorted((x.doc_id, x.n_bytes, x.n_tokens, x.over_limit) for x in got) == want
    assert token_count.count_tokens(given.limit(0), WORD).count() == 0


# ---- 4 repeated strings


def repeats_by_hand(texts, length):
    seen, data, out = Counter(), [(t or "").encode() for t in texts], []
    for b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    for b in data:
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        gone = np.cumsum(mark)[:-1] > 0 if len(b) else np.zeros(0, bool)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_repeated_strings(spark):
    r = random.Random(2)
    shared = ["".join(r.choice("abcdé \n") for _ in range(r.choice([100, 150, 300]))) for _ in range(8)]
    part = lambda: r.choice([r.choice(shared), "".join(r.choice("abcdefgh ") for _ in range(r.randint(1, 200)))])
    texts = ["".join(part() for _ in range(r.randint(0, 6))) for _ in range(90)] + ["a" * 500, "ab" * 300, "", None]
    texts += [texts[0], texts[1], "x" * 129 + "a" * 130]
    given = table(spark, [*enumerate(texts), (5, texts[5])])
    want = repeats_by_hand([*texts, texts[5]], 130)
    got = suffix.remove_repeats(given, length=130, reach=8).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == sorted((i, *w) for i, w in zip([*range(len(texts)), 5], want))
    assert suffix.remove_repeats(given.limit(0)).count() == 0


# ---- 5 mixing


def test_pfair_deviation():
    for weights in ({"a": 5, "b": 1, "c": 0.5}, {str(i): 1 + i % 3 for i in range(19)}, {"x": 1}):
        parts = mixing.shares(weights, 128)
        had = Counter()
        for slot, (k, n, due) in enumerate(mixing.pfair_period(parts), 1):
            had[k] += 1
            assert had[k] == n and slot <= due
            assert all(abs(had[s] - slot * q / 128) < 1 for s, q in parts.items())


def test_mix(spark):
    rows = [(i, "ab" * (i % 7), "hot" if i % 3 else f"s{i % 4}") for i in range(300)] + [(None, None, None), (7, "x", "hot"), (7, "x", "hot")]
    given = table(spark, rows, "doc_id long, text string, source string").withColumn("mix_slot", F.lit(1))
    got = mixing.mix(given, {"hot": 2.0, "s0": 1.0, "": 1.0, "s1": 0.5}, block_bytes=16, period=32, bucket_rows=10).collect()
    assert len(got) == len(rows)
    place = defaultdict(int)
    for x in sorted((x for x in got), key=lambda x: (x.source or "", x.mix_place)):
        assert x.mix_place == place[x.source] or not x.text  # end to end
        place[x.source] += len(x.text or "")
        assert x.mix_release is None or x.mix_release <= x.mix_slot < x.mix_deadline
        assert x.mix_block == x.mix_place // 16 + 1
    assert {x.source for x in got if x.mix_slot > 1 << 60} == {"s2", "s3"} & {x.source for x in got}
    assert mixing.mix(given.limit(0)).count() == 0


def test_mix_keeps_exact_weights(spark):
    few = {str(i): (1 / 3 if i == 0 else 2 / 57) ** 0.5 for i in range(20)}
    for weights, first, slots in (({"hot": 0.9, **{f"s{i:02}": 0.1 / 99 for i in range(99)}}, "hot", 900), (few, "0", 4_000)):
        total = sum(map(Fraction, weights.values()))
        share = {k: Fraction(w) / total for k, w in weights.items()}
        rows = [(i, k) for k, w in share.items() for i in range(int(slots * w) + 2)]  # none runs out before
        docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("b", F.lit(16))
        got = mixing.mix(docs, weights, size="b", block_bytes=16).select("source", "mix_slot", "mix_release", "mix_deadline").collect()
        had = Counter()
        for t, x in enumerate(sorted(got, key=lambda x: x.mix_slot)[:slots], 1):
            had[x.source] += 1
            assert x.mix_slot == t - 1 and x.mix_release < t <= x.mix_deadline
            assert all(abs(had[k] - t * share[k]) < 1 for k in (x.source, first))


def test_slots_in_pieces_agree(spark):
    weights, blocks = {"a": 0.3, "b": 0.6, "c": 0.1}, {"a": 9, "b": 4, "c": 5}
    one, many = (sorted(map(tuple, mixing.slot_table(spark, weights, blocks, piece=p).collect())) for p in (100, 4))
    assert one == many and len(one) == 18


# ---- 6 class bigrams


def classes_by_hand(train, of, classes, smoothing=8.0):
    """Transitions and emissions of training texts, given every word's class; the end is the class after them."""
    pair, n, end = defaultdict(float), Counter(), classes
    words = Counter(w for t in train for w in class_lm.tokens(t))
    for t in train:
        line = [end, *(of[w] for w in class_lm.tokens(t)), end]
        for a, b in zip(line, line[1:]):
            pair[a, b] += 1
            n[b] += 1
    total = sum(n.values())
    prior = {c: (n[c] + 1) / (total + classes + 1) for c in range(classes + 1)}
    p = lambda a, b: (pair[a, b] + smoothing * prior[b]) / (sum(pair[a, c] for c in range(classes + 1)) + smoothing) if a is not None else prior[b]
    new = (sum(v == 1 for v in words.values()) + 1) / (total + 2)

    def score(text):
        out, before = 0.0, end
        for w in [*class_lm.tokens(text), None]:
            c, k = (end, n[end]) if w is None else (of.get(w), words[w])
            out += math.log10((1 - new) * p(before, c) * k / n[c]) if c is not None else math.log10(new / (len(words) + 2))
            before = c
        return out

    return score, p


def test_class_model(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice(["le la", "the of"][i % 2].split() + [f"w{r.randint(0, 60)}"]) for _ in range(r.randint(0, 40))) for i in range(120)]
    train = table(spark, list(enumerate(texts[:100])), "doc_id long, t string")
    counts = class_lm.count_words(train).cache()
    model = class_lm.fit_classes(train, counts, core=20, classes=4, rounds=3, buckets=3)
    assert np.allclose((10**model.transition).sum(1), 1)
    odd = [(500, None), (501, "never seen The"), (502, "new " * 5_000 + "the of " * 5_000), (0, texts[0])]
    docs = table(spark, [*enumerate(texts), *odd]).withColumn("score", F.lit("clash"))
    c = Counter(w for t in texts[:100] for w in class_lm.tokens(t))
    total, kinds = sum(c.values()) + 100, len(c) + 1
    by = dict([*enumerate(texts), *odd])
    of = {x.word.encode(): x["class"] for x in model.vocabulary.collect()}
    assert {x.word.encode(): x.n for x in model.vocabulary.collect()} == c and set(of.values()) <= set(range(4))
    score, p = classes_by_hand(texts[:100], of, 4)
    for head in (200_000, 5):
        got = class_lm.score_texts(docs, model, head=head).collect()
        assert sorted(x.doc_id for x in got) == sorted([*range(120), 500, 501, 502, 0])
        for x in got:
            w = class_lm.tokens(by[x.doc_id])
            assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w) + 1, sum(c[y] > 0 for y in w) + 1, total)
            want = sum(math.log10((c[y] + 1) / (total + kinds + 1)) for y in w) + math.log10(101 / (total + kinds + 1))
            assert abs(x.base_score - want) < 1e-5 and abs(x.score - score(by[x.doc_id])) < 1e-5 * len(w) + 1e-6
    assert class_lm.score_texts(docs.limit(0), model).count() == 0
    none = class_lm.fit_classes(train.limit(0), counts.limit(0), core=20, classes=4)
    assert [(x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in class_lm.score_texts(table(spark, odd[:2]), none).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0), (4, 0, 0, 0.0)]


def test_a_word_joins_the_class_of_the_most_likelihood():
    r = np.random.default_rng(4)
    table_, xlogx = r.integers(0, 9, (5, 5)).astype(float), lambda x: x * np.log(np.maximum(x, 1.0))  # three classes, other words, the end
    left, right = np.array([2, 0, 1, 0, 3]), np.array([0, 0, 4, 1, 1])
    whole = lambda t: xlogx(t).sum() - xlogx(t.sum(1)).sum() - xlogx(t.sum(0)).sum()
    gain = 0
    for side, before, total in ((left, table_[:, :3], table_.sum(0)[:3]), (right, table_[:3].T, table_.sum(1)[:3])):
        at = np.flatnonzero(side)
        gain = gain + class_lm.join_gains(at, np.zeros(len(at), int), side[at], 1, before, total)[0]
    want = []
    for c in range(3):
        # the sums of the contexts' own rows and columns do not depend on the class joined
        t = table_.copy()
        t[:, c] += left
        t[c] += right
        rest = xlogx(t.sum(1)) - xlogx(table_.sum(1)), xlogx(t.sum(0)) - xlogx(table_.sum(0))
        inner = xlogx(t).sum() - xlogx(table_).sum()
        both = xlogx(table_[c, c] + left[c] + right[c]) - xlogx(table_[c, c] + left[c]) - xlogx(table_[c, c] + right[c]) + xlogx(table_[c, c])
        want.append(inner - both - (xlogx(table_.sum(1)[c] + right.sum()) - xlogx(table_.sum(1)[c])) - (xlogx(table_.sum(0)[c] + left.sum()) - xlogx(table_.sum(0)[c])))
    assert np.allclose(gain, want)


def test_exchange_goes_on_while_the_likelihood_rises(spark, monkeypatch):
    train = table(spark, [(i, "a b c d e f"[: 2 * (i % 6) + 1]) for i in range(20)], "doc_id long, t string")
    turns, values = [], iter([*map(float, range(13)), *[12.0] * 9])
    monkeypatch.setattr(class_lm, "likelihood", lambda b: next(values))
    monkeypatch.setattr(class_lm, "_moves", lambda *a: turns.append(a[-1]) or [])
    monkeypatch.setattr(class_lm, "_class_bigrams", lambda packed, shared, size: np.ones((size, size)))
    class_lm.fit_classes(train, class_lm.count_words(train), core=4, classes=2, buckets=2)
    assert turns == list(range(14))  # 12 that rise, and a pair that doesn't


def test_halves_that_move():
    halves = [{w for w in range(4_000) if class_lm.may_move(w, t)} for t in range(8)]
    assert all(a.isdisjoint(b) and len(a | b) == 4_000 for a, b in zip(halves[::2], halves[1::2]))
    for i in range(0, 8, 2):
        for j in range(0, i, 2):
            assert 800 < len(halves[i] & halves[j]) < 1_200  # neither the same half nor its opposite


# ---- 7 near duplicates


def groups_by_hand(ids, texts, size=4, percent=85):
    sets = []
    for t in texts:
        w = class_lm.tokens(t)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(ids)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i in range(len(ids)):
        least[top(i)] = min(least.get(top(i), 1 << 60), ids[i])
    return sorted((ids[i], len(sets[i]), least[top(i)]) for i in range(len(ids)))


def test_near_duplicates(spark):
    r = random.Random(5)
    texts = []
    for _ in range(25):
        base = [r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(r.choice([3, 8, 20, 60, 120]))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(["x", "y", "z", "q1"])
            texts.append(" ".join(w))
    texts += ["", None, "  ", "one", "one", "One two"]
    given = table(spark, list(enumerate(texts)))
    want = groups_by_hand(list(range(len(texts))), texts)
    # columns of any name play no part
    given = given.withColumns({c: F.lit("clash") for c in ("key", "id", "n", "t", "h", "component_id", "n_shingles")})
    for options in ({}, {"block": 3}):
        got = jaccard.near_duplicates(given, **options).collect()
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == want
    kept = jaccard.one_of_each(given.unionByName(given.where("doc_id < 3")).withColumn("c0", F.lit(1)))
    assert kept.columns == [*given.columns, "c0"]
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, n, c in want if i == c)
    assert jaccard.near_duplicates(given.limit(0)).count() == 0


def test_prefix_tree_misses_none():
    r = random.Random(8)
    for _ in range(400):
        sets = [sorted(r.sample(range(24), r.randint(4, 12))) for _ in range(12)]
        sets = [s for s in sets if s[0] == sets[0][0]]
        for percent in (60, 85):
            for a in sets:
                tree = jaccard.PrefixTree()
                for k, b in enumerate(sets):
                    tree.add(k, len(b), 0, b[1 : jaccard.prefix_length(len(b), percent)])
                found = set(tree.candidates(len(a), 0, a[1 : jaccard.prefix_length(len(a), percent)], percent))
                for k, b in enumerate(sets):
                    n = len(set(a) & set(b))
                    assert k in found or 100 * n < percent * len(set(a) | set(b))


def test_sketches_bound_what_differs():
    r = np.random.default_rng(2)
    for n in (0, 3, 40, 900):
        common, own = r.integers(0, 1 << 63, n).astype(np.uint64), r.integers(0, 1 << 63, 1 + n // 3).astype(np.uint64)
        a, b = np.unique(common), np.unique(np.concatenate([common, own]))
        x, y = jaccard.sketch(a), jaccard.sketch(b)
        bound = jaccard._differing(int.from_bytes(x, "little"), 8 * len(x), int.from_bytes(y, "little"), 8 * len(y))
        assert len(own) // 2 <= bound <= len(own)


def test_shingles_of_a_batch():
    texts = [None, "", "a b", "A  b\tc d e", " x y z w x y z w", "é É ünï " * 5, "w" * 100 + " " + "w" * 101 + " q r", "\x00 \x00\x00 a\x00 b c", "long text " * 30_000]
    for batch in (pa.array(texts), pa.array(["before", *texts])[1:]):
        for text, s in zip(texts, shingle_sets(batch, 4)):
            w = class_lm.tokens(text)
            assert len(s) == len({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))}) * bool(w) and (np.diff(s.astype(object)) > 0).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(30, 40), (40, 35), (7, 7)]
    got = {x.key: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, 30: 30, 40: 30, 35: 30}


# ---- 8 top-k


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(0, 1, 6).round(2)]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (204, [1.0, 2.0]), (3, rows[3][1]), (205, rows[7][1]), (210, [])]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    live = {i: np.floor(1024 * np.float64(np.array(v, np.float32))).tolist() + [0.0] * (6 - len(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in live if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(live[q], v)), i) for i, v in live.items() if i != q)[:7]
        want += [(q, k, i, int(-s)) for k, (s, i) in enumerate(best, 1)]
    for options in ({}, {"block_rows": 20, "query_rows": 4, "blocks_a_slot": 2}):
        got = topk.top_k(given.withColumns({"rank": F.lit("x"), "q": F.lit("x"), "v": F.lit("x")}), F.col("vec_id") % 10 == 0, k=7, **options)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(given.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_of_large_numbers():
    """Scores above 2**53 are exact, and lists are read only as far as the bounds ask."""
    r = np.random.default_rng(3)
    block = r.integers(-(1 << 30), 1 << 30, (300, 5))
    queries = r.integers(-(1 << 29), 1 << 29, (4, 5))
    least = np.full(4, np.iinfo(np.int64).min)
    for q, (rows, scores) in zip(queries, topk.SortedLists(block).search(queries, 6, least, [np.array([7])] * 4)):
        exact = sorted(((sum(int(a) * int(b) for a, b in zip(q, v)), i) for i, v in enumerate(block) if i != 7), reverse=True)
        assert sorted(zip(scores.tolist(), rows.tolist()), reverse=True)[:6] == exact[:6] and len(rows) <= 300 // 8
    with pytest.raises(OverflowError):
        topk.SortedLists(block << 32).search(queries, 6, least, [np.zeros(0, int)] * 4)


# ---- 9 quality and 10 language


def test_quality(spark):
    r = random.Random(9)
    good = lambda: " ".join(r.choice("the quick brown fox jumps over lazy dogs and cats run home again".split()) for _ in range(60)) + "."
    bad = lambda: " ".join(r.choice(["BUY!!", "WIN!!", "$$$", "###"]) for _ in range(60))
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(400)] + [(900, None), (901, ""), (None, "x")]
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(200)] + [(3, 1), (None, 1), (7, None)], "doc_id long, quality int")
    given = table(spark, rows).withColumn("predicted", F.lit("clash"))
    model = quality.fit_quality(given.where("doc_id < 200"), labels)
    got = quality.score_quality(given, model).where("doc_id between 200 and 399").collect()
    assert sum((x.predicted == 0) == (x.doc_id % 5 == 0) for x in got) > 190
    assert all(0 <= x.score <= 1 for x in quality.score_quality(given, model).collect())
    assert {x.score for x in quality.score_quality(given, quality.fit_quality(given, labels.limit(0))).collect()} == {0.5}


def test_language(spark):
    rows = [(i, t * 3, k) for i, (t, k) in enumerate([("hello world the cat and ", "en"), ("le chat est ici et là ", "fr"), ("the dog is out there ", "en"), ("où est la maison ", "fr")] * 20)]
    rows += [(None, "", None), (500, None, "en"), (501, "1234 !!", None), (502, "漢字漢字", None)]
    given = table(spark, rows, "doc_id long, text string, lang string").withColumn("rejected", F.lit("clash"))
    fitted = langid.fit_languages(given)
    got = {x.doc_id: x for x in langid.identify(given, fitted).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows if i is not None and i < 500)
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (None, 500, 501))
    assert got[502].lang_pred in ("en", "fr") and 0 <= got[502].score <= 1
    for history in (0, 8 << 6 | 9, 12345):
        codes = np.array([history << 6 | i for i in range(64)], np.uint64)
        assert abs(np.exp(fitted.models[0].log_probability(codes)).sum() - 1) < 1e-9
    assert langid.known_only(given, fitted).columns == given.columns
    assert {x.lang_pred for x in langid.identify(given, langid.fit_languages(given.limit(0))).collect()} == {"und"}


# ---- queries and pipeline


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = C.table(spark, SF, "documents")
    total, columns = docs.count(), docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
    kept = {x.doc_id for x in docs.select("doc_id").collect()}
    out = sorted(C.STAGES[-1][1](spark, docs, SF).collect(), key=lambda x: x.start)
    assert 0 < len(out) <= total and {x.doc_id for x in out} == kept
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))
    # the stream is in the mixed order
    order = [x.doc_id for x in C.mixing.__globals__["mix"](docs, power=0.5).orderBy("mix_slot", F.coalesce("source", F.lit("")), "mix_place", "doc_id").select("doc_id").collect()]
    assert [x.doc_id for x in out] == order
