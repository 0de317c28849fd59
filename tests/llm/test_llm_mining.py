"""Licence scans, collocations and hard negatives against brute force, and odd rows through each."""

import random
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import collocation, hard_negatives, licences
from factloom.llm.licence_texts import NOTICES, PHRASES
from factloom.llm.q_licences import op11_licences

SF = "/root/testdata/sf0.001"


def plain_words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c if ord(c) > 127 or c.isalnum() else " " for c in text or "")
    return [w for w in folded.split(" ") if w]


# ---- 11 licence scans


def matches_by_hand(words, notices, phrases, least):
    """(notice, first, end, at) of runs that the next word does not continue, from the longest runs ending at each word."""
    runs = {tuple(t[i:j]) for t in [*notices, *phrases] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    longest = [max([n for n in range(1, e + 2) if tuple(words[e + 1 - n : e + 1]) in runs], default=0) for e in range(len(words))]
    out = set()
    for e, n in enumerate(longest):
        if n >= least and (e + 1 == len(words) or longest[e + 1] != n + 1):
            run = words[e + 1 - n : e + 1]
            out |= {(k, e + 1 - n, e + 1, i) for k, t in enumerate(notices) for i in range(len(t) - n + 1) if t[i : i + n] == run}
    return out


def spans_by_hand(matches, gap):
    """Chains of (first, end, at) of one notice, most words first."""
    matches = sorted(matches)

    def gain(p, m):
        (a, b, i), (c, d, j) = matches[p], matches[m]
        trim = max(0, b - c, i + b - a - j)
        return d - c - trim if d - c > trim and c + trim - b <= gap else None

    @cache
    def best(m):
        ways = [(best(p)[0] + g, p) for p in range(m) if (g := gain(p, m)) is not None]
        own = matches[m][1] - matches[m][0]
        most = max([own, *(w for w, _ in ways)])
        return (own, None) if most == own else (most, max(p for w, p in ways if w == most))

    used, out = set(), []
    for m in sorted(range(len(matches)), key=lambda m: (-best(m)[0], m)):
        chain, at = [], m
        while at is not None and at not in used:
            chain.append(at)
            at = best(at)[1]
        if chain:
            used |= set(chain)
            n = matches[chain[-1]][1] - matches[chain[-1]][0] + sum(gain(p, q) for q, p in zip(chain, chain[1:]))
            out.append((matches[chain[-1]][0], matches[m][1], matches[chain[-1]][2], matches[m][2] + matches[m][1] - matches[m][0], n))
    return sorted(out)


def test_scanner_against_brute_force():
    r = random.Random(2)
    for turn in range(60):
        word = lambda: r.choice("abcd"[: 2 + turn % 3])
        notices = [" ".join(word() for _ in range(r.randint(1, 12))) for _ in range(3)]
        phrases = [" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(3)]
        scanner = licences.Scanner(notices, phrases, 2, 3)
        text = [r.choice([word, lambda: "z"])() if r.random() < 0.3 else word() for _ in range(r.choice([0, 5, 40]))]
        n, places, found = scanner.scan(" ".join(text))
        split = [p.split() for p in phrases]
        assert n == len(text)
        assert sorted(places) == sorted((k, i) for k, p in enumerate(split) for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p)
        want = matches_by_hand(text, [t.split() for t in notices], split, 2)
        assert {(k, *m) for k, ms in found.items() for m in ms} == want
        for k, ms in found.items():
            assert [tuple(s) for s in scanner.spans(ms)] == spans_by_hand({(a, b, i) for q, a, b, i in want if q == k}, 3)


def scan_by_hand(text):
    words, notices, phrases = plain_words(text), [plain_words(t) for _, t in NOTICES], [plain_words(p) for p, _ in PHRASES]
    places = sorted((i, PHRASES[k][1]) for k, p in enumerate(phrases) for i in range(len(words)) if words[i : i + len(p)] == p)
    shares = {}
    found = matches_by_hand(words, notices, phrases, 3)
    for k in {m[0] for m in found}:
        for *_, n in spans_by_hand({m[1:] for m in found if m[0] == k}, 8):
            if n >= 5 and n >= 0.6 * len(notices[k]):
                shares.setdefault(NOTICES[k][0], []).append(n / len(notices[k]))
    base = sorted({x for _, x in places})
    score = 1.0 if places else max([x for s in shares.values() for x in s], default=0.0)
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(sorted({*base, *shares})), score


def test_licence_query_against_brute_force(spark, tmp_path):
    mit, apache = NOTICES[1][1], NOTICES[3][1]
    texts = [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").select("text").limit(60).collect()]
    texts += [None, "", "mit", "MIT License", "x mit license, mit license", "General Public\nLicense apache License", mit, mit.upper(), mit[: len(mit) // 2], apache, f"a {apache} b {mit} c", NOTICES[11][1]]
    w = mit.split()
    texts += [" ".join(w[:40] + ["changed"] + w[41:]), " ".join(w[:30] + ["z"] * 8 + w[30:]), " ".join(w[:30] + ["z"] * 9 + w[30:]), " ".join(w + w), "licensed under the", "licensed under the licensed under the"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_licences(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=lambda x: x[0]) == [(i, *scan_by_hand(t)) for i, t in enumerate(texts)]
    # several automata give the same
    for most in (40, 1):
        small = {x.doc_id: x for x in licences.scan_licences(docs, max_automaton_words=most).collect()}
        whole = {x.doc_id: x for x in licences.scan_licences(docs).collect()}
        same = [i for i, t in enumerate(texts) if t and (mit in t or apache in t)]
        assert all({"mit", "apache"} & set(small[i].licence_labels) for i in same) and all(small[i].phrase_places == whole[i].phrase_places for i in small)
    both = texts.index(f"a {apache} b {mit} c")
    at = 2 + len(plain_words(apache))
    assert [(x.first, x.end, x.n_matched, x.share) for x in whole[both].licence_spans if x.label == "mit"] == [(at, at + len(plain_words(mit)), len(plain_words(mit)), 1.0)]


def test_licences_stand_long_texts_and_blocks(monkeypatch):
    scanner = licences.Scanner([t for _, t in NOTICES], [p for p, _ in PHRASES], 3, 8)
    text = " ".join(["word " * 50, NOTICES[1][1], "x " * 33, "apache license"] * 40)
    whole = scanner.scan(text)
    monkeypatch.setattr(licences, "_BLOCK", 7)
    assert scanner.scan(text) == whole and whole[0] == len(plain_words(text)) and len(whole[1]) == 40


# ---- 12 collocations


def collocations_by_hand(rows, size, least, inside, most):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang, text = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for sign in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(sign, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            counts.update((lang, tuple(words[i : i + m])) for m in range(1, size + 1) for i in range(len(words) - m + 1))
    candidates = {(lang, p): n for (lang, p), n in counts.items() if len(p) > 1 and n >= least}
    out = {}
    for (lang, p), a in candidates.items():
        if any(lang == other and len(q) > len(p) and 100 * n >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), n in candidates.items()):
            continue
        cuts = []
        for k in range(1, len(p)):
            x, y = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1_000_000 * a * a // (x * y), k, x, y))
        score, _, x, y = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), x, y))
    return sorted((lang, rank, p.decode(), -a, x, y, total[lang], -s) for lang, found in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(found)[:most], 1))


@pytest.mark.parametrize("size", [2, 3, 4])
def test_collocations_against_brute_force(spark, monkeypatch, size):
    r = random.Random(size)
    word = lambda: r.choice(["a", "B", "b", "é", "漢", "d-e", "\x00"])
    rows = [("".join(word() + r.choice([" ", " ", "  ", "\t", " ", ". ", "\n", "\x0b", "?", "\r\n"]) for _ in range(r.choice([0, 1, 4, 40]))), r.choice(["x", "y", None])) for _ in range(80)]
    rows += [(None, "x"), ("", None), ("one long passage that comes again and again " * 2, "z")] + [("q w e r t z u i o p", "z")] * 9 + [(" . ,", "z")]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("clash") for c in ("gram", "n", "k", "left")}).repartition(3)
    get = lambda **o: sorted(map(tuple, collocation.mine_collocations(docs, size=size, least=3, **o).collect()))
    assert get() == collocations_by_hand(rows, size, 3, 50, 2_000)
    assert get(most=5, inside=80) == collocations_by_hand(rows, size, 3, 80, 5)
    assert collocation.mine_collocations(docs.limit(0)).count() == 0


def test_edges_in_small_lots(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a b c d. e f", None, "", "a b c", "x" * 30 + " y", "."] * 5)
    langs = pa.array(["l", "l", "m", "m", "l", "l"] * 5)
    count = lambda: sum((Counter({(x["lang"], x["gram"]): x["n"]}) for b in collocation.edge_counts(texts, langs) for x in collocation._texts(*b).to_pylist()), Counter())
    whole = count()
    assert whole["l", "a b c"] == 5 and whole["m", "b c"] == 5 and whole["l", "d"] == 5 and whole["m", "a b c"] == 5 and sum(whole.values()) == 11 * 5
    for n in (1, 2, 3, 7):
        monkeypatch.setattr(collocation, "_AT_ONCE", n)
        assert count() == whole


def test_paths(spark):
    line = "q w e r t z u i o p"
    docs = spark.createDataFrame([(line, "z")] * 12 + [("t z u and", "z")] * 4, "text string, lang string")
    grams = collocation.count_grams(docs, least=3)
    cuts = collocation.cut_candidates(grams.where("gram != ''"))
    got = {x.node: (x.edge, x.next, x.last, x.steps, x.n) for x in collocation.compact_paths(cuts).collect()}
    # "t z" begins a piece and "z u" goes on two ways: both end paths
    assert got == {"w e": ("q w e", "w e r", "r t z", 3, 12), "e r": ("w e r", "e r t", "r t z", 2, 12), "r t": ("e r t", "r t z", "r t z", 1, 12), "u i": ("z u i", "u i o", "i o p", 2, 12), "i o": ("u i o", "i o p", "i o p", 1, 12)}


# ---- 13 hard negatives


def negatives_by_hand(rows, positives=5, negatives=10):
    fit = [(i, y, [int(np.floor(256 * x)) for x in v]) for i, y, v in dict.fromkeys((i, y, tuple(v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v))]
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, v in fit:
        if i % 10:
            continue
        score = lambda o: product(v, o[2])
        best = lambda some: sorted(some, key=lambda o: (-score(o), o[0]))
        for p in best([o for o in fit if o[0] != i and o[1] == y])[:positives]:
            fits = [o for o in fit if o[0] != i and o[1] != y and 30 * score(p) <= 100 * score(o) <= 90 * score(p)]
            out += [(i, p[0], k, o[0], score(p), score(o)) for k, o in enumerate(best(fits)[:negatives], 1)]
    return sorted(out)


def test_intervals_hold_every_score():
    r = np.random.default_rng(3)
    for width in (1, 3, 64, 100):
        turn = hard_negatives.rotation(width)
        for scale in (1, 300, 1 << 20):
            rows, anchors = (r.normal(0, scale, (n, width)).astype(np.int64) for n in (200, 20))
            rows[:3], anchors[0], rows[3:8] = 0, 0, anchors[5]
            low, high = hard_negatives.Codes(rows, turn).intervals(anchors, turn)
            scores = anchors @ rows.T
            assert (low <= scores).all() and (scores <= high).all()
            if width >= 64 and scale > 1:  # beside five copies most others can't be among the best
                assert np.mean(high[5] >= np.sort(scores[5])[-5]) < 0.1


def test_hard_negatives_against_brute_force(spark):
    r = np.random.default_rng(1)
    centres = r.normal(0, 0.2, (6, 16))
    rows = [(i, int(y), [float(x) for x in np.float32(centres[y] + r.normal(0, 0.1, 16))]) for i, y in enumerate(r.integers(0, 6, 300))]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(20)] + [(300 + i, (rows[i][1] + 1) % 6, rows[i][2]) for i in range(20, 40)]  # ties
    rows += [(400, None, rows[0][2]), (410, 1, None), (420, 1, [0.5, None]), (430, 2, [float("nan")] * 16), (440, 2, [float("inf")] * 16), (None, 1, rows[0][2]), (450, 1, rows[4][2][:5]), (460, 9, rows[4][2]), (470, 1, []), rows[7], rows[10]]
    given = spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("id", "anchor", "v", "part", "slot", "score")}).repartition(3)
    want = negatives_by_hand(rows)
    for sizes in ({}, {"block_rows": 32, "group_rows": 4, "blocks_a_slot": 2}):
        got = hard_negatives.mine_hard_negatives(given, F.col("vec_id") % 10 == 0, **sizes).collect()
        assert sorted(map(tuple, got)) == want
    assert len(want) > 500 and hard_negatives.mine_hard_negatives(given.limit(0), F.lit(True)).count() == 0
    huge = spark.createDataFrame([(10, 1, [1e16]), (11, 1, [1e16]), (12, 2, [1e16])], "vec_id long, label long, embedding array<float>")
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine_hard_negatives(huge, F.lit(True)).count()


def test_odd_rows(spark):
    long_text = " ".join(f"word{i % 700} of{i % 11}" for i in range(60_000)) + " apache license"
    rows = [(1, long_text, "en"), (2, long_text, None), (3, None, "en"), (4, "", None), (4, "", None), (None, "mit license", "en"), (None, None, None), (5, "\x00 \t\n", "en")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).withColumns({c: F.lit("clash") for c in ("licence_labels", "n", "gram", "rank")})
    got = sorted(((x.doc_id or 0, x.n_words, list(x.licence_labels), x.rank) for x in licences.scan_licences(odd).collect()))
    assert got == sorted([(1, 120_002, ["apache"], "clash"), (2, 120_002, ["apache"], "clash"), (3, 0, [], "clash"), (4, 0, [], "clash"), (4, 0, [], "clash"), (0, 2, ["mit"], "clash"), (0, 0, [], "clash"), (5, 0, [], "clash")])
    assert licences.scan_licences(odd.limit(0)).count() == 0
    totals = {x.lang: x.n for x in collocation.count_grams(odd).where("gram = ''").collect()}
    assert totals == {"en": 120_002 + 3, "und": 120_002}
