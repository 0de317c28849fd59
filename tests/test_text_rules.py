"""Scalars and rules on small cases worked out by hand, and properties that hold for any text."""

import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import lexical as L
from factloom.operators import pairs as D
from factloom.operators import ranking as R
from factloom.operators import vector as V
from factloom.operators import workspace as W
from factloom.operators.segment import GROUP_LEAST, LONG, PART, pieces, segment, units


def all_of(spark, cases, column):
    """The column's value for each case, in one job: column takes a case's number and gives a value or None."""
    chosen = F.array(*[column(*c) for c in cases])
    return spark.range(1).select(chosen.alias("x")).first()[0]


def test_tag_levels(spark):
    cases = [
        (("release 3.1", ["3.1", "release"]), "strong"), (("release 3.1 notes", ["3.1", "release"]), "medium"), (("Release", ["release"]), "strong"), (("v3.1", ["V3.1"]), "strong"),
        (("release 3.1", ["3.1", "draft"]), "medium"), (("cache", ["che"]), "none"), (("cache", []), "none"), ((" ", ["cache"]), "none"), (("3.1", ["3.10"]), "none"),
    ]
    got = all_of(spark, [c for c, _ in cases], lambda t, tags: R.tag_level(t, X.strings(tags)))
    assert dict(zip(map(str, [c for c, _ in cases]), got)) == {str(c): want for c, want in cases}


def test_match_levels_never_fall_with_more_matches(spark):
    order = {"none": 0, "weak": 1, "medium": 2, "strong": 3}
    counts = [(s, g, 4) for s in range(5) for g in range(3)]
    level = dict(zip(counts, all_of(spark, counts, lambda s, g, n: X.match_level(F.lit(s), F.lit(g), F.lit(n)))))
    assert level[0, 0, 4] == "none"
    for s, g, n in counts:
        if s < 4:
            assert order[level[s, g, n]] <= order[level[s + 1, g, n]]
        if g < 2:
            assert order[level[s, g, n]] <= order[level[s, g + 1, n]]


def test_queries_become_groups_of_phrases():
    assert L.compile_query("  ") == []
    assert L.compile_query("Cache  ttl") == [["Cache"], ["ttl"]]
    assert L.compile_query("缓存失效") == [["缓存失", "存失效"]]
    assert L.compile_query("缓存 redis") == [["redis"]]  # two characters give no trigram


@given(st.text("ab", max_size=12), st.text("ab", min_size=1, max_size=3))
@settings(max_examples=200, deadline=None)
def test_phrases_that_may_overlap_themselves(text, phrase):
    plain = (len(text) - len(text.replace(phrase, ""))) // len(phrase)
    every = sum(text.startswith(phrase, i) for i in range(len(text)))
    if not any(phrase.startswith(phrase[k:]) for k in range(1, len(phrase))):
        assert plain == every  # so replacing counts them


def test_occurrences(spark):
    cases = [("banana banana", "ana"), ("aaaa", "aa"), ("xyzxyz", "xyz"), ("", "q")]
    assert all_of(spark, cases, lambda t, p: L.occurrences(F.lit(t), p)) == [4, 3, 2, 0]


@pytest.fixture(scope="module")
def decided(spark):
    cases = {
        "numbers": ("cache ttl is 60 s", "cache ttl is 90 s"),
        "alias": ("Postgres", "postgresql"),
        "case and blanks": ("Retry - count", "retry_count"),
        "scope": ("移动端缓存保留一天", "管理后台缓存保留一天"),
        "todo": ("TODO rotate signing keys", "rotate signing keys 已完成"),
        "polarity": ("服务采用 redis 缓存数据", "服务不采用 redis 缓存数据"),
        "words in common": ("retry budget for uploads", "retry limit for downloads"),
        "nothing": ("alpha beta", "gamma delta"),
        "empty": ("", ""),
    }
    rows = [(k, *x) for k, (a, b) in cases.items() for x in ((a, b), (b, a))]
    df = spark.createDataFrame(rows, "k string, a string, b string").select("k", D.features(F.col("a")).alias("fa"), D.features(F.col("b")).alias("fb"))
    return {k: {tuple(r.d) for r in df.select("k", D.pair_rule(F.col("fa"), F.col("fb")).alias("d")).collect() if r.k == k} for k in cases}


def test_pair_rule_in_either_order(decided):
    assert decided == {
        "numbers": {("check", "numeric_value_candidate")}, "alias": {("ignore", "equivalent_value")}, "case and blanks": {("ignore", "equivalent_value")},
        "scope": {("ignore", "explicit_scope_mismatch")}, "todo": {("notify", "todo_resolved")}, "polarity": {("notify", "polarity_changed")},
        "words in common": {("check", "semantic_similarity_only")}, "nothing": {("ignore", "insufficient_local_evidence")}, "empty": {("ignore", "insufficient_local_evidence")}}


def test_grounding(spark):
    cases = [(("90s", "ttl 为 90 秒"), True), (("postgres", "storage: PostgreSQL"), True), (("4g", "heap 4GB"), True), (("redis", "storage: memcached"), False), ((" ", "x"), False), (("all of it", "all of it"), False)]
    assert all_of(spark, [c for c, _ in cases], lambda v, q: D.grounded(F.lit(v), F.lit(q))) == [x for _, x in cases]


def test_vetoes(spark):
    cases = [("staging uses a", "production uses b"), ("us-east keeps 3", "eu-west keeps 2"), ("平均延迟 5", "峰值延迟 9"), ("a", "b")]
    want = ["coexist_environment_mismatch", "coexist_region_mismatch", "coexist_metric_mismatch", None]
    for swap in (False, True):
        assert all_of(spark, [c[::-1] if swap else c for c in cases], lambda a, b: F.coalesce(D.coexistence_veto(F.lit(a), F.lit(b)), F.lit("none"))) == [w or "none" for w in want]


def test_workspace_names(spark):
    cases = [("  ", "empty"), ("None", "default"), ("Draft", "generic"), ("billing-api", "specific"), ("http://host/x", "suspicious"), ("a\\b", "suspicious"), ("n" * 81, "suspicious")]
    assert all_of(spark, [(n,) for n, _ in cases], lambda n: W.quality(F.lit(n))) == [q for _, q in cases]


def test_guarded_distances(spark):
    cases = [("billing", "billing", 0.0), ("billing-api", "ledger-web", 0.2), ("default", "billing", None), ("q", "billing", None)]
    got = all_of(spark, [c[:2] for c in cases], lambda a, b: F.coalesce(V.guarded_distance(F.lit(a), F.lit(b), F.lit(0.2)), F.lit(-1.0)))
    assert got == [-1.0 if d is None else d for *_, d in cases]


def test_weak_weight_falls_with_the_distance(spark):
    at = [i / 40 for i in range(20)]
    got = all_of(spark, [(d,) for d in at], lambda d: V.weak_weight(F.lit(d)))
    assert got[0] == max(got) > 0 and got[-1] == 0 and got == sorted(got, reverse=True)


def test_kinds_of_units():
    got = units("Cache  policy", "intro line that is long enough\n\n## Limits\nttl is 60 s. size is 4 GB.")
    assert [(k, t) for k, t, *_ in got] == [("subject", "Cache policy"), ("heading", "Limits"), ("text", "intro line that is long enough"), ("text", "ttl is 60 s. size is 4 GB.")]
    assert units(None, None) == [] and units("\t", " \n\n ") == []


_PIECES = st.sampled_from(["缓存", "cache ", "　", "\n", "\n\n", "\r", "？", "!", "; ", "y" * 70, "## t\n", "#", "  ", "é"])


@given(st.lists(_PIECES, max_size=80).map("".join))
@settings(max_examples=300, deadline=None)
def test_a_unit_is_the_text_of_its_range(content):
    found = [(t, a, b) for k, t, a, b in units("s", content) if k == "text"]
    for text, a, b in found:
        assert 0 <= a < b <= len(content) and " ".join(content[a:b].split()) == text
        assert len(text) <= max(LONG, PART + GROUP_LEAST)
    assert [a for _, a, _ in found] == sorted(a for _, a, _ in found)


def test_units_are_made_a_few_records_at_a_time(spark):
    rows = [(i, 1, f"t {i}", "One sentence stands  here.\n And another one! " * 40) for i in range(2_000)] + [(9_999, 1, None, None), (9_998, 2, " ", "\t")]
    u = segment(spark.createDataFrame(rows, "id long, version int, subject string, content string").coalesce(1))
    assert u.count() == sum(len(units(s, c)) for *_, s, c in rows)
    own = u.where("memory_id = 7").orderBy("unit_index").collect()
    assert [tuple(r)[3:] for r in own] == units(*rows[7][2:])
    # of what is held as Python objects there is a bound beside the Arrow batch
    tracemalloc.start()
    for _ in pieces(pa.RecordBatch.from_pylist([dict(zip(("id", "version", "subject", "content"), r)) for r in rows])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6, peak
