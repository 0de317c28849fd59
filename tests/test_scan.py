"""The candidate scan against brute force."""

import hashlib
import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import pairs as D
from factloom.operators.nearest import nearest_units
from factloom.operators.segment import units as units_of
from factloom.plans import CORE_QUERIES
from factloom.sources import views


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Memories that differ in a number far behind character 60, and fill up one another's neighbours."""
    path = str(tmp_path_factory.mktemp("scan"))
    texts = [f"The same opening words stand here in front of whatever comes after them, limit is {i % 14} ms." for i in range(52)]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    docs.select("doc_id", F.lit(0).cast("long").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{path}/labels.parquet")
    r = np.random.default_rng(3)
    rows = [(v, r.normal(size=64).tolist(), int(r.choice([0, 3, 1]))) for v in range(208)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def by_hand(spark, sf, k=11):
    m = {x.id: x for x in views.memories(spark, sf).where("status = 'active'").collect()}
    live = []
    for x in views.units(spark, sf).collect():
        own = units_of(m[x.memory_id].subject, m[x.memory_id].content) if x.memory_id in m else []
        if x.unit_index < len(own):
            live.append((x.unit_id, x.memory_id, own[x.unit_index][1], np.array(x.embedding), x.kind))
    near = []
    for a in (x for x in live if x[4] == "text"):
        others = sorted((float(np.sqrt(((a[3] - b[3]) ** 2).sum())), b[0], b) for b in live if b[1] != a[1])[:k]
        near += [(a[0], a[1], b[0], b[1], d, a[2], b[2]) for d, _, b in others if b[4] == "text"]
    judged = spark.createDataFrame(near, "a long, ma long, b long, mb long, distance double, ta string, tb string").withColumn("d", D.pair_decision(F.col("ta"), F.col("tb")))
    version = {x.id: x.version for x in views.memories(spark, sf).collect()}
    known = {p for c in views.conflicts(spark, sf).where("status in ('open', 'applying')").collect() if c.conflict_id % 2 == 0 for p in itertools.combinations(sorted(i for i in c.members if i in version), 2)}
    out = {}
    for x in judged.where("d.action <> 'ignore'").collect():
        pair = min(x.ma, x.mb), max(x.ma, x.mb)
        if pair not in known:
            reasons, distance = out.get(pair, (set(), float("inf")))
            out[pair] = reasons | {x.d.reason}, min(distance, x.distance)
    return {(*p, ",".join(sorted(r)), round(d, 6)) for p, (r, d) in out.items()}


def test_scan_sees_whole_texts_of_all_neighbours(spark, tables, monkeypatch):
    got = {(x.x, x.y, x.reasons, x.distance) for x in CORE_QUERIES["scan_candidates"](spark, tables).collect()}
    assert got == by_hand(spark, tables) and any("numeric" in r for _, _, r, _ in got)


UNITS = "unit_id long, memory_id long, version int, text string, start_offset int, end_offset int, content_hash string"


def scanned(spark, rows, recorded):
    units = D.featured(spark.createDataFrame(rows, UNITS))
    near = spark.createDataFrame([(a[0], b[0], 0.5) for a in rows for b in rows if a[1] != b[1]], "anchor_id long, unit_id long, distance double")
    groups = spark.createDataFrame(recorded, "status string, refs array<string>, candidate string")
    return {(r.x, r.y): r for r in D.scan_candidates(units, near, groups).collect()}


def test_what_is_recorded_is_recorded_by_snapshot(spark):
    rows = [(i, m, v, f"cache ttl is {n} s", 0, 17, f"h{m}") for i, m, v, n in ((1, 1, 1, 60), (2, 2, 1, 75), (3, 3, 2, 90))]
    every = scanned(spark, rows, [])
    assert set(every) == {(1, 2), (1, 3), (2, 3)} and every[1, 3].members == "1@1,3@2"
    key = {"detector_version": "rules", "members": ["1@1", "3@2"], "evidence": [{"member": "1@1", "unit": 1, "span": [0, 17], "hash": "h1"}, {"member": "3@2", "unit": 3, "span": [0, 17], "hash": "h3"}]}
    assert every[1, 3].candidate == hashlib.sha256(json.dumps(key, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    # a dismissed candidate alone, not other pairs of its group
    assert set(scanned(spark, rows, [("not_a_conflict", ["1@1", "2@1", "3@2"], every[1, 3].candidate)])) == {(1, 2), (2, 3)}
    assert set(scanned(spark, rows, [("resolved", ["1@1", "2@1", "3@2"], every[1, 3].candidate)])) == set(every)
    # an active group holds all pairs of its snapshots, and no others
    assert set(scanned(spark, rows, [("open", ["1@1", "2@1"], None)])) == {(1, 3), (2, 3)}
    assert not scanned(spark, rows, [("applying", ["1@1", "2@1", "3@2", "9@1"], None)])
    assert set(scanned(spark, rows, [("open", ["1@1", "3@1"], None), ("open", ["1@1", "2@2"], None), ("open", ["3@2"], None)])) == set(every)
    moved = [(*r[:2], 2, *r[3:]) if r[1] == 1 else r for r in rows]
    assert set(scanned(spark, moved, [("applying", ["1@1", "2@1", "3@2"], every[1, 3].candidate)])) == {(1, 2), (1, 3)}


@pytest.mark.parametrize("a_memory", [3, 40])
def test_nearest_units_against_all_distances(spark, a_memory):
    r = np.random.default_rng(a_memory)
    centres = r.normal(0, 4, (5, 3))
    point = lambda i: [1.0, 2.0, 3.0] if i % 4 == 0 else (centres[i % 5] + r.normal(size=3)).round(1 + i % 3).tolist()
    rows = [(i, i // a_memory, point(i), i % 3 > 0) for i in range(400)] + [(400, 1000, None, True)]  # copies, ties, nulls
    u = spark.createDataFrame(rows, "unit_id long, memory_id long, embedding array<double>, asked boolean")
    want = set()
    for i, m, v, asked in rows[:-1]:
        others = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(v, w))), j) for j, n, w, _ in rows[:-1] if n != m)[:4]
        want |= {(i, j, k, round(d, 9)) for k, (d, j) in enumerate(others, 1)} if asked else set()
    for options in ({}, {"pivots": 8, "block_rows": 16, "strip": 7}):
        got = nearest_units(u, 4, **options).collect()
        assert {(x.anchor_id, x.unit_id, x.rank, round(x.distance, 9)) for x in got} == want
        evaluated = {x.anchor_id: x.evaluated for x in got}
        assert sum(evaluated.values()) < (0.6 if options else 1) * len(evaluated) * 400
    assert nearest_units(u.limit(0), 4).count() == 0 and nearest_units(u.where("unit_id < 3"), 4).count() == 0


def test_what_is_found_grows_by_slots_and_not_by_blocks(spark, monkeypatch):
    from factloom.operators import nearest as N

    kept, write = {}, N.written
    monkeypatch.setattr(N, "written", lambda df, label: kept.setdefault(label, write(df, label)))
    r = np.random.default_rng(9)
    x = r.normal(size=(600, 24)).round(3)  # so many dimensions that the triangle inequality leaves nearly nothing out
    u = spark.createDataFrame([(i, i // 3, v.tolist(), i % 2 == 0) for i, v in enumerate(x)], "unit_id long, memory_id long, embedding array<double>, asked boolean")
    every = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    every[np.arange(600)[:, None] // 3 == np.arange(600)[None] // 3] = np.inf
    want = {(i, int(j)) for i in range(0, 600, 2) for j in np.lexsort((np.arange(600), every[i]))[:3]}
    for rows, slots in ((200, 3), (65_536, 1)):
        kept.clear()
        monkeypatch.setattr(N, "SLOT_ROWS", rows)
        got = N.nearest_units(u, 3, pivots=4, block_rows=8, strip=5)
        assert {(a.anchor_id, a.unit_id) for a in got.collect()} == want
        blocks, found = kept["blocks"].count(), kept["found"].where("unit_id is not null").groupBy("vid").count().agg({"count": "max"}).first()[0]
        assert blocks > 50 and found <= 6 * (1 + slots + 2), (blocks, found)
