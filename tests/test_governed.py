"""Ledger, replay, resolution rules, evaluation and streams on small cases."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import aggregates as A
from factloom.operators import ledger as G
from factloom.operators import ranking as R
from factloom.operators import vector as V
from factloom.operators import workspace as W
from factloom.streaming import index as S


def test_edits_compare_and_set(spark):
    records = spark.createDataFrame([(1, 1, "normal", "unknown", "a"), (2, 1, "locked", "unknown", "b")], "id long, version int, protection_level string, source_type string, content string")
    edits = spark.createDataFrame([(1, 1, 1, "x"), (2, 1, 1, "y"), (3, 1, 2, "z"), (4, 2, 1, "q"), (5, 9, 1, "r"), (6, 1, 5, "s")], "seq long, id long, expect_version int, content string")
    out = G.apply_edits(records, edits)
    assert {r.seq: r.outcome for r in out.collect()} == {1: "applied", 2: "stale", 3: "applied", 4: "protected", 5: "missing", 6: "stale"}
    now = {r.id: (r.version, r.content) for r in G.current_state(records, out).collect()}
    assert now == {1: (3, "z"), 2: (1, "b")}


def test_edit_before_its_version_is_stale(spark):
    records = spark.createDataFrame([(1, 1, "normal", "unknown", "a")], "id long, version int, protection_level string, source_type string, content string")
    edits = spark.createDataFrame([(1, 1, 2, "early"), (2, 1, 1, "x")], "seq long, id long, expect_version int, content string")
    assert {r.seq: r.outcome for r in G.apply_edits(records, edits).collect()} == {1: "stale", 2: "applied"}


def test_edit_sees_what_the_one_before_it_left(spark):
    records = spark.createDataFrame([(1, 1, "normal", "unknown", "port 80, port 80", "active"), (2, 1, "normal", "unknown", "b", "deleted")], "id long, version int, protection_level string, source_type string, content string, status string")
    good = "4f1f1a8c3b0e"
    edits = spark.createDataFrame(
        [(1, 1, 2, "early", None, None, None), (2, 1, 1, None, "80", "90", None), (3, 1, 2, "port 1", None, None, None), (4, 1, None, None, "80", "x", None), (5, 1, None, "  ", None, None, None),
         (6, 1, None, "c", "port", "p", None), (7, 1, None, None, "port", None, None), (8, 1, None, "d", None, None, good), (9, 2, 1, "z", None, None, None)],
        "seq long, id long, expect_version int, content string, old_text string, new_text string, expect_hash string")
    out = G.apply_edits(records, edits)
    got = {r.seq: (r.outcome, r.reason, r.version_after) for r in out.collect()}
    assert got == {
        1: ("stale", "version_mismatch", None), 2: ("applied", None, 2), 3: ("applied", None, 3), 4: ("stale", "old_text_not_found", None), 5: ("invalid", "empty_content", None),
        6: ("invalid", "full_and_partial", None), 7: ("invalid", "no_content", None), 8: ("stale", "content_hash_mismatch", None), 9: ("not_active", "deleted", None)}
    assert sorted((r.version, r.content) for r in G.history_rows(out).collect()) == [(1, "port 80, port 80"), (2, "port 90, port 80")]
    assert {r.id: r.content for r in G.current_state(records, out).collect()} == {1: "port 1", 2: "b"}


def test_replay(spark):
    lines = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "b", False), (4, "c", True)], "line_no long, replay_key string, valid boolean")
    known = spark.createDataFrame([("c",)], "replay_key string")
    assert {r.line_no: r.outcome for r in A.replay_page(lines, known).collect()} == {1: "eligible", 2: "duplicate", 3: "invalid", 4: "replayed"}


def test_workspace_rule(spark):
    resolved = spark.createDataFrame([("proj", "proj", "exact", ""), ("near", "other", "vector", "a template"), ("tie", "other", "vector", ""), ("strong", "other", "vector", ""), ("notes", "notes", "new", ""), ("fresh", "fresh", "new", ""), ("miss", "miss", "new", "")], "ws string, canonical string, matched_by string, hint string")
    similar = spark.createDataFrame([("tie", "other", 0.1, False), ("tie", "b", 0.12, False), ("strong", "other", 0.1, False), ("miss", "b", 0.3, False)], "ws string, name string, distance double, rejected boolean")
    got = {r.ws: (r.decision, r.reason) for r in W.rule(resolved, similar).collect()}
    assert got == {"proj": ("AUTO", "exact"), "near": ("KEEP", "reference_material"), "tie": ("ASK", "candidate_near_tie"), "strong": ("AUTO", "vector_strong"), "notes": ("ASK", "low_signal_generic"), "fresh": ("AUTO", "new_specific_canonical"), "miss": (None, "near_miss_candidates")}


def test_arbitration_group(spark):
    df = spark.createDataFrame([(1, "g", "unknown", "normal", "2026-01-01", "2026-01-01", 0.5), (2, "g", "unknown", "normal", "2026-02-01", "2026-01-01", 0.1), (3, "h", "user_confirmed", "locked", "2026-01-01", "2026-01-01", 0.5), (4, "h", "user_confirmed", "locked", "2026-02-01", "2026-01-01", 0.5)], "id long, slot string, source_type string, protection_level string, event_time string, ingest_time string, confidence double")
    df = df.withColumns({c: F.col(c).cast("date") for c in ("event_time", "ingest_time")})
    assert {r.slot: r.winner for r in R.arbitrate_groups(df, "slot").collect()} == {"g": 2, "h": None}


def test_batch_knn_blocks_agree(spark):
    rows = [(i, i // 2, [float((i * 7) % 5), float((i * 3) % 4)]) for i in range(40)]
    u = spark.createDataFrame(rows, "unit_id long, memory_id long, embedding array<double>")
    small, large = (sorted(map(tuple, V.batch_knn(u, u, 3, block=b).collect())) for b in (7, 1000))
    assert small == large and len(small) == 120


def test_batch_knn_in_bounded_memory_and_few_scans(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(5_000, 16)).round(2), np.ones((1_500, 16)), np.full((1, 16), np.nan)])  # ties, many copies
    ids, memories, few = np.arange(len(x)), np.arange(len(x)) // 3, slice(4_800, 5_200)
    found = V.Nearest(ids[few], memories[few], x[few], 4, 256)
    tracemalloc.start()
    for s in range(0, len(x), 5_000):
        found.meet(ids[s : s + 5_000], memories[s : s + 5_000], x[s : s + 5_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6, peak
    d = np.sqrt(((x[few, None, :] - x[None, :-1, :]) ** 2).sum(-1))
    d[memories[few, None] == memories[None, :-1]] = np.inf
    want = np.lexsort((np.broadcast_to(ids[:-1], d.shape), d), axis=1)[:, :4]
    assert (found.unit == want).all() and (found.distance == np.take_along_axis(d, want, 1)).all()
    u = spark.createDataFrame([(i, i // 2, [float((i * 7) % 5), 1.0]) for i in range(40)] + [(99, 99, None)], "unit_id long, memory_id long, embedding array<double>")
    plan = V.batch_knn(u, u, 3, block=7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "s", "one two. three"), (1, 2, "s", "newer text here"), (2, 1, None, "other body text")], "id long, version int, subject string, content string").coalesce(1).write.parquet(source)
    schema = "id long, version int, subject string, content string"
    S.index_stream(spark.readStream.schema(schema).parquet(source), str(tmp_path / "units"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "units"))
    assert {(r.memory_id, r.memory_version) for r in got.collect()} == {(1, 2), (2, 1)}
    q = S.fresh_only(spark.readStream.schema(schema).parquet(source).select("id", F.col("version").cast("long").alias("version"))).writeStream.format("memory").queryName("fresh").outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.id: r.version for r in spark.table("fresh").collect()} == {1: 2, 2: 1}


def test_write_time_notices(spark, tmp_path):
    schema = "unit_id long, memory_id long, unit_index int, text string, embedding array<double>"
    old = [(1, 10, 0, "cache ttl is 60 s", [1.0, 0.0]), (2, 11, 0, "cache ttl is 75 s", [0.9, 0.1]), (3, 12, 0, "cache ttl is 80 s", [0.8, 0.2]), (4, 13, 0, "nothing alike", [1.0, 0.1])]
    new = [(20, 30, 0, "cache ttl is 90 s", [1.0, 0.0]), (21, 30, 1, "cache ttl is 60 s", [0.0, 1.0]), (22, 30, 30, "cache ttl is 1 s", [1.0, 0.0])]
    published, source = str(tmp_path / "published"), str(tmp_path / "in")
    spark.createDataFrame(old, schema).write.parquet(published)
    spark.createDataFrame(new, schema).coalesce(1).write.parquet(source)
    S.notice_stream(spark.readStream.schema(schema).parquet(source), published, str(tmp_path / "out"), str(tmp_path / "cp"), k=4).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("place").collect()
    assert [(x.anchor, x.peer, x.action, x.reason, x.place) for x in got] == [(30, 10, "check", "numeric_value_candidate", 1), (30, 11, "check", "numeric_value_candidate", 2)]
