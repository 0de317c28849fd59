"""Review of conflicts with plans, edits of their members, grounding and resolutions."""

import json

from pyspark.sql import functions as F

from factloom.operators import pairs as D
from factloom.operators import review as R

EVENTS = "seq long, " + ", ".join(f"{k} {v}" for k, v in R.EVENTS.items())
CONFLICTS = "conflict_id long, ws string, status string, revision int, members array<struct<memory_id:long,version:int>>, values array<string>"
RECORDS = "id long, version int, ws string, status string, protection_level string, source_type string, content string"


def event(seq, action, revision=None, conflict=1, **o):
    return tuple([seq] + [{"conflict_id": conflict, "action": action, "revision": revision, "authorized": True, **o}.get(k) for k in R.EVENTS])


def run(spark, steps):
    conflicts = [(1, "a", "open", 1, [(10, 1), (11, 1), (11, 3), (12, 2)], ["5s", "30s"]), (2, "a", "resolved", 3, [(20, 1)], ["x"]), (3, "a", "open", 1, [(30, 1), (13, 1)], ["on", "off"])]
    records = [(10, 1, "a", "active", "locked", "unknown", "timeout is 5 s"), (11, 3, "a", "active", "normal", "unknown", "it was 5s"), (12, 9, "a", "active", "normal", "unknown", "z"), (13, 1, "b", "active", "normal", "unknown", "z"), (30, 1, "a", "active", "normal", "unknown", "feature is off"), (40, 4, "a", "active", "normal", "unknown", "timeout is 30s now"), (41, 1, "b", "active", "normal", "unknown", "q")]
    events = spark.createDataFrame([event(i, *s[:-1], **s[-1]) if isinstance(s[-1], dict) else event(i, *s) for i, s in enumerate(steps)], EVENTS).withColumn("note", F.lit("n"))
    out = R.conflict_steps(spark.createDataFrame(conflicts, CONFLICTS), spark.createDataFrame(records, RECORDS), events)
    assert "note" in out.columns
    return out.orderBy("seq").collect()


def test_grounding_is_that_of_columns(spark):
    values = ["5s", "5 s", "8GB", "8G", "postgres", "pgsql", "on", "", " ", "5 秒", "1,000", "a b", "x" * 65, "limit!", "timeout is 5 s", "._.", "1.5s", "15s"]
    quotes = ["timeout is 5 s", "8 gb of it", "uses PostgreSQL 16", "接口超时为 5 秒。", "1000 rows", "turn it on", "", "a b c", "limit! now", "x" * 80, "1.5 s", "v1.5s-x"]
    rows = spark.createDataFrame([(v, q) for v in values for q in quotes], "v string, q string").select("v", "q", D.grounded(F.col("v"), F.col("q")).alias("g"), D.normal_value(F.col("v")).alias("n")).collect()
    assert [(x.v, x.q, x.g) for x in rows] == [(x.v, x.q, R.is_grounded(x.v, x.q)) for x in rows] and any(x.g for x in rows)
    assert all(x.n == R.plain_value(x.v) for x in rows)


def test_judging(spark):
    plan = [(10, "update_current_claim"), (11, "preserve_historical_record")]
    got = run(spark, [
        ("judge", 1, {"plan": plan}), ("judge", 1, {"chosen_value": "30s"}), ("judge", 1, 9, {"chosen_value": "30s", "plan": plan}), ("judge", 3, 2, {"chosen_value": "x", "plan": []}), ("judge", 2, {"chosen_value": "30s", "plan": plan}),
        ("judge", 1, {"chosen_value": "31s", "plan": plan}), ("judge", 1, {"chosen_value": "30s", "plan": [(10, "rewrite")]}), ("judge", 1, {"chosen_value": "30s", "plan": [(30, "use_as_resolution")]}), ("judge", 1, {"chosen_value": "30s", "plan": plan + plan[:1]}),
        ("judge", 1, {"chosen_value": "30s", "plan": [(12, "use_as_resolution")]}), ("judge", 1, 3, {"chosen_value": "on", "plan": [(13, "use_as_resolution")]}), ("judge", 1, {"chosen_value": "30s", "plan": plan, "resolution_id": 41}), ("judge", 1, {"chosen_value": "30 S", "plan": plan, "resolution_id": 40}),
        ("judge", 2, {"chosen_value": "30s", "plan": plan}), ("dance", 2, {})])
    assert [(x.outcome, x.revision_after) for x in got] == [
        ("invalid_input", None), ("invalid_plan", None), ("not_found", None), ("not_open", None), ("stale_conflict", None), ("invalid_chosen_value", None), ("invalid_plan", None), ("invalid_plan", None), ("invalid_plan", None),
        ("stale_member", None), ("stale_member", None), ("invalid_resolution_memory", None), ("applying", 2), ("not_open", None), ("invalid_action", None)]
    assert [(s["memory_id"], s["action"], s["expected_version"], s["status"]) for s in json.loads(got[12].plan_after)["plan"]] == [(10, "update_current_claim", 1, "pending"), (11, "preserve_historical_record", 3, "pending")]


def test_a_step_edits_and_counts_or_does_neither(spark):
    plan = [(10, "update_current_claim"), (11, "append_superseded_context"), (12, "needs_authorization")]
    good = {"memory_id": 10, "step": "update_current_claim"}
    got = run(spark, [
        ("judge", 1, {"chosen_value": "30s", "plan": plan[:2]}), ("apply", 2, {**good, "authorized": False, "old_text": "5 s", "new_text": "30 s"}), ("apply", 2, {**good, "step": "use_as_resolution"}), ("apply", 2, {**good, "memory_id": 12}), ("apply", 1, good),
        ("apply", 2, {**good, "old_text": "nothing", "new_text": "x"}), ("apply", 2, good), ("apply", 2, {**good, "old_text": "5 s", "new_text": "30 s"}), ("apply", 3, {**good, "content": "again"}), ("resolve", 3), ("edit", None, {"memory_id": 11, "content": "moved on", "expect_version": 3}),
        ("apply", 3, {"memory_id": 11, "step": "append_superseded_context", "content": "was 5s"}), ("replan", 3, {"plan": [(11, "append_superseded_context")], "authorized": False}), ("replan", 3, {"plan": [(11, "append_superseded_context")]}),
        ("apply", 4, {"memory_id": 11, "step": "append_superseded_context", "old_text": "moved on", "new_text": "was 5s until then"}), ("resolve", 5), ("resolve", 6), ("edit", None, {"memory_id": 99, "content": "x"})])
    assert [(x.outcome, x.revision_after, x.version_after) for x in got] == [
        ("applying", 2, None), ("unauthorized", None, None), ("invalid_action", None, None), ("invalid_action", None, None), ("stale_conflict", None, None), ("stale", None, None), ("invalid", None, None), ("completed", 3, 2), ("invalid_action", None, None), ("apply_incomplete", None, None),
        ("applied", None, 4), ("stale_member", None, None), ("unauthorized", None, None), ("replanned", 4, None), ("completed", 5, 5), ("resolved", 6, None), ("not_applying", None, None), ("missing", None, None)]
    assert got[7].content_after == "timeout is 30 s" and got[14].content_after == "was 5s until then"
    end = json.loads(got[15].plan_after)
    assert [s["status"] for s in end["plan"]] == ["completed"] and end["history"][0]["revision"] == 3 and [s["status"] for s in end["history"][0]["plan"]] == ["completed", "pending"]


def test_a_value_that_does_not_stand_there_has_failed(spark):
    plan = [(10, "update_current_claim"), (11, "use_as_resolution")]
    got = run(spark, [
        ("judge", 1, {"chosen_value": "30s", "plan": plan}), ("apply", 2, {"memory_id": 10, "step": "update_current_claim", "content": "timeout is 7s"}), ("apply", 3, {"memory_id": 11, "step": "use_as_resolution"}), ("resolve", 4), ("replan", 4, {"plan": [(10, "update_current_claim"), (11, "needs_authorization")]}),
        ("apply", 5, {"memory_id": 10, "step": "update_current_claim", "content": "timeout is 30s"}), ("apply", 6, {"memory_id": 11, "step": "needs_authorization"}), ("replan", 7, {"plan": [(13, "use_as_resolution")]}), ("replan", 7, {"plan": []}), ("resolve", 8)])
    assert [(x.outcome, x.revision_after, x.version_after) for x in got] == [("applying", 2, None), ("apply_failed", 3, 2), ("apply_failed", 4, None), ("apply_incomplete", None, None), ("replanned", 5, None), ("completed", 6, 3), ("apply_failed", 7, None), ("invalid_plan", None, None), ("replanned", 8, None), ("resolved", 9, None)]
    failed = json.loads(got[2].plan_after)["plan"]
    assert [(s["status"], s["error"], s["orphaned_edit"]) for s in failed] == [("failed", "chosen_value_not_grounded", True), ("failed", "chosen_value_not_grounded", False)]
    assert [h["revision"] for h in json.loads(got[9].plan_after)["history"]] == [4, 7]


def test_a_resolution_must_stay_what_it_was(spark):
    got = run(spark, [("judge", 1, {"chosen_value": "30s", "plan": [(11, "preserve_historical_record")], "resolution_id": 40}), ("apply", 2, {"memory_id": 11, "step": "preserve_historical_record"}), ("edit", None, {"memory_id": 40, "old_text": "now", "new_text": "then"}), ("resolve", 3), ("replan", 3, {"plan": []}), ("resolve", 4)])
    assert [x.outcome for x in got] == ["applying", "completed", "applied", "stale_resolution_memory", "replanned", "resolved"]
