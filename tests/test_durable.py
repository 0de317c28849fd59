"""Durable states: compare-and-set, resumable scans with drift, and the rebuild of an embedding space."""

import threading

import pytest
from pyspark.sql import functions as F

from factloom.sources.commits import CommitLog
from factloom.streaming import scan as S
from factloom.streaming.rebuild import SpaceIndex

RECORDS = "id long, version int, status string, subject string, content string"


def records(spark, rows):
    return spark.createDataFrame([(i, v, s, f"subject {i}", f"some content of {i} here") for i, v, s in rows], RECORDS)


def test_each_number_is_written_once(spark, tmp_path):
    a, b = (CommitLog(spark, f"{tmp_path}/log") for _ in "ab")
    assert a.latest() == (0, None) and a.commit(0, {"x": "é"}) and not b.commit(0, {"x": 2})
    assert b.latest() == (1, {"x": "é"}) and b.commit(1, {"x": 3}) and not a.commit(1, {}) and a.numbers() == [1, 2]
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if CommitLog(spark, f"{tmp_path}/log").commit(2, {"by": k}) else None) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) >= 1 and a.latest()[1]["by"] in won and a.numbers() == [1, 2, 3]


def test_digests_follow_changes(spark):
    before = [(i, 1, "active") for i in (1, 2, 9_999, 10_000, 25_000)] + [(3, 1, "pending")]
    after = [(1, 2, "active"), (2, 1, "active"), (3, 1, "active"), (9_999, 1, "active"), (10_000, 1, "deleted"), (30_001, 1, "active")]
    old, new = records(spark, before), records(spark, after)
    digests = S.range_digests(old)
    gone, come = records(spark, [x for x in before if x not in after]), records(spark, [x for x in after if x not in before])
    want = sorted(map(tuple, S.range_digests(new).collect()))
    assert sorted(map(tuple, S.change_digests(digests, gone, come).collect())) == want and [x[:2] for x in want] == [(0, 4), (3, 1)]
    assert S.boundary(new, S.range_digests(new))["max_memory_id"] == 30_001
    empty = records(spark, []).limit(0)
    assert S.boundary(empty, S.range_digests(empty)) == {"active_count": 0, "max_memory_id": 0, "digest": "0"}


def test_scan_in_pages_to_its_end(spark, tmp_path):
    now = records(spark, [(i, 1, "active" if i % 4 else "pending") for i in range(1, 12)])
    digests, log = S.range_digests(now), S.ScanLog(spark, f"{tmp_path}/scan")
    live = S.boundary(now, digests)
    assert log.require("d1", live) and not log.require("d1", live) and log.results() is None
    judge = lambda rows: rows.select("id", (F.col("id") * 10).alias("found"))
    states = [log.run_page(now, digests, "d1", judge, page=4) for _ in range(4)]
    assert [s["progress"]["next_after"] for s in states] == [5, 10, 11, 11] and [s["required"] for s in states] == [True, True, False, False]
    assert states[-1]["progress"] == {"pages": 3, "anchors_scanned": 9, "next_after": 11, "complete": True}
    assert sorted(r.id for r in log.results().collect()) == [1, 2, 3, 5, 6, 7, 9, 10, 11]


def test_scan_starts_anew_on_drift(spark, tmp_path):
    rows = {i: (i, 1, "active") for i in range(1, 8)}
    log = S.ScanLog(spark, f"{tmp_path}/scan")
    judge = lambda r: r.select("id", "version")

    def page(detector="d1"):
        now = records(spark, rows.values())
        return log.run_page(now, S.range_digests(now), detector, judge, page=3)

    now = records(spark, rows.values())
    log.require("d1", S.boundary(now, S.range_digests(now)))
    first = page()
    assert first["progress"]["next_after"] == 3
    rows[2] = (2, 2, "active")  # in a range that was passed
    second = page()
    assert second["epoch"] != first["epoch"] and second["progress"] == {"pages": 1, "anchors_scanned": 3, "next_after": 3, "complete": False}
    assert {(r.id, r.version) for r in log.results().collect()} == {(1, 1), (2, 2), (3, 1)}
    third = page("d2")  # another detector
    assert third["epoch"] != second["epoch"] and third["detector"] == "d2" and third["progress"]["pages"] == 1
    rows[4] = (4, 1, "deleted")  # ahead
    assert page("d2")["epoch"] != third["epoch"]
    ends = [page("d2") for _ in range(3)]
    assert ends[-1]["required"] is False and ends[-1]["progress"]["anchors_scanned"] == 6


def test_pages_that_do_not_count(spark, tmp_path):
    now = records(spark, [(i, 1, "active") for i in range(1, 7)])
    live, log, rival = S.boundary(now, S.range_digests(now)), *(S.ScanLog(spark, f"{tmp_path}/scan") for _ in "ab")
    assert not log.record_page("x", "d", live, 0, 3, 3)  # nothing is required
    log.require("d", live)
    e = log.state()["epoch"]
    bad = [("x", "d", live, 0, 3, 3), (e, "other", live, 0, 3, 3), (e, "d", {**live, "digest": "1"}, 0, 3, 3), (e, "d", live, 1, 3, 3), (e, "d", live, 0, 3, 0), (e, "d", live, 0, 0, 3), (e, "d", live, 0, None, 0), (e, "d", live, 0, 3, -1)]
    assert not any(log.record_page(*x) for x in bad) and not log.record_page(e, "d", live, 0, 3, 3, scoped=True)
    assert log.record_page(e, "d", live, 0, 3, 3) and not rival.record_page(e, "d", live, 0, 3, 3)  # one of two writers
    assert not log.complete(e, "d", live)
    assert rival.record_page(e, "d", live, 3, None, 3) and not log.record_page(e, "d", live, 6, None, 0)
    assert not log.complete(e, "d", {**live, "digest": "1"}) and not log.complete(e, "d2", live)
    assert log.complete(e, "d", live) and not rival.complete(e, "d", live) and log.state()["required"] is False
    assert log.require("d", live) and log.state()["epoch"] != e
    # progress that saw fewer than the live set never completes
    e = log.state()["epoch"]
    assert log.record_page(e, "d", live, 0, None, 5) and not log.complete(e, "d", live)


@pytest.fixture
def index(spark, tmp_path):
    return SpaceIndex(spark, f"{tmp_path}/index")


def encode(mark):
    return lambda units: units.withColumn("embedding", F.array(F.lit(float(mark)), F.length("text").cast("double")))


def spaces(index):
    return {(r.memory_id, r.memory_version, int(r.embedding[0])) for r in index.units().collect()}


def test_rebuild_in_batches_then_one_switch(spark, index):
    rows = records(spark, [(i, 1, "active") for i in range(1, 8)] + [(8, 1, "deleted")])
    blank = spark.createDataFrame([(9, 1, "active", " \t", "　\n"), (10, 1, "active", None, None)], RECORDS)
    rows = rows.unionByName(blank)
    assert index.state()["state"] == "unmanaged" and not index.publish(rows, encode(1), "a")
    assert index.start("a") and index.state()["state"] == "ready" and index.publish(rows.where("id < 8"), encode(1), "a")
    assert not index.pending(rows).count()  # records without units do not wait
    assert index.start("b") and not index.start("b") and index.state()["state"] == "mismatch"
    assert not index.publish(rows, encode(1), "a")  # the old space takes nothing any more
    old = spaces(index)
    assert index.step(rows, encode(2), "b", batch=3) and not index.complete(rows, "b")
    # a new process goes on where the stopped one was
    again = SpaceIndex(spark, index.path)
    assert sorted(r.id for r in again.pending(rows).collect()) == [4, 5, 6, 7] and spaces(again) == old
    newer = rows.where("id <> 2").unionByName(records(spark, [(2, 2, "active")]))
    assert sorted(r.id for r in again.pending(newer).collect()) == [2, 4, 5, 6, 7]  # a version that came meanwhile
    assert again.step(newer, encode(2), "b", batch=4) and not again.complete(newer, "b") and again.step(newer, encode(2), "b") and not again.step(newer, encode(2), "b")
    assert spaces(index) == old and not again.complete(newer, "c")
    assert again.complete(newer, "b") and not index.complete(newer, "b")
    assert spaces(index) == {(i, 2 if i == 2 else 1, 2) for i in range(1, 8)} and index.state()["space"] == "b"
    # of a memory that is published again only the last batch is seen
    assert index.publish(records(spark, [(3, 5, "active")]), encode(2), "b") and (3, 5, 2) in spaces(index) and (3, 1, 2) not in spaces(index)


def test_another_target_starts_anew_and_the_old_space_comes_back(spark, index):
    rows = records(spark, [(i, 1, "active") for i in range(1, 5)])
    index.start("a")
    index.publish(rows, encode(1), "a")
    index.start("b")
    index.step(rows, encode(2), "b", batch=2)
    epoch = index.state()["epoch"]
    assert index.start("c") and index.state()["epoch"] != epoch and index.pending(rows).count() == 4
    assert not index.step(rows, encode(2), "b") and not index.complete(rows, "b")
    index.step(rows, encode(3), "c", batch=2)
    assert index.start("a") and index.state()["rebuilt"] == [] and spaces(index) == {(i, 1, 1) for i in range(1, 5)} and not index.start("a")


def test_of_two_writers_one_publishes(spark, index):
    rows = records(spark, [(i, 1, "active") for i in range(1, 5)])
    index.start("a")
    index.publish(rows, encode(1), "a")
    index.start("b")
    rival = SpaceIndex(spark, index.path)

    def slow(units):
        assert rival.step(rows, encode(5), "b")
        return encode(2)(units)

    assert not index.step(rows, slow, "b") and index.complete(rows, "b")
    assert spaces(index) == {(i, 1, 5) for i in range(1, 5)}


def test_a_step_looks_for_what_is_pending_once(spark, index, monkeypatch):
    from factloom.streaming import rebuild as B

    seen = spark.sparkContext.accumulator(0)
    asked = F.udf(lambda s: seen.add(1) or s, "string").asNondeterministic()
    rows = records(spark, [(i, 1, "active") for i in range(1, 9)]).coalesce(1)
    index.start("a")
    monkeypatch.setattr(SpaceIndex, "pending", lambda self, r: B.pending(r.withColumn("status", asked("status")), self.units()))
    assert index.step(rows, encode(1), "a") and seen.value == 8
    blank = spark.createDataFrame([(1, "active", None, " 　\n"), (2, "active", "", "x"), (3, "active", None, None), (4, "deleted", "x", "x"), (5, "active", "　y", None)], "id long, status string, subject string, content string")
    assert sorted(r.id for r in B.indexable(blank).collect()) == [2, 5]
