"""Digest trees, side copies, moves of workspaces, redirects, backups and the queue of checks."""

import hashlib
import json
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from factloom.operators import compare as C
from factloom.operators import redirects as R
from factloom.sources import backup as B
from factloom.streaming.checks import STORE, check_results
from factloom.streaming.sidecopy import SideCopy

def line():
    return F.concat_ws("|", "version", "text")


def numbered(spark, n, change=None):
    rows = spark.range(n).select("id", (F.col("id") % 3).alias("version"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    return rows if change is None else rows.withColumn("text", change)


def test_one_row_of_a_million(spark):
    one = numbered(spark, 1_000_000)
    two = numbered(spark, 1_000_000, F.when(F.col("id") == 654_321, "other").otherwise(F.col("text")))
    a, b = C.tree(one, line()), C.tree(two, line())
    ranges, compared = C.differing(a, b)
    assert [r.range for r in ranges.collect()] == [654]
    assert [c.count() for c in compared] == [1, 10, 100]  # of 1,000 leaves
    assert [tuple(r) for r in C.changes(one, two, line(), ranges).collect()] == [(654_321, "changed")]
    assert C.differing(a, C.tree(one.repartition(7), line()))[0].isEmpty()


def test_changes_are_those_of_all_rows(spark):
    rng = random.Random(4)
    one = {i: "x" for i in rng.sample(range(-3_000, 9_000), 3_000)} | {1 << 60: "far"}
    two = {i: ("y" if rng.random() < 0.01 else t) for i, t in one.items() if rng.random() > 0.01} | {i: "new" for i in (20_001, -9_000)}
    df = lambda d: spark.createDataFrame([(i, 1, t) for i, t in d.items()], "id long, version int, text string")
    kw = {"leaf": 10, "fanout": 5, "levels": 4}
    ranges, _ = C.differing(C.tree(df(one), line(), **kw), C.tree(df(two), line(), **kw), 5)
    want = {(i, "missing") for i in one.keys() - two.keys()} | {(i, "extra") for i in two.keys() - one.keys()} | {(i, "changed") for i in one.keys() & two.keys() if one[i] != two[i]}
    assert {tuple(r) for r in C.changes(df(one), df(two), line(), ranges, 10).collect()} == want and len(want) > 40
    none = df({}).limit(0)
    ranges, _ = C.differing(C.tree(none, line()), C.tree(none, line()))
    assert C.changes(none, none, line(), ranges).isEmpty()


def test_side_copy(spark, tmp_path):
    first = numbered(spark, 5_000)
    copy = SideCopy(spark, str(tmp_path), line(), lambda rows: rows.withColumn("size", F.length("text")), leaf=100, fanout=10)
    assert copy.rows() is None and copy.sync(first) == -1 and not copy.switch(first)
    assert copy.start(first)
    now = numbered(spark, 5_300, F.when(F.col("id").isin(7, 4_444), "other").otherwise(F.col("text"))).where("id not between 1000 and 1099")
    assert not copy.switch(now) and copy.rows() is None
    assert copy.sync(now) == 6  # two changed ranges, one empty, three new
    assert copy.sync(now) == 0
    later = now.withColumn("text", F.when(F.col("id") == 8, "again").otherwise(F.col("text")))
    stopped = SideCopy(spark, str(tmp_path), line(), copy.build, leaf=100, fanout=10)  # another run goes on
    assert not stopped.switch(later) and stopped.sync(later) == 1 and stopped.switch(later)
    got = sorted(map(tuple, copy.rows().collect()))
    assert got == sorted((r.id, r.version, r.text, len(r.text)) for r in later.collect())
    assert not copy.switch(later)  # nothing beside it any more


def test_redirects_by_walking(spark):
    rng = random.Random(1)
    to = {f"n{i}": f"n{rng.randrange(0, i + 40)}" for i in range(300)} | {f"c{i}": f"c{i + 1}" for i in range(200)} | {"a": "b", "b": "a", "z": "z"}
    want = {}
    for name in to:
        at, hops = name, 0
        while at in to and to[at] != at and hops <= len(to):
            at, hops = to[at], hops + 1
        if to[name] != name:
            want[name] = (name, 0, True) if hops > len(to) else (at, hops, False)
    got = R.follow(spark.createDataFrame([*to.items(), (None, "x"), ("x", None)], "name string, target string"))
    assert {r.name: (r.target, r.hops, r.cyclic) for r in got.collect()} == want
    assert want["c0"] == ("c200", 200, False) and want["a"][2] and any(w[2] for n, w in want.items() if n[0] == "n")
    assert R.follow(spark.createDataFrame([], "name string, target string")).isEmpty()


def moved(spark, moves, registry, places, aliases=()):
    return R.fold_moves(
        spark.createDataFrame([(i, *m) for i, m in enumerate(moves, 100)], "seq long, old string, new string"), spark.createDataFrame([(n, i) for i, n in enumerate(registry)], "name string, id int"),
        spark.createDataFrame([(p,) for p in places], "ws string"), spark.createDataFrame(list(aliases), "alias string, canonical string, status string, updated_at long"))


def test_moves(spark):
    names = ["a", "b", "c", "d", "My Proj", "lone"]
    moves = [("a", "b"), ("b", "c"), ("c", "e"), (" a ", "d"), ("a", "e"), ("d", "default"), ("d", ""), ("d", "d"), ("my-proj", "q"), ("My Proj", "my proj"), ("ghost", "d"), (None, "x")]
    m = moved(spark, moves, names, ["a", "b", "d", "only records"], [("old a", "a", "confirmed", 1), ("bad", "b", "rejected", 2), ("Lone  one", "lone", "confirmed", 3), ("only", "d", "rejected", 4)])
    said = [r.outcome for r in m.outcomes.orderBy("seq").collect()]
    assert said == ["merged", "merged", "renamed", "competing_move", "unchanged", "reserved", "invalid_input", "unchanged", "competing_move", "renamed", "redirected", "invalid_input"]
    assert {(r.alias, r.canonical, r.status) for r in m.aliases.collect()} == {
        ("a", "e", "confirmed"), ("b", "e", "confirmed"), ("c", "e", "confirmed"), ("old a", "e", "confirmed"), ("bad", "e", "rejected"), ("lone one", "lone", "confirmed"), ("only", "d", "rejected"), ("ghost", "d", "confirmed")}
    registry = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, id int")
    assert {tuple(r) for r in m.registry(registry).collect()} == {("e", 2), ("d", 3), ("my proj", 4), ("lone", 5)}
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "d"), (4, "only records"), (5, None), (6, "a")], "id int, ws string")
    assert {tuple(r) for r in m.records(rows).collect()} == {(1, "e"), (2, "e"), (3, "d"), (4, "only records"), (5, None), (6, "e")}


def test_a_move_back_closes_no_cycle(spark):
    m = moved(spark, [("a", "b"), ("b", "a"), ("x", "y")], ["a", "z"], ["a", "x"], [("x", "y", "rejected", 1)])
    assert [r.outcome for r in m.outcomes.orderBy("seq").collect()] == ["renamed", "renamed", "redirected"]
    assert {(r.alias, r.canonical, r.status) for r in m.aliases.collect()} == {("b", "a", "confirmed"), ("x", "y", "rejected")}
    assert not R.follow(m.aliases.where("status = 'confirmed'").select(F.col("alias").alias("name"), F.col("canonical").alias("target"))).where("cyclic").count()
    none = moved(spark, [], ["a"], ["a"])
    assert none.outcomes.isEmpty() and none.aliases.isEmpty() and none.registry(spark.createDataFrame([("a", 1)], "name string, id int")).count() == 1


def envelope(key, content="some text", **more):
    return json.dumps({"backup_schema": 1, "replay_key": key, "backup_written_at": "2024-05-01T10:00:00Z", "workspace_canonical": "w", "record": {"content": content, "b": 1.50, "a": "é"}} | more, ensure_ascii=False).encode()


def test_backup_lines(spark, tmp_path):
    without = lambda key, gone: json.dumps({k: v for k, v in json.loads(envelope(key)).items() if k != gone}).encode()
    cases = [
        (envelope("k1"), None), (b"", "invalid_json"), (b"[1]", "not_an_object"), (b"null", "not_an_object"), (without("k", "backup_schema"), "no_schema"), (envelope("k", backup_schema=True), "unsupported_schema"),
        (envelope("k", backup_schema=2), "unsupported_schema"), (envelope(" "), "invalid_replay_key"), (envelope("x" * 201), "invalid_replay_key"), (envelope(7), "invalid_replay_key"),
        (envelope("k", backup_written_at="soon"), "invalid_written_at"), (envelope("k2", record=[]), "record_not_an_object"), (envelope("k2"), "duplicate_in_page"), (envelope("k3", " "), "invalid_record"),
        (envelope("k4", workspace_canonical=""), "invalid_workspace"), (b'{"a": "\xff"}', "invalid_utf8"), (envelope("k5", "y" * 5_000), "too_long"), (envelope("k1", "other"), "duplicate_in_page"), (envelope("k6") + b"\r", None), (envelope("k7"), None),
    ]
    (tmp_path / "log").mkdir()
    data = b"\n".join(c for c, _ in cases)
    (tmp_path / "log" / "a.jsonl").write_bytes(data + b"\n")
    (tmp_path / "log" / "b.jsonl").write_bytes(envelope("k1") + b"\n" + envelope("k7", "changed"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    none = spark.createDataFrame([], "replay_key string, payload_hash string")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")  # lines cross splits
        lines = B.read_lines(spark, f"{tmp_path}/log", most_bytes=3_000)
        found = B.inspect(lines, none, page=20).orderBy("line").collect()
        assert [r.line for r in found] == list(range(1, 23)) and [r.page for r in found] == [0] * 20 + [1] * 2
        assert [r.reason for r in found[:20]] == [why for _, why in cases]
        for r, (raw, _) in zip(found, cases):
            assert data[r.offset : r.offset + r.bytes] == raw
        assert found[0].payload_hash == hashlib.sha256('{"backup_schema":1,"record":{"a":"é","b":1.5,"content":"some text"},"workspace_canonical":"w"}'.encode()).hexdigest()
        known = spark.createDataFrame([("k6", found[18].payload_hash)], "replay_key string, payload_hash string")
        records, outcomes = B.replay(lines, B.inspect(lines, known, page=20), 50)
        assert [(r.id, r.replay_key) for r in records.orderBy("id").collect()] == [(50, "k1"), (51, "k7")]
        assert {(r.line, r.outcome) for r in outcomes.collect()} == {(1, "imported"), (19, "already_replayed"), (20, "imported"), (21, "already_replayed"), (22, "receipt_hash_conflict")}
        receipts = known.unionByName(records.select("replay_key", "payload_hash"))
        again, outcomes = B.replay(lines, B.inspect(lines, receipts, page=20), 52)
        assert again.isEmpty() and outcomes.where("outcome = 'imported'").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_queue_of_checks(spark, tmp_path):
    """Micro-batches of one file each."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = "queue string, seq long, action string, memory_id long, version long"
    batches = [
        [("q", i, "enqueue", i, 1) for i in range(101)] + [("other", 1, "enqueue", 1, 1)],
        [("q", 200, "take", None, None), ("q", 201, "enqueue", 100, 1), ("q", 202, "enqueue", 5, 2), ("q", 203, "enqueue", 5, 2), ("q", 204, "enqueue", 0, 1), ("q", 205, "pause", None, None), ("q", 206, "take", None, None), ("q", 207, "enqueue", 300, 1)],
        [("q", 300, "resume", None, None), ("q", 301, "take", None, None), ("q", 302, "disable", None, None), ("q", 303, "enqueue", 400, 1), ("q", 304, "enable", None, None), ("q", 305, "enqueue", 401, 1), ("q", 306, "shutdown", None, None), ("q", 307, "enable", None, None), ("q", 308, "enqueue", 402, 1)],
    ]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    import glob
    import os
    import shutil

    (tmp_path / "in").mkdir()
    for i in range(3):
        for f in glob.glob(f"{tmp_path}/in{i}/*.parquet"):
            shutil.copy(f, f"{tmp_path}/in/{i}.parquet")
            os.utime(f"{tmp_path}/in/{i}.parquet", (1_700_000_000 + i,) * 2)
    rows = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = check_results(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: rows.extend((n, *r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    of = lambda n: {(r[2], r[3], r[4]) for r in rows if r[0] == n and r[1] == "q"}
    assert of(0) == {("semantic:100@1", "incomplete", "queue_full")} and {r[5:] for r in rows if r[0] == 0 and r[1] == "q"} == {(100, 0, 1)}
    assert of(1) == {("semantic:0@1", "checked", None), ("semantic:5@1", "incomplete", "coalesced_by_newer_snapshot"), ("semantic:300@1", "incomplete", "paused")}
    last = of(2)
    assert ("semantic:1@1", "checked", None) in last and ("semantic:5@2", "incomplete", "runtime_disabled") in last and ("semantic:400@1", "incomplete", "runtime_disabled") in last
    assert ("semantic:401@1", "incomplete", "shutdown") in last and ("semantic:402@1", "incomplete", "shutdown") in last
    tasks = [r[2] for r in rows if r[1] == "q"]
    assert len(tasks) == len(set(tasks)) and {r[5:] for r in rows if r[0] == 2} == {(0, 2, 1)}


def test_waiting_too_long(spark, tmp_path):
    """A task that no one takes ends by its timer, in a later micro-batch; one that is taken doesn't."""
    import os

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = "queue string, seq long, action string, memory_id long, version long"
    for i, b in enumerate([[("q", 1, "enqueue", 1, 1), ("q", 2, "enqueue", 2, 1), ("q", 3, "take", None, None)], [("other", 1, "enqueue", 9, 1)]]):
        columns = [pa.array(c, k) for c, k in zip(zip(*b), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
        pq.write_table(pa.table(columns, names=["queue", "seq", "action", "memory_id", "version"]), f"{tmp_path}/{i}.parquet")
        os.utime(f"{tmp_path}/{i}.parquet", (1_700_000_000 + i,) * 2)
    rows = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*.parquet")
    q = check_results(stream, most_wait_ms=1).writeStream.outputMode("update").foreachBatch(lambda df, n: rows.extend((n, *r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        end = time.monotonic() + 60  # timers keep such a stream going, so it is stopped
        while time.monotonic() < end and q.exception() is None and not any(r[4] == "timed_out" for r in rows):
            time.sleep(0.5)
    finally:
        q.stop()
    told = [(r[1], r[2], r[3], r[4]) for r in rows if r[2]]
    assert ("q", "semantic:1@1", "checked", None) in told and ("q", "semantic:2@1", "incomplete", "timed_out") in told
    assert len({t[1] for t in told}) == len(told)
