"""Closing of notices, and notices at write time behind the gate of both directions."""

from pyspark.sql import functions as F

from factloom.operators.notices import close_notices
from factloom.streaming.index import notices_for


def test_close(spark):
    records = spark.createDataFrame([(1, 1, "active", "a"), (2, 2, "active", "a"), (3, 1, "deleted", "a"), (4, 1, "active", "b")], "id long, version int, status string, ws string")
    rows = [(10, "a", "pending", [(1, 1), (2, 2)]), (11, "a", "delivered", [(1, 1), (2, 1)]), (12, "a", "pending", [(3, 1)]), (13, "a", "dismissed", [(1, 1)]), (14, "a", "pending", [(1, 1), (4, 1)]), (15, "b", "pending", [(4, 1)]), (16, "a", "pending", [(2, 2)])]
    notices = spark.createDataFrame([(i, w, "candidate", d, 1, m) for i, w, d, m in rows], "notice_id long, ws string, status string, delivery string, revision int, members array<struct<memory_id: long, version: int>>")
    asked = [(5, 10, "dismissed"), (3, 10, "open"), (4, 10, "Resolved"), (6, 11, "resolved"), (7, 11, "resolved"), (8, 12, "dismissed"), (9, 13, "resolved"), (10, 14, "resolved"), (11, 15, "dismissed"), (12, 99, "dismissed"), (13, 16, None), (14, None, "resolved")]
    requests = spark.createDataFrame([(s, n, x, f"why {s}") for s, n, x in asked], "seq long, notice_id long, status string, reason string")
    out, now = close_notices(notices, requests, records, ["a"])
    assert {r.seq: (r.outcome, r.delivery) for r in out.collect()} == {
        3: ("invalid_status", None), 4: ("updated", "resolved"), 5: ("already_terminal", "resolved"), 6: ("stale_snapshot", "stale"), 7: ("already_terminal", "stale"), 8: ("stale_snapshot", "stale"),
        9: ("already_terminal", "dismissed"), 10: ("not_found", None), 11: ("not_found", None), 12: ("not_found", None), 13: ("invalid_status", None), 14: ("not_found", None)}
    after = {r.notice_id: (r.status, r.delivery, r.revision, r.reason) for r in now.collect()}
    assert after[10] == ("candidate", "resolved", 2, "why 4") and after[11] == ("candidate", "stale", 1, None)
    assert after[14] == ("candidate", "stale", 1, None)  # out of scope, yet its member is in another workspace now
    assert after[15] == ("candidate", "pending", 1, None) and after[16] == ("candidate", "pending", 1, None) and len(after) == 7
    out, now = close_notices(notices, requests, records)
    assert {r.seq: r.outcome for r in out.collect()}[11] == "updated" and {r.notice_id: r.status for r in now.collect()}[15] == "not_a_conflict"
    assert close_notices(notices.limit(0), requests.limit(0), records)[0].isEmpty()


def test_both_directions_are_needed(spark):
    schema = "unit_id long, memory_id long, unit_index int, text string, embedding array<double>"
    published = spark.createDataFrame([(1, 1, 0, "The default timeout is 30 seconds.", [1.0, 0.0]), (2, 2, 0, "The default timeout is 45 seconds.", [0.9, 0.1])], schema)
    batch = spark.createDataFrame([(9, 9, 0, "The default timeout is 60 seconds.", [1.0, 0.01])], schema)
    loose = {r.peer for r in notices_for(batch, published).collect()}

    def extract(pairs, both=True):
        number = lambda c: F.regexp_extract(c, r"\d+", 0)
        of = lambda a, b: F.struct(F.lit("timeout").alias("attribute_a"), number(a).alias("value_a"), F.lit("timeout").alias("attribute_b"), number(b).alias("value_b"))
        forward, reverse = of("quote_a", "quote_b"), of("quote_b", "quote_a")
        return pairs.withColumn("forward", forward).withColumn("reverse", reverse if both else F.when(F.col("unit_id") == 1, reverse))

    every = notices_for(batch, published, extract=extract).collect()
    assert loose and {r.peer for r in every} == loose and {r.reason for r in every} == {"same_attribute_different_grounded_value"}
    assert {r.peer for r in notices_for(batch, published, extract=lambda p: extract(p, False)).collect()} == loose & {1}
