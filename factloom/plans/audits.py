"""Queries: audit, coverage, health, digests, governance checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import aggregates as A
from factloom.plans.registry import query
from factloom.sources.views import CONFLICTS_SQL, MEMORIES_SQL, UNITS_SQL, conflicts, memories, table, units

M = "WITH " + MEMORIES_SQL


@query("audit_summary", f"""{M}, {CONFLICTS_SQL},
k AS (SELECT ws, source_type, count(*) AS n, min(event_time) AS oldest, max(event_time) AS newest FROM m WHERE status <> 'deleted' GROUP BY ALL),
s AS (SELECT ws, CAST(sum(n) AS BIGINT) AS memories, min(oldest) AS oldest, max(newest) AS newest, string_agg(source_type || '=' || n, ',' ORDER BY source_type || '=' || n) AS by_source FROM k GROUP BY ws),
o AS (SELECT ws, count(*) AS open_conflicts FROM c WHERE status IN ('open', 'applying') GROUP BY ws)
SELECT ws, coalesce(memories, 0) AS memories, oldest, newest, coalesce(by_source, '') AS by_source, coalesce(open_conflicts, 0) AS open_conflicts FROM s FULL JOIN o USING (ws)""")
def audit_summary(spark, sf):
    return A.audit_summary(memories(spark, sf), conflicts(spark, sf))


@query("status_counts", f"{M} SELECT ws, count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status IN ('superseded', 'conflicted', 'pending')) AS expired, count(*) FILTER (status = 'deleted') AS deleted FROM m GROUP BY ws")
def status_counts(spark, sf):
    s = F.col("status")
    return memories(spark, sf).groupBy("ws").agg(F.count("*").alias("total"), F.count_if(s == "active").alias("active"), F.count_if(s.isin("superseded", "conflicted", "pending")).alias("expired"), F.count_if(s == "deleted").alias("deleted"))


@query("tag_df", f"{M} SELECT tag, count(DISTINCT id) AS df FROM (SELECT id, unnest(tags) AS tag FROM m WHERE status = 'active') GROUP BY tag")
def tag_df(spark, sf):
    return A.tag_frequency(memories(spark, sf).where("status = 'active'"))


@query("entity_counts", f"{M} SELECT ws AS entity, count(*) AS memories, min(id) AS sample_id, count(*) FILTER (workspace_canonical IS NULL) AS unassigned FROM m WHERE status = 'active' GROUP BY ws")
def entity_counts(spark, sf):
    return memories(spark, sf).where("status = 'active'").groupBy(F.col("ws").alias("entity")).agg(F.count("*").alias("memories"), F.min("id").alias("sample_id"), F.count_if(F.col("workspace_canonical").isNull()).alias("unassigned"))


@query("coverage", rf"""{M}, {UNITS_SQL}, a AS (SELECT id, version, regexp_matches(subject, '\S') OR regexp_matches(content, '\S') AS eligible FROM m WHERE status = 'active'),
n AS (SELECT memory_id AS id, memory_version AS version, count(*) AS units FROM u GROUP BY ALL)
SELECT count(*) AS total, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND units IS NOT NULL) AS indexed, count(*) FILTER (NOT eligible) AS not_indexable, CAST(coalesce(sum(units), 0) AS BIGINT) AS units FROM a LEFT JOIN n USING (id, version)""")
def coverage(spark, sf):
    return A.coverage(memories(spark, sf), units(spark, sf))


@query("stale_units", f"{M}, {UNITS_SQL} SELECT unit_id, memory_id, memory_version, version AS live_version FROM u JOIN m ON memory_id = id WHERE memory_version <> version")
def stale_units(spark, sf):
    return A.stale_units(memories(spark, sf), units(spark, sf))


@query("orphan_units", f"{M}, {UNITS_SQL} SELECT unit_id, memory_id FROM u WHERE NOT EXISTS (SELECT 1 FROM m WHERE id = memory_id AND status <> 'deleted')")
def orphan_units(spark, sf):
    return A.orphan_units(memories(spark, sf), units(spark, sf))


_DIGESTS = """o AS (SELECT g, id // 10000 AS part, count(*) AS n, max(id) AS max_id, sha256(string_agg(line, chr(10) ORDER BY id)) AS line FROM l GROUP BY ALL),
w AS (SELECT g, part // 10000 AS top, sum(n) AS n, max(max_id) AS max_id, sha256(string_agg(line, chr(10) ORDER BY part)) AS line FROM o GROUP BY ALL),
d AS (SELECT g, CAST(sum(n) AS BIGINT) AS n, max(max_id) AS max_id, sha256(string_agg(line, chr(10) ORDER BY top)) AS digest FROM w GROUP BY g)"""


@query("active_digest", f"{M}, l AS (SELECT 0 AS g, id, id || '@' || version AS line FROM m WHERE status = 'active'), {_DIGESTS} SELECT n AS active, max_id, digest FROM d")
def active_digest(spark, sf):
    return A.active_digest(memories(spark, sf))


@query("table_fingerprint", f"{M}, l AS (SELECT ws AS g, id, id || '|' || version || '|' || sha256(content) AS line FROM m), {_DIGESTS} SELECT g AS ws, n AS rows, digest AS fingerprint FROM d")
def table_fingerprint(spark, sf):
    line = F.concat_ws("|", F.col("id").cast("string"), F.col("version").cast("string"), F.sha2(F.col("content").cast("binary"), 256))
    return A.digests(memories(spark, sf).select("ws", "id", line.alias("line")), "ws").select("ws", F.col("n").alias("rows"), F.col("digest").alias("fingerprint"))


@query("notice_counts", f"WITH {CONFLICTS_SQL} SELECT CASE WHEN status IN ('open', 'applying') THEN 'open' ELSE status END AS state, severity, count(*) AS n FROM c GROUP BY ALL")
def notice_counts(spark, sf):
    state = F.when(F.col("status").isin("open", "applying"), "open").otherwise(F.col("status"))
    return conflicts(spark, sf).groupBy(state.alias("state"), "severity").agg(F.count("*").alias("n"))


@query("notice_claim", f"WITH {CONFLICTS_SQL} SELECT conflict_id, severity, created_at FROM c WHERE status = 'open' ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'warning' THEN 2 WHEN 'normal' THEN 3 ELSE 4 END, created_at, conflict_id LIMIT 25")
def notice_claim(spark, sf):
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("critical", "high", "warning", "normal"))), F.col("severity")), F.lit(0))
    return conflicts(spark, sf).where("status = 'open'").orderBy(F.when(rank == 0, 9).otherwise(rank), "created_at", "conflict_id").limit(25).select("conflict_id", "severity", "created_at")


@query("dismissed_pairs", f"WITH {CONFLICTS_SQL} SELECT DISTINCT list_sort(members)[1] AS a, list_sort(members)[2] AS b FROM c WHERE status = 'not_a_conflict' AND len(members) = 2")
def dismissed_pairs(spark, sf):
    pair = F.array_sort(F.array_distinct("members"))
    return conflicts(spark, sf).where("status = 'not_a_conflict'").select(pair.alias("p")).where(F.size("p") == 2).select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b")).distinct()


@query("slot_groups", f"""{M}, {CONFLICTS_SQL}, x AS (SELECT slot_key AS slot, unnest(members) AS member FROM c), y AS (SELECT slot, member, length(content) % 7 AS value FROM x JOIN m ON m.id = member UNION ALL SELECT slot, member, member % 2 AS value FROM x),
b AS (SELECT slot, member, count(DISTINCT value) AS v FROM y GROUP BY ALL)
SELECT slot, count(*) AS members, (SELECT count(DISTINCT value) FROM y WHERE y.slot = b.slot) AS values, bool_or(v > 1) AS value_conflict FROM b GROUP BY slot""")
def slot_groups(spark, sf):
    x = conflicts(spark, sf).select(F.col("slot_key").alias("slot"), F.explode("members").alias("member"))
    own = memories(spark, sf).select(F.col("id").alias("member"), (F.length("content") % 7).cast("long").alias("value"))
    return A.slot_groups(x.join(own, "member").select("slot", "member", "value").unionByName(x.select("slot", "member", (F.col("member") % 2).alias("value"))))


@query("conflict_visibility", f"{M}, {CONFLICTS_SQL} SELECT conflict_id, bool_and(coalesce(m.ws IN ('src0', 'src1', 'src2') AND m.status <> 'deleted', false)) AS all_visible, count(m.id) AS live_members FROM (SELECT conflict_id, unnest(members) AS member FROM c) LEFT JOIN m ON m.id = member GROUP BY conflict_id")
def conflict_visibility(spark, sf):
    rows = conflicts(spark, sf).select("conflict_id", F.explode("members").alias("id")).join(memories(spark, sf).select("id", "ws", "status"), "id", "left")
    seen = F.coalesce(F.col("ws").isin("src0", "src1", "src2") & (F.col("status") != "deleted"), F.lit(False))
    return rows.groupBy("conflict_id").agg(F.bool_and(seen).alias("all_visible"), F.count("ws").alias("live_members"))


@query("conflicts_of_memories", f"WITH {CONFLICTS_SQL}, x AS (SELECT conflict_id, status, unnest(members) AS member FROM c) SELECT DISTINCT conflict_id, status FROM x WHERE status IN ('open', 'applying') AND member IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def conflicts_of_memories(spark, sf):
    wanted = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("member"))
    return conflicts(spark, sf).where(F.col("status").isin("open", "applying")).select("conflict_id", "status", F.explode("members").alias("member")).join(wanted, "member", "left_semi").select("conflict_id", "status").distinct()


@query("doctor", f"""{M}, {UNITS_SQL},
s AS (SELECT count(*) AS n FROM u JOIN m ON memory_id = id WHERE memory_version <> version),
o AS (SELECT count(*) AS n FROM u WHERE NOT EXISTS (SELECT 1 FROM m WHERE id = memory_id AND status <> 'deleted')),
b AS (SELECT count(*) AS n FROM m WHERE status = 'pending'),
w AS (SELECT count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY)
SELECT 'attention' AS finding, n, CASE WHEN n >= 200 THEN 'warning' ELSE 'ok' END AS level FROM w
UNION ALL SELECT 'backlog', n, CASE WHEN n >= 100 THEN 'warning' ELSE 'ok' END FROM b
UNION ALL SELECT 'orphans', n, CASE WHEN n > 0 THEN 'error' ELSE 'ok' END FROM o
UNION ALL SELECT 'stale', n, CASE WHEN n > 0 THEN 'warning' ELSE 'ok' END FROM s""")
def doctor(spark, sf):
    m, u, e = memories(spark, sf), units(spark, sf), table(spark, sf, "events")
    last = F.broadcast(e.agg(F.max("ts").alias("last")))
    n = F.count("*").alias("n")
    checks = [
        ("attention", e.join(last).where("ts >= last - interval 7 days").agg(n), 200, "warning"),
        ("backlog", m.where("status = 'pending'").agg(n), 100, "warning"),
        ("orphans", A.orphan_units(m, u).agg(n), 1, "error"),
        ("stale", A.stale_units(m, u).agg(n), 1, "warning"),
    ]
    out = None
    for name, count, limit, level in checks:
        row = count.select(F.lit(name).alias("finding"), "n", F.when(F.col("n") >= limit, level).otherwise("ok").alias("level"))
        out = row if out is None else out.unionByName(row)
    return out


@query("attention_7d", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(ts) AS last_ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type")
def attention_7d(spark, sf):
    e = table(spark, sf, "events")
    last = F.broadcast(e.agg(F.max("ts").alias("last")))
    return e.join(last).where("ts >= last - interval 7 days").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.max("ts").alias("last_ts"))


@query("attention_daily", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def attention_daily(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 day").start.cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"))


_REPLAY = """l AS (SELECT event_id AS line_no, user_id || '/' || event_type AS replay_key, value > 1 AS valid, row_number() OVER (PARTITION BY user_id || '/' || event_type ORDER BY event_id) AS turn FROM events),
k AS (SELECT DISTINCT user_id || '/' || event_type AS replay_key FROM events WHERE event_id % 97 = 0),
r AS (SELECT line_no, replay_key, CASE WHEN NOT valid THEN 'invalid' WHEN k.replay_key IS NOT NULL THEN 'replayed' WHEN turn > 1 THEN 'duplicate' ELSE 'eligible' END AS outcome FROM l LEFT JOIN k USING (replay_key))"""


@query("backup_replay", f"WITH {_REPLAY} SELECT outcome, count(*) AS n, min(line_no) AS first_line FROM r GROUP BY outcome")
def backup_replay(spark, sf):
    e = table(spark, sf, "events")
    key = F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("replay_key")
    lines = e.select(F.col("event_id").alias("line_no"), key, (F.col("value") > 1).alias("valid"))
    known = e.where("event_id % 97 = 0").select(key).distinct()
    return A.replay_page(lines, known).groupBy("outcome").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


@query("constraint_checks", f"""{M}, {CONFLICTS_SQL}, {UNITS_SQL}
SELECT 'active_slot' AS rule, count(*) AS violations FROM (SELECT ws, slot_key FROM c WHERE status IN ('open', 'applying') GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'unit_position', count(*) FROM (SELECT memory_id, unit_index FROM u GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'memory_id', count(*) FROM (SELECT id FROM m GROUP BY id HAVING count(*) > 1)""")
def constraint_checks(spark, sf):
    repeated = lambda df, *by: df.groupBy(*by).count().where("count > 1").agg(F.count("*").alias("violations"))
    checks = {
        "active_slot": repeated(conflicts(spark, sf).where("status in ('open', 'applying')"), "ws", "slot_key"),
        "unit_position": repeated(units(spark, sf), "memory_id", "unit_index"),
        "memory_id": repeated(memories(spark, sf), "id"),
    }
    out = None
    for name, df in checks.items():
        df = df.select(F.lit(name).alias("rule"), "violations")
        out = df if out is None else out.unionByName(df)
    return out


@query("conflict_signals", f"""{M}, {CONFLICTS_SQL}, x AS (SELECT unnest(members) AS id, conflict_id, status, created_at FROM c WHERE status IN ('open', 'applying')),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE status WHEN 'applying' THEN 0 ELSE 1 END, created_at DESC, conflict_id DESC) AS k, count(*) OVER (PARTITION BY id) AS n FROM x)
SELECT m.id, r.conflict_id, r.status AS conflict_status, n AS conflicts FROM m JOIN r ON m.id = r.id AND k = 1 WHERE m.status = 'active'""")
def conflict_signals(spark, sf):
    x = conflicts(spark, sf).where("status in ('open', 'applying')").select(F.explode("members").alias("id"), "conflict_id", "status", "created_at")
    best = x.groupBy("id").agg(F.max(F.struct((F.col("status") == "applying").alias("first"), "created_at", "conflict_id", "status")).alias("b"), F.count("*").alias("conflicts"))
    live = memories(spark, sf).where("status = 'active'").select("id")
    return live.join(best, "id").select("id", "b.conflict_id", F.col("b.status").alias("conflict_status"), "conflicts")


@query("alias_decisions", """WITH d AS (SELECT o_custkey AS alias, o_orderpriority AS canonical, CASE o_orderstatus WHEN 'F' THEN 'confirmed' ELSE 'rejected' END AS status, o_orderdate AS updated_at, o_orderkey FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY CASE status WHEN 'confirmed' THEN 0 ELSE 1 END, updated_at DESC, canonical, o_orderkey) AS k, count(*) FILTER (status = 'rejected') OVER (PARTITION BY alias) AS rejected FROM d)
SELECT alias, canonical, status, rejected FROM r WHERE k = 1""")
def alias_decisions(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("alias"), F.col("o_orderpriority").alias("canonical"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("rejected").alias("status"), F.col("o_orderdate").alias("updated_at"), "o_orderkey")
    by = Window.partitionBy("alias")
    first = F.row_number().over(by.orderBy(F.col("status") != "confirmed", F.desc("updated_at"), "canonical", "o_orderkey"))
    return d.withColumn("k", first).withColumn("rejected", F.count_if(F.col("status") == "rejected").over(by)).where("k = 1").select("alias", "canonical", "status", "rejected")
