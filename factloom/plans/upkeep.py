"""Queries: differences of tables, a copy built beside the live table, moves of workspaces, chains of redirects, backups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.operators import compare as C
from factloom.operators import confirm as P
from factloom.operators import notices as N
from factloom.operators import redirects as R
from factloom.plans.registry import query
from factloom.sources import backup as B
from factloom.sources.commits import shared_folder, written
from factloom.sources.reviewed import ReviewedRegistry
from factloom.sources.views import CONFLICTS_SQL, MEMORIES_SQL, conflicts, memories, table
from factloom.streaming.sidecopy import SideCopy

M = "WITH " + MEMORIES_SQL


def _narrow(spark, sf):
    # contents are hashed apart from the records, so that no text takes part in a join
    hashes = table(spark, sf, "documents").select((F.col("doc_id") + 1).alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return memories(spark, sf).select("id", "version", "status", "ws").join(hashes, "id")


def _line():
    return F.concat_ws("|", F.col("version").cast("string"), "status", "ws", "content_hash")


def _older(rows):
    """The table as a copy of it still has it: some rows of an older version, some not there yet, some that are gone now."""
    i = F.col("id")
    stay = rows.where(i % 211 != 5).withColumn("version", F.when(i % 97 == 3, F.col("version") - 1).otherwise(F.col("version")).cast("int"))
    return stay.unionByName(rows.where(i % 307 == 9).withColumn("id", i + 1_000_000_000))


@query("table_drift", f"""{M} SELECT id, 'missing' AS kind FROM m WHERE id % 211 = 5 UNION ALL SELECT id, 'changed' FROM m WHERE id % 97 = 3 AND id % 211 <> 5
UNION ALL SELECT id + 1000000000, 'extra' FROM m WHERE id % 307 = 9""")
def table_drift(spark, sf):
    """Where an older copy differs from the live table."""
    live = written(_narrow(spark, sf).repartitionByRange("id").sortWithinPartitions("id"), "live")
    copy = written(_older(live).repartitionByRange("id").sortWithinPartitions("id"), "copy")
    ranges, _ = C.differing(C.tree(live, _line()), C.tree(copy, _line()))
    return C.changes(live, copy, _line(), ranges)


@query("side_by_side", f"""{M} SELECT id, version, status, ws, sha256(content) AS content_hash, status = 'active' AS listed FROM m""")
def side_by_side(spark, sf):
    """What readers see of a copy built from an older table, after one synchronisation and the switch."""
    live = written(_narrow(spark, sf).repartitionByRange("id").sortWithinPartitions("id"), "live")
    copy = SideCopy(spark, f"{shared_folder(spark)}/copy-{uuid.uuid4().hex}", _line(), lambda rows: rows.withColumn("listed", F.col("status") == "active"))
    copy.start(_older(live))
    copy.sync(live)
    copy.switch(live)
    return copy.rows()


_TO = "CASE WHEN doc_id % 101 = 5 THEN doc_id + 1 WHEN doc_id % 101 = 6 THEN doc_id - 1 ELSE doc_id // 2 END"


@query("redirect_chains", f"""WITH RECURSIVE r AS (SELECT 'w' || doc_id AS name, 'w' || ({_TO}) AS target FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 101 IN (5, 6)),
w AS (SELECT name, target AS place, 1::BIGINT AS hops FROM r UNION ALL SELECT w.name, r.target, hops + 1 FROM w JOIN r ON r.name = w.place WHERE hops < 50)
SELECT name, CASE WHEN max(hops) = 50 THEN name ELSE max_by(place, hops) END AS target, CASE WHEN max(hops) = 50 THEN 0 ELSE max(hops) END AS hops, max(hops) = 50 AS cyclic FROM w GROUP BY name""")
def redirect_chains(spark, sf):
    """Redirects of names to that of half their number; some form a cycle of two."""
    k = F.col("doc_id")
    to = F.when(k % 101 == 5, k + 1).when(k % 101 == 6, k - 1).otherwise(F.expr("doc_id div 2"))
    name = lambda x: F.concat(F.lit("w"), x.cast("string"))
    return R.follow(table(spark, sf, "documents").where((k % 3 != 0) | (k % 101).isin(5, 6)).select(name(k).alias("name"), name(to).alias("target")))


@query("workspace_moves", f"""{M}, s AS (SELECT DISTINCT ws FROM m), t AS (SELECT id, CASE WHEN ws IN ('src1', 'src2', 'src3', 'src4') THEN 'src1' WHEN ws = 'src5' THEN 'Team Five' ELSE ws END AS ws FROM m)
SELECT ws, count(*) AS n, max(id) AS last FROM t GROUP BY ws""")
def workspace_moves(spark, sf):
    """Records by workspace after a chain of three moves, one back to its first name, a renaming, and some that are refused."""
    m = written(memories(spark, sf).select("id", "ws"), "places")
    names = m.select("ws").distinct()
    moves = [("src1", "src2"), ("src2", "src3"), ("src3", "src4"), ("src2", "src6"), ("src4", "src1"), ("src5", "Team Five"), ("src5", "src7"), ("src6", "default"), ("none", "src6")]
    given = spark.createDataFrame([(i, *x) for i, x in enumerate(moves)], "seq long, old string, new string")
    none = spark.createDataFrame([], "alias string, canonical string, status string, updated_at long")
    moved = R.fold_moves(given, names.select(F.col("ws").alias("name")), names, none)
    return moved.records(m).groupBy("ws").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query("backup_import", """WITH l AS (SELECT 'k' || doc_id AS replay_key, source AS workspace_canonical, sha256('{"backup_schema":1,"record":{"content":' || CAST(to_json(text) AS VARCHAR) || '},"workspace_canonical":' || CAST(to_json(source) AS VARCHAR) || '}') AS payload_hash
 FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND doc_id % 41 <> 3 AND doc_id % 43 <> 4 AND doc_id % 97 > 1) SELECT * FROM l""")
def backup_import(spark, sf):
    """A backup of all documents, with lines that are repeated, broken or of another format, some of them replayed before: what a replay adds."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    path = f"{shared_folder(spark)}/backup-{uuid.uuid4().hex}"
    twice = d.withColumn("_", F.explode(F.when(k % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    record = F.struct(F.col("text").alias("content"))
    B.append(twice.where((k % 41 != 3) & (k % 43 != 4)).select(F.concat(F.lit("k"), k.cast("string")).alias("replay_key"), F.lit("2024-05-01T10:00:00Z").alias("backup_written_at"), F.col("source").alias("workspace_canonical"), record.alias("record")), path)
    broken = F.when(k % 41 == 3, F.concat(F.lit('{"backup_schema": 1, "replay_key": "k'), k.cast("string"))).otherwise(F.concat(F.lit('{"backup_schema": 2, "replay_key": "k'), k.cast("string"), F.lit('"}')))
    d.where((k % 41 == 3) | (k % 43 == 4)).select(broken.alias("value")).write.mode("append").text(path)
    lines = B.read_lines(spark, path)
    none = spark.createDataFrame([], "replay_key string, payload_hash string")
    first = B.inspect(lines, none)
    # of the receipts some are of other contents
    number = F.substr("replay_key", F.lit(2)).cast("long")
    receipts = first.where((number % 97 <= 1) & (F.col("status") == "importable")).select("replay_key", F.when(number % 97 == 0, F.col("payload_hash")).otherwise("other").alias("payload_hash")).distinct()
    records, _ = B.replay(lines, B.inspect(lines, written(receipts, "receipts")), 1)
    return records.select("replay_key", "workspace_canonical", "payload_hash")


def _notices(spark, sf):
    k = F.col("conflict_id")
    pins = F.transform(F.slice("members", F.lit(1), F.when(k % 2 == 0, 1).otherwise(F.size("members"))), lambda i: F.struct(i.alias("memory_id"), ((i - F.when(k % 9 == 0, 0).otherwise(1)) % 3 + 1).cast("int").alias("version")))
    delivery = F.when(k % 5 == 0, "delivered").when(k % 5 == 1, "dismissed").otherwise("pending")
    return conflicts(spark, sf).select(k.alias("notice_id"), "ws", F.lit("candidate").alias("status"), delivery.alias("delivery"), "revision", pins.alias("members"))


@query("notices_closed", f"""WITH {MEMORIES_SQL}, {CONFLICTS_SQL}, e AS (SELECT conflict_id, ws, unnest(CASE WHEN conflict_id % 2 = 0 THEN members[1:1] ELSE members END) AS id FROM c),
fr AS (SELECT e.conflict_id, bool_and(coalesce(m.status = 'active' AND m.ws = e.ws AND m.version = (e.id - CASE WHEN e.conflict_id % 9 = 0 THEN 0 ELSE 1 END) % 3 + 1, false)) AS fresh FROM e LEFT JOIN m ON m.id = e.id GROUP BY ALL),
r AS (SELECT event_id AS seq, user_id * 11 AS notice_id, (['dismissed', 'resolved', 'closed'])[event_id % 3 + 1] AS wanted FROM events), t AS (SELECT *, CASE WHEN wanted <> 'closed' THEN row_number() OVER (PARTITION BY notice_id, wanted <> 'closed' ORDER BY seq) END AS turn FROM r),
n AS (SELECT conflict_id, conflict_id % 5 <> 1 AS open, fresh, (SELECT wanted FROM t WHERE t.notice_id = c.conflict_id AND turn = 1) AS first FROM c JOIN fr USING (conflict_id))
SELECT seq, notice_id, CASE WHEN wanted = 'closed' THEN 'invalid_status' WHEN conflict_id IS NULL THEN 'not_found' WHEN open AND turn = 1 THEN CASE WHEN fresh THEN 'updated' ELSE 'stale_snapshot' END ELSE 'already_terminal' END AS outcome,
 CASE WHEN wanted = 'closed' OR conflict_id IS NULL THEN NULL WHEN NOT open THEN 'dismissed' WHEN fresh THEN first ELSE 'stale' END AS delivery FROM t LEFT JOIN n ON n.conflict_id = t.notice_id""")
def notices_closed(spark, sf):
    """Outcomes of requests that close notices, some of them stale, closed before or asked for twice."""
    e = F.col("event_id")
    wanted = F.get(F.array(*[F.lit(x) for x in ("dismissed", "resolved", "closed")]), (e % 3).cast("int"))
    requests = table(spark, sf, "events").select(e.alias("seq"), (F.col("user_id") * 11).alias("notice_id"), wanted.alias("status"), F.lit("seen").alias("reason"))
    return N.close_notices(_notices(spark, sf), requests, memories(spark, sf).select("id", "version", "status", "ws"))[0]


_CHOICES = "[upper(source), 'Team ' || source, 'team_' || source, 'default', 'Crew ' || source]"


@query("pending_confirmed", f"""WITH q AS (SELECT doc_id + 1 AS id, (doc_id + 1) * 2 + t AS seq, t, source, {_CHOICES} AS choices, doc_id % 13 = 1 AS pending, doc_id // 13 % 4 = 0 AS authorized, (doc_id // 13 + t * 3) % 5 AS c, doc_id // 13 % 5 AS c0, length(source) % 2 = 0 AS apart
  FROM documents, (VALUES (0), (1)) v(t)),
f AS (SELECT source, min(seq) AS first FROM q WHERE pending AND authorized AND apart AND c = 4 AND (t = 0 OR c0 = 3) GROUP BY source),
o AS (SELECT q.*, CASE WHEN c = 3 THEN 'reserved' WHEN c = 4 AND apart AND NOT authorized AND coalesce(seq < first, true) THEN 'kept_separate' ELSE 'confirmed' END AS said FROM q LEFT JOIN f USING (source)),
p AS (SELECT *, CASE WHEN NOT pending THEN 'not_pending' WHEN t = 1 AND lag(said) OVER (PARTITION BY id ORDER BY t) = 'confirmed' THEN 'not_pending' ELSE said END AS outcome FROM o)
SELECT seq, id, outcome, CASE WHEN outcome = 'confirmed' THEN CASE WHEN c = 0 THEN source WHEN c = 4 AND apart THEN 'Crew ' || source ELSE 'Team ' || source END END AS canonical FROM p""")
def pending_confirmed(spark, sf):
    """Two requests for each record: its own name in capitals, a registered one, a spelling of that, the common pool, and one that was kept apart or is redirected."""
    k, source = F.col("doc_id"), F.col("source")
    choices = F.array(F.upper(source), F.concat(F.lit("Team "), source), F.concat(F.lit("team_"), source), F.lit("default"), F.concat(F.lit("Crew "), source))
    d = table(spark, sf, "documents").select("doc_id", "source").withColumn("t", F.explode(F.array(F.lit(0), F.lit(1))))
    lot = F.floor(k / 13)
    requests = d.select(((k + 1) * 2 + F.col("t")).alias("seq"), (k + 1).alias("id"), F.get(choices, ((lot + F.col("t") * 3) % 5).cast("int")).alias("canonical"), (lot % 4 == 0).alias("authorized"))
    names = table(spark, sf, "documents").select("source").distinct()
    team, crew = F.concat(F.lit("Team "), source), F.concat(F.lit("Crew "), source)
    apart = F.length(source) % 2 == 0
    aliases = names.select(F.when(apart, source).otherwise(crew).alias("alias"), F.when(apart, crew).otherwise(team).alias("canonical"), F.when(apart, "rejected").otherwise("confirmed").alias("status"), F.lit(0).cast("long").alias("updated_at"))
    m = memories(spark, sf).select("id", "workspace", "workspace_canonical", "status", "version")
    return P.confirm_pending(m, requests, names.select(team.alias("name")), aliases).outcomes


@query("registry_review", """SELECT 'workspace.review' AS "check", count(*) FILTER (old IS NULL) = 0 AS passed, CASE WHEN count(*) FILTER (old IS NULL) = 0 THEN 'ok' ELSE 'warning' END AS severity, count(old) AS confirmed, count(*) AS "current", count(*) FILTER (old IS NULL) AS "new"
FROM (SELECT DISTINCT url AS name FROM pages) LEFT JOIN (SELECT DISTINCT url AS name, 1 AS old FROM pages WHERE page_id % 10 <> 3) USING (name)""")
def registry_review(spark, sf):
    """The registry of all pages' addresses against the snapshot that was taken before a tenth of them came."""
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("name"))
    reviewed = ReviewedRegistry(spark, f"{shared_folder(spark)}/reviewed-{uuid.uuid4().hex}")
    reviewed.confirm(pages.where("page_id % 10 <> 3"), authorized=True)
    return reviewed.finding(pages)
