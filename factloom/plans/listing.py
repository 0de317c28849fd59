"""Queries: lookups, listings, pages, counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import filters as P
from factloom.plans.registry import query
from factloom.sources.views import CONFLICTS_SQL, HISTORY_SQL, MEMORIES_SQL, UNITS_SQL, conflicts, history, memories, table, units

M = "WITH " + MEMORIES_SQL
SHORT = "id, ws, subject, status, source_type, event_time, ingest_time"
COLUMNS = [c.strip() for c in SHORT.split(",")]


@query("point_lookup", f"{M} SELECT {SHORT}, content FROM m WHERE id = 42")
def point_lookup(spark, sf):
    return memories(spark, sf).where("id = 42").select(*COLUMNS, "content")


@query("acl_lookup", f"{M} SELECT {SHORT} FROM m WHERE id IN (5, 42, 77) AND ws IN ('src1', 'src2', 'src4')")
def acl_lookup(spark, sf):
    return memories(spark, sf).where(F.col("id").isin(5, 42, 77) & P.in_scope(["src1", "src2", " ", "src4"])).select(*COLUMNS)


@query("list_newest", f"{M} SELECT {SHORT} FROM m WHERE status <> 'deleted' ORDER BY event_time DESC, ingest_time DESC, id DESC LIMIT 20")
def list_newest(spark, sf):
    return P.newest(memories(spark, sf).where(P.status_domain("all")), 20).select(*COLUMNS)


@query("list_in_workspace", f"{M} SELECT {SHORT} FROM m WHERE status <> 'deleted' AND ws IN ('src3', 'src5') ORDER BY event_time DESC, ingest_time DESC, id DESC LIMIT 20")
def list_in_workspace(spark, sf):
    return P.newest(memories(spark, sf).where(P.status_domain("all") & P.in_scope(["src3", "src5"])), 20).select(*COLUMNS)


_RECALL = "status = 'active' AND list_contains(tags, 'en') AND list_contains(tags, 'src8') AND event_time BETWEEN DATE '2024-02-01' AND DATE '2024-11-30'"


def _recalled(spark, sf):
    return P.filter_recall(memories(spark, sf), tags=["en", "src8"], after="2024-02-01", before="2024-11-30")


@query("filter_recall", f"{M} SELECT {SHORT} FROM m WHERE {_RECALL} ORDER BY event_time DESC, ingest_time DESC, id DESC LIMIT 10 OFFSET 3")
def filter_recall(spark, sf):
    return P.newest(_recalled(spark, sf), 10, 3).select(*COLUMNS)


@query("filtered_count", f"{M} SELECT count(*) AS total, min(event_time) AS oldest, max(event_time) AS newest FROM m WHERE {_RECALL}")
def filtered_count(spark, sf):
    return _recalled(spark, sf).agg(F.count("*").alias("total"), F.min("event_time").alias("oldest"), F.max("event_time").alias("newest"))


@query("any_tag", f"{M} SELECT id, ws FROM m WHERE status <> 'deleted' AND list_has_any(tags, ['todo', 'src7'])")
def any_tag(spark, sf):
    return memories(spark, sf).where(P.status_domain("all") & P.has_any_tag(["todo", "src7"])).select("id", "ws")


@query("expired_domain", f"{M} SELECT id, ws, status FROM m WHERE status NOT IN ('active', 'deleted')")
def expired_domain(spark, sf):
    return memories(spark, sf).where(P.status_domain("superseded")).select("id", "ws", "status")


@query("recent_browse", f"{M} SELECT {SHORT}, (SELECT count(*) FROM m WHERE status = 'active') AS total FROM m WHERE status = 'active' ORDER BY ingest_time DESC, id DESC LIMIT 15 OFFSET 5")
def recent_browse(spark, sf):
    active = memories(spark, sf).where(P.status_domain("active"))
    total = active.agg(F.count("*").alias("total"))
    return active.orderBy(F.desc("ingest_time"), F.desc("id")).offset(5).limit(15).select(*COLUMNS).join(F.broadcast(total))


@query("recent_fallback", f"""{M} SELECT {SHORT} FROM m WHERE status IN ('active', 'superseded')
ORDER BY CASE WHEN status = 'superseded' THEN 1 ELSE 0 END, CASE protection_level WHEN 'locked' THEN 0 WHEN 'protected' THEN 1 ELSE 2 END,
 CASE source_type WHEN 'user_confirmed' THEN 0 WHEN 'document_extracted' THEN 1 ELSE 2 END, confidence DESC, ingest_time DESC, event_time DESC, id LIMIT 50""")
def recent_fallback(spark, sf):
    return memories(spark, sf).where(F.col("status").isin("active", "superseded")).orderBy(*P.trust_order()).limit(50).select(*COLUMNS)


@query("summaries", f"{M} SELECT id, substr(content, 1, 200) AS snippet FROM m WHERE status = 'active' AND id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def summaries(spark, sf):
    wanted = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return memories(spark, sf).where(P.status_domain("active")).join(wanted, "id", "left_semi").select("id", F.substring("content", 1, 200).alias("snippet"))


@query("span_read", f"{M} SELECT id, CASE WHEN length(content) > 100 THEN substr(content, 101, 80) END AS span, length(content) <= 100 AS past_end FROM m")
def span_read(spark, sf):
    return P.span_read(memories(spark, sf), 100, 180)


@query("keyset_page", f"{M}, p AS (SELECT id, ws FROM m WHERE status = 'active' AND id > 100 ORDER BY id LIMIT 51) SELECT id, ws, (SELECT count(*) FROM p) > 50 AS more FROM p ORDER BY id LIMIT 50")
def keyset_page(spark, sf):
    page = memories(spark, sf).where(P.status_domain("active") & (F.col("id") > 100)).orderBy("id").limit(51).select("id", "ws")
    more = page.agg((F.count("*") > 50).alias("more"))
    return page.orderBy("id").limit(50).join(F.broadcast(more))


@query("history_list", f"WITH {HISTORY_SQL} SELECT memory_id, version, actor FROM h WHERE memory_id IN (1, 2, 3) ORDER BY memory_id, version DESC")
def history_list(spark, sf):
    return history(spark, sf).where("memory_id in (1, 2, 3)").orderBy("memory_id", F.desc("version")).select("memory_id", "version", "actor")


@query("version_chain", f"WITH {HISTORY_SQL} SELECT memory_id, max(version) AS version, arg_max(content, version) AS content, count(*) AS versions FROM h GROUP BY memory_id")
def version_chain(spark, sf):
    return history(spark, sf).groupBy("memory_id").agg(F.max("version").alias("version"), F.max_by("content", "version").alias("content"), F.count("*").alias("versions"))


@query("history_purge", f"WITH {HISTORY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY version DESC) AS age FROM h) SELECT memory_id, version FROM r WHERE age <= 2 OR memory_id % 3 <> 0")
def history_purge(spark, sf):
    age = F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("version")))
    return history(spark, sf).withColumn("age", age).where("age <= 2 or memory_id % 3 <> 0").select("memory_id", "version")


@query("conflict_list", f"WITH {CONFLICTS_SQL} SELECT conflict_id, ws, status, created_at FROM c WHERE status IN ('open', 'applying') ORDER BY created_at DESC, conflict_id DESC LIMIT 20 OFFSET 2")
def conflict_list(spark, sf):
    return conflicts(spark, sf).where(F.col("status").isin("open", "applying")).orderBy(F.desc("created_at"), F.desc("conflict_id")).offset(2).limit(20).select("conflict_id", "ws", "status", "created_at")


@query("current_text_vectors", f"{M}, {UNITS_SQL} SELECT unit_id, memory_id, unit_index FROM u JOIN m ON memory_id = id AND memory_version = version WHERE kind = 'text'")
def current_text_vectors(spark, sf):
    live = memories(spark, sf).select(F.col("id").alias("memory_id"), F.col("version").alias("memory_version"))
    return units(spark, sf).where("kind = 'text'").join(live, ["memory_id", "memory_version"], "left_semi").select("unit_id", "memory_id", "unit_index")
