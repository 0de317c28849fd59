"""The fact model over the given tables: memories, evidence units, conflicts, history, attention.

Every view is plain integer and string arithmetic on one table's rows (memories also look up
labels), so each has an equal in SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content, workspace, workspace_canonical, ws, subject, tags, source_type, protection_level,
    status, confidence, event_time, ingest_time, version."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    k = F.col("doc_id")
    canonical = F.when(k % 5 != 0, F.col("source"))
    tags = F.concat(F.array("lang", "source"), F.when(k % 17 == 0, F.array(F.lit("todo"))).otherwise(F.array().cast("array<string>")))
    status = F.when(k % 13 == 0, "superseded").when(k % 13 == 1, "pending").when(k % 13 == 2, "conflicted").when(k % 13 == 3, "deleted").otherwise("active")
    day = F.lit("2024-01-01").cast("date")
    return d.select(
        (k + 1).alias("id"),
        F.col("text").alias("content"),
        F.col("source").alias("workspace"),
        canonical.alias("workspace_canonical"),
        F.coalesce(canonical, "source").alias("ws"),
        F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("subject"),
        tags.alias("tags"),
        F.when(F.col("quality") == 1, "user_confirmed").when(F.col("quality") == 0, "agent_generated").otherwise("document_extracted").alias("source_type"),
        F.when(k % 29 == 0, "locked").otherwise("normal").alias("protection_level"),
        status.alias("status"),
        ((k % 10) / 10.0).alias("confidence"),
        F.date_add(day, (k * 7 % 365).cast("int")).alias("event_time"),
        F.date_add(day, (k % 365).cast("int")).alias("ingest_time"),
        (k % 3 + 1).cast("int").alias("version"),
    )


MEMORIES_SQL = """m AS (
  SELECT d.doc_id + 1 AS id, d.text AS content, d.source AS workspace,
         CASE WHEN d.doc_id % 5 <> 0 THEN d.source END AS workspace_canonical, d.source AS ws,
         substr(split_part(d.text, chr(10), 1), 1, 60) AS subject,
         CASE WHEN d.doc_id % 17 = 0 THEN [d.lang, d.source, 'todo'] ELSE [d.lang, d.source] END AS tags,
         CASE quality WHEN 1 THEN 'user_confirmed' WHEN 0 THEN 'agent_generated' ELSE 'document_extracted' END AS source_type,
         CASE WHEN d.doc_id % 29 = 0 THEN 'locked' ELSE 'normal' END AS protection_level,
         CASE d.doc_id % 13 WHEN 0 THEN 'superseded' WHEN 1 THEN 'pending' WHEN 2 THEN 'conflicted' WHEN 3 THEN 'deleted' ELSE 'active' END AS status,
         (d.doc_id % 10) / 10.0::DOUBLE AS confidence,
         DATE '2024-01-01' + CAST(d.doc_id * 7 % 365 AS INTEGER) AS event_time,
         DATE '2024-01-01' + CAST(d.doc_id % 365 AS INTEGER) AS ingest_time,
         CAST(d.doc_id % 3 + 1 AS INTEGER) AS version
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence units: unit_id, memory_id, memory_version, unit_index, kind, embedding (doubles), label."""
    v = F.col("vec_id")
    kinds = F.array(*[F.lit(x) for x in ("text", "heading", "subject", "text")])
    return table(spark, sf_dir, "embeddings").select(
        v.alias("unit_id"),
        (F.floor(v / 4) + 1).alias("memory_id"),
        ((F.floor(v / 4) % 4) + 1).cast("int").alias("memory_version"),
        (v % 4).cast("int").alias("unit_index"),
        F.get(kinds, (F.col("label") % 4).cast("int")).alias("kind"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
        F.col("label").cast("int").alias("label"),
    )


UNITS_SQL = """u AS (
  SELECT vec_id AS unit_id, vec_id // 4 + 1 AS memory_id, CAST((vec_id // 4) % 4 + 1 AS INTEGER) AS memory_version,
         CAST(vec_id % 4 AS INTEGER) AS unit_index, (['text', 'heading', 'subject', 'text'])[label % 4 + 1] AS kind,
         CAST(embedding AS DOUBLE[]) AS embedding, CAST(label AS INTEGER) AS label
  FROM embeddings)"""


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conflict_id, ws, status, members (ids), versions, slot_key, normalized_value by member, severity, created_at, revision."""
    k = F.col("doc_id")
    day = F.lit("2024-01-01").cast("date")
    return table(spark, sf_dir, "documents").where(k % 11 == 0).select(
        k.alias("conflict_id"),
        F.col("source").alias("ws"),
        F.when(k % 4 == 0, "open").when(k % 4 == 1, "applying").when(k % 4 == 2, "resolved").otherwise("not_a_conflict").alias("status"),
        F.when(k % 3 == 0, F.array(k + 1, k + 2, k + 3)).otherwise(F.array(k + 1, k + 2)).alias("members"),
        F.concat_ws("/", "lang", F.lit("length"), "source").alias("slot_key"),
        F.when(k % 5 == 0, "critical").when(k % 5 == 1, "high").when(k % 5 == 2, "warning").when(k % 5 == 3, "normal").otherwise("low").alias("severity"),
        F.date_add(day, (k * 3 % 365).cast("int")).alias("created_at"),
        (k % 4 + 1).cast("int").alias("revision"),
    )


CONFLICTS_SQL = """c AS (
  SELECT doc_id AS conflict_id, source AS ws,
         CASE doc_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'applying' WHEN 2 THEN 'resolved' ELSE 'not_a_conflict' END AS status,
         CASE WHEN doc_id % 3 = 0 THEN [doc_id + 1, doc_id + 2, doc_id + 3] ELSE [doc_id + 1, doc_id + 2] END AS members,
         lang || '/length/' || source AS slot_key,
         CASE doc_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'warning' WHEN 3 THEN 'normal' ELSE 'low' END AS severity,
         DATE '2024-01-01' + CAST(doc_id * 3 % 365 AS INTEGER) AS created_at, CAST(doc_id % 4 + 1 AS INTEGER) AS revision
  FROM documents WHERE doc_id % 11 = 0)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of memories: memory_id, version, actor, content."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("memory_id"), F.col("turn").alias("version"), F.col("role").alias("actor"), F.col("text").alias("content"))


HISTORY_SQL = "h AS (SELECT conv_id AS memory_id, turn AS version, role AS actor, text AS content FROM conversations)"
