"""Audit, coverage, health and digest aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def audit_summary(memories: DataFrame, conflicts: DataFrame) -> DataFrame:
    """By workspace: counts by source type, oldest and newest event, open conflicts; conflict-only workspaces have none of the first."""
    kinds = memories.where("status <> 'deleted'").groupBy("ws", "source_type").agg(F.count("*").alias("n"), F.min("event_time").alias("oldest"), F.max("event_time").alias("newest"))
    spaces = kinds.groupBy("ws").agg(
        F.sum("n").alias("memories"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "source_type", F.col("n").cast("string")))), ",").alias("by_source"))
    open_ = conflicts.where("status in ('open', 'applying')").groupBy("ws").agg(F.count("*").alias("open_conflicts"))
    return spaces.join(open_, "ws", "full").select("ws", F.coalesce("memories", F.lit(0)).alias("memories"), "oldest", "newest", F.coalesce("by_source", F.lit("")).alias("by_source"), F.coalesce("open_conflicts", F.lit(0)).alias("open_conflicts"))


def tag_frequency(memories: DataFrame) -> DataFrame:
    """Distinct memories by tag; the ids of a memory's tags are made distinct first, so the sum is exact and partial."""
    return memories.select("id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("df"))


def coverage(memories: DataFrame, units: DataFrame) -> DataFrame:
    """One row: active memories, those with text, those with current units, and units."""
    active = memories.where("status = 'active'").select("id", "version", (F.col("subject").rlike(r"(?U)\S") | F.col("content").rlike(r"(?U)\S")).alias("eligible"))
    current = units.select(F.col("memory_id").alias("id"), F.col("memory_version").alias("version")).groupBy("id", "version").agg(F.count("*").alias("units"))
    joined = active.join(current, ["id", "version"], "left")
    has = F.col("units").isNotNull()
    return joined.agg(
        F.count("*").alias("total"), F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & has).alias("indexed"),
        F.count_if(~F.col("eligible")).alias("not_indexable"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"))


def stale_units(memories: DataFrame, units: DataFrame) -> DataFrame:
    """Units of a version that is no longer the live one."""
    live = memories.select(F.col("id").alias("memory_id"), F.col("version").alias("live_version"))
    return units.join(live, "memory_id").where("memory_version <> live_version").select("unit_id", "memory_id", "memory_version", "live_version")


def orphan_units(memories: DataFrame, units: DataFrame) -> DataFrame:
    """Units of memories that do not exist or are deleted."""
    live = memories.where("status <> 'deleted'").select(F.col("id").alias("memory_id"))
    return units.join(live, "memory_id", "left_anti").select("unit_id", "memory_id")


def digests(lines: DataFrame, by: str, rows: int = 10_000) -> DataFrame:
    """lines(by, id, line), ids from 0, to (by, n, max_id, digest): digests over ranges of ``rows`` ids, over as
    many ranges in their order, and over those; so no task holds more than ``rows`` lines of a group."""
    joined = lambda key, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), "\n").cast("binary"), 256).alias("line")
    kept = F.max("max_id").alias("max_id")
    one = lines.groupBy(by, F.floor(F.col("id") / rows).alias("part")).agg(F.count("*").alias("n"), F.max("id").alias("max_id"), joined("id", "line"))
    two = one.groupBy(by, F.floor(F.col("part") / rows).alias("top")).agg(F.sum("n").alias("n"), kept, joined("part", "line"))
    return two.groupBy(by).agg(F.sum("n").alias("n"), kept, joined("top", "line")).withColumnRenamed("line", "digest")


def active_digest(memories: DataFrame) -> DataFrame:
    """A digest of the active (id, version) set, with how many there are and the largest id."""
    line = F.concat_ws("@", F.col("id").cast("string"), F.col("version").cast("string"))
    all_ = digests(memories.where("status = 'active'").select(F.lit(0).alias("all"), "id", line.alias("line")), "all")
    return all_.select(F.col("n").alias("active"), "max_id", "digest")


def slot_groups(members: DataFrame) -> DataFrame:
    """members(slot, member, value) to groups by slot: members, values, and whether a member has two values."""
    by_member = members.groupBy("slot", "member").agg(F.count_distinct("value").alias("values"))
    flags = by_member.groupBy("slot").agg(F.count("*").alias("members"), F.bool_or(F.col("values") > 1).alias("value_conflict"))
    values = members.select("slot", "value").distinct().groupBy("slot").agg(F.count("*").alias("values"))
    return flags.join(values, "slot").select("slot", "members", "values", "value_conflict")


def replay_page(lines: DataFrame, known: DataFrame) -> DataFrame:
    """lines(line_no, replay_key, valid) with an outcome: the first of a key counts, keys replayed before are skipped."""
    first = F.row_number().over(Window.partitionBy("replay_key").orderBy("line_no"))
    seen = known.select("replay_key", F.lit(True).alias("seen"))
    marked = lines.withColumn("turn", first).join(seen, "replay_key", "left")
    return marked.withColumn("outcome", F.when(~F.col("valid"), "invalid").when(F.col("seen"), "replayed").when(F.col("turn") > 1, "duplicate").otherwise("eligible"))
