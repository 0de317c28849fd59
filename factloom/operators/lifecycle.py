"""Records and their governed fields: insertion, field and metadata updates, trust actions, freshness of notices.

Changes are rows that name a record; a batch holds one change a record, and is applied by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that a field update may set; any that differs makes a new version.
FIELDS = ("source_type", "confidence", "protection_level", "status")


def guarded() -> Column:
    """Records that only an authorised change may touch."""
    return (F.col("protection_level") == "locked") | (F.col("source_type") == "user_confirmed")


def insert_records(records: DataFrame, new: DataFrame, base: int) -> DataFrame:
    """new(seq, content, subject, workspace, tags) as records with id base + seq, version 1; blank contents are left out."""
    kept = new.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    workspace = F.coalesce(F.nullif(F.trim("workspace"), F.lit("")), F.lit("default"))
    fresh = kept.select((F.col("seq") + base).alias("id"), "content", "subject", workspace.alias("ws"), F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"), F.lit("active").alias("status"), F.lit(1).alias("version"))
    return records.select("id", "content", "subject", "ws", "tags", "status", "version").unionByName(fresh)


def unregistered(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Workspaces of records that the registry(name, vector) lacks, or has without a vector."""
    found = records.select(F.col("ws").alias("name")).distinct().join(registry.select("name", "vector"), "name", "left")
    return found.where("vector is null").select("name")


def update_fields(records: DataFrame, changes: DataFrame) -> DataFrame:
    """records after changes(id, some of FIELDS); null leaves a field as it is, and versions rise only where one differs."""
    given = [c for c in FIELDS if c in changes.columns]
    both = records.join(changes.select("id", *[F.col(c).alias(f"new_{c}") for c in given]), "id", "left")
    differs = F.lit(False)
    for c in given:
        differs = differs | (F.col(f"new_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"new_{c}")))
    both = both.withColumn("version", F.col("version") + differs.cast("int"))
    return both.withColumns({c: F.coalesce(f"new_{c}", c) for c in given}).select(*records.columns)


def update_metadata(records: DataFrame, changes: DataFrame) -> DataFrame:
    """records(id, status, protection_level, source_type, version, metadata) with changes(id, set, clear, authorized):
    the outcome, the metadata (cleared first, then set) and the version after."""
    j = changes.join(records, "id", "left")
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    old, put = F.coalesce("metadata", empty), F.coalesce("set", empty)
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.coalesce("clear", F.array().cast("array<string>")), k) & ~F.map_contains_key(put, k))
    new = F.map_concat(kept, put)
    entries = lambda m: F.array_sort(F.map_entries(m))
    outcome = (
        F.when(F.col("version").isNull(), "not_found").when(F.col("status") != "active", "not_active").when(guarded() & ~F.coalesce("authorized", F.lit(False)), "forbidden")
        .when(entries(new) == entries(old), "no_change").otherwise("updated"))
    done = outcome == "updated"
    return j.select("id", outcome.alias("outcome"), F.when(done, new).otherwise(F.col("metadata")).alias("metadata"), (F.col("version") + done.cast("int")).alias("version"))


def trust_actions(records: DataFrame, actions: DataFrame) -> DataFrame:
    """actions(id, action, authorized, confidence, superseded_by) with outcome and the record's fields after it.

    All three need authorisation, before anything else is looked at.  confirm makes an active record
    user-confirmed and locked, with the confidence given (from 0 to 1).  retire supersedes any record that is
    not superseded or deleted yet and lifts its lock; a replacement, if one is named, must be another record
    and active.  activate lets a pending one in.  The version grows if a field has changed.
    """
    own = records.select("id", "status", "source_type", "protection_level", "confidence", "version")
    given = actions.withColumnRenamed("confidence", "wanted")
    other = records.select(F.col("id").alias("superseded_by"), F.col("status").alias("other"))
    j = given.join(own, "id", "left").join(other, "superseded_by", "left")
    confirm, retire, activate = (F.col("action") == x for x in ("confirm", "retire", "activate"))
    replaced = retire & F.col("superseded_by").isNotNull()
    outcome = (
        F.when(~F.coalesce("authorized", F.lit(False)), "forbidden")
        .when(confirm & ~F.coalesce(F.col("wanted").between(0, 1), F.lit(False)), "invalid_confidence")
        .when(replaced & (F.col("superseded_by") == F.col("id")), "invalid_replacement")
        .when(F.col("status").isNull(), "not_found")
        .when(confirm & (F.col("status") != "active"), "not_active")
        .when(activate & (F.col("status") != "pending"), "not_pending")
        .when(retire & F.col("status").isin("superseded", "deleted"), F.concat(F.lit("already_"), "status"))
        .when(replaced & F.col("other").isNull(), "replacement_not_found")
        .when(replaced & (F.col("other") != "active"), "replacement_not_active")
        .otherwise("done"))
    done = outcome == "done"
    after = {
        "status": F.when(done & retire, "superseded").when(done & activate, "active"),
        "source_type": F.when(done & confirm, "user_confirmed"),
        "protection_level": F.when(done & confirm, "locked").when(done & retire, "normal"),
        "confidence": F.when(done & confirm, F.col("wanted"))}
    changed = F.lit(False)
    for c, new in after.items():
        changed = changed | F.coalesce(new != F.col(c), F.lit(False))
    return j.select("id", "action", outcome.alias("outcome"), *[F.coalesce(new, c).alias(c) for c, new in after.items()], (F.col("version") + changed.cast("int")).alias("version"))


def freshness(notices: DataFrame, records: DataFrame) -> DataFrame:
    """notices(notice_id, ws, members of (memory_id, version)) with fresh: every member is live, in that version and workspace."""
    member = notices.select("notice_id", "ws", F.explode_outer("members").alias("m"))
    live = records.where("status = 'active'").select(F.col("id").alias("m_id"), F.col("version").alias("m_version"), F.col("ws").alias("m_ws"))
    ok = F.coalesce((F.col("m.version") == F.col("m_version")) & (F.col("ws") == F.col("m_ws")) & (F.col("ws") != ""), F.lit(False))
    j = member.join(live, F.col("m.memory_id") == F.col("m_id"), "left").withColumn("ok", ok | F.col("m").isNull())
    return j.groupBy("notice_id").agg(F.bool_and("ok").alias("fresh"), F.count_if(~F.col("ok")).alias("stale_members"))


def notice_pairs(found: DataFrame, most: int = 2) -> DataFrame:
    """found(anchor, peer, action, distance): each peer's nearest hit, those to notify first, then by distance, 1 to 3 an anchor."""
    best = found.groupBy("anchor", "peer").agg(F.min_by(F.struct("action", "distance"), F.struct("distance", "action")).alias("b")).select("anchor", "peer", "b.*")
    order = Window.partitionBy("anchor").orderBy(F.col("action") != "notify", F.coalesce("distance", F.lit(9.0)), "peer")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(1, min(3, most)))
