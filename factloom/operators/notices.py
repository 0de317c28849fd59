"""Closing of notices: dismissed or resolved once, and marked stale where their members have moved on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.lifecycle import freshness

OPEN = ("pending", "delivered")
CLOSED = ("dismissed", "resolved")


def visible(notices: DataFrame, records: DataFrame, scope: list[str] | None) -> DataFrame:
    """notice_id of those in the scope of which each member's record is there and in the scope too; all without a scope."""
    if scope is None:
        return notices.select("notice_id")
    member = notices.where(F.col("ws").isin(scope)).select("notice_id", F.explode("members").alias("m"))
    inside = records.where(F.col("ws").isin(scope)).select(F.col("id").alias("m_id"), F.lit(True).alias("inside"))
    return member.join(inside, F.col("m.memory_id") == F.col("m_id"), "left").groupBy("notice_id").agg(F.bool_and(F.col("inside").isNotNull()).alias("all")).where("all").select("notice_id")


def close_notices(notices: DataFrame, requests: DataFrame, records: DataFrame, scope: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """requests(seq, notice_id, status, reason), seq each once, to their outcomes(seq, notice_id, outcome, delivery), and the notices after them.

    notices(notice_id, ws, status, delivery, revision, members of (memory_id, version)).  The first
    request for an open notice counts: if a member is no longer live, in that version and workspace, the notice
    becomes stale (``stale_snapshot``), otherwise it is closed (``updated``); later ones find it ``already_terminal``.  A notice out of
    scope is ``not_found``, yet becomes stale if its members have moved; another status than dismissed or resolved is ``invalid_status``.
    A dismissed notice is no conflict; a resolved one keeps its status, as only escalation makes it a conflict.
    The first of a notice's requests is found by an aggregate, so a notice with very many is no large group.
    """
    good = F.coalesce(F.lower("wanted").isin(*CLOSED), F.lit(False))
    asked = requests.select("seq", "notice_id", F.col("status").alias("wanted"), "reason")
    first = asked.where(good).groupBy("notice_id").agg(F.min_by(F.struct("seq", F.lower("wanted").alias("wanted"), "reason"), "seq").alias("first"))
    seen = visible(notices, records, scope).withColumn("seen", F.lit(True))
    near: Column = F.lit(True) if scope is None else F.coalesce(F.col("ws").isin(scope), F.lit(False))
    facts = notices.join(freshness(notices, records).select("notice_id", "fresh"), "notice_id", "left").join(seen, "notice_id", "left").join(first, "notice_id", "left")
    open_, fresh = F.col("delivery").isin(*OPEN), F.coalesce("fresh", F.lit(False))
    facts = facts.withColumn("reached", F.col("first").isNotNull() & near & open_)
    stale, done = F.col("reached") & ~fresh, F.col("reached") & fresh & F.col("seen").isNotNull()
    after = F.when(stale, "stale").when(done, F.col("first.wanted")).otherwise(F.col("delivery"))
    facts = facts.withColumns({"after": after, "stale": stale, "done": done, "near": near})
    told = asked.join(facts.select("notice_id", "after", "stale", "done", "seen", "near", F.col("first.seq").alias("first")), "notice_id", "left")
    outcome = (
        F.when(~good, "invalid_status").when(F.col("near").isNull() | ~F.col("near") | F.col("seen").isNull(), "not_found")
        .when(F.col("stale") & (F.col("seq") == F.col("first")), "stale_snapshot").when(F.col("done") & (F.col("seq") == F.col("first")), "updated").otherwise("already_terminal")
    )
    outcomes = told.select("seq", "notice_id", outcome.alias("outcome"), F.when(outcome.isin("stale_snapshot", "updated", "already_terminal"), F.col("after")).alias("delivery"))
    dismissed = F.col("done") & (F.col("first.wanted") == "dismissed")
    now = facts.select(
        "notice_id", "ws", F.when(dismissed, "not_a_conflict").otherwise(F.col("status")).alias("status"), F.col("after").alias("delivery"),
        (F.col("revision") + F.col("done").cast("int")).alias("revision"), "members", F.when(F.col("done"), F.col("first.reason")).alias("reason"))
    return outcomes, now
