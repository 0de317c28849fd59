"""Status, scope, tag and time predicates, listings and pages over memories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_domain(domain: str) -> Column:
    """active; expired (neither active nor deleted; superseded means the same); all (not deleted)."""
    status = F.col("status")
    if domain == "active":
        return status == "active"
    if domain in ("expired", "superseded"):
        return ~status.isin("active", "deleted")
    return status != "deleted"


def in_scope(names: Sequence[str] | None, empty_means_none: bool = False) -> Column:
    """Workspace scope: blanks and repeats are dropped; without names all rows, or none if asked."""
    kept = list(dict.fromkeys(n.strip() for n in names or () if n and n.strip()))
    if kept:
        return F.col("ws").isin(*kept)
    return F.lit(not empty_means_none)


def has_all_tags(tags: Sequence[str]) -> Column:
    return F.size(F.array_intersect("tags", F.array(*map(F.lit, tags)))) == len(set(tags)) if tags else F.lit(True)


def has_any_tag(tags: Sequence[str]) -> Column:
    return F.arrays_overlap("tags", F.array(*map(F.lit, tags))) if tags else F.lit(False)


def has_tag_text(tag: str) -> Column:
    """A tag, or a part of one, in the tags as JSON text."""
    return F.contains(F.to_json("tags"), F.lit(tag))


def between(column: str, after: str | None = None, before: str | None = None) -> Column:
    """Inclusive bounds; one that can't be parsed is ignored, as are two that exclude one another; null fails any bound."""
    low, high = (F.lit(x).try_cast("timestamp") for x in (after, before))
    at = F.col(column).cast("timestamp")
    out = F.coalesce((low.isNull() | (at >= low)) & (high.isNull() | (at <= high)), F.lit(False))
    return F.coalesce(low > high, F.lit(False)) | out


def user_protected() -> Column:
    return (F.col("source_type") == "user_confirmed") | F.col("protection_level").isin("locked", "protected")


def newest(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """By event time, then ingest time, then id, newest first."""
    return df.orderBy(F.desc("event_time"), F.desc("ingest_time"), F.desc("id")).offset(offset).limit(limit)


def filter_recall(df: DataFrame, *, domain: str = "active", tags: Sequence[str] = (), after: str | None = None, before: str | None = None, source_type: str | None = None, scope: Sequence[str] | None = None) -> DataFrame:
    """All rows that meet every given filter."""
    out = df.where(status_domain(domain) & in_scope(scope) & has_all_tags(tags) & between("event_time", after, before))
    return out.where(F.col("source_type") == source_type) if source_type else out


def trust_order() -> list[Column]:
    """Superseded last; locked, protected, others; confirmed, extracted, others; then confidence and times."""
    return [
        F.when(F.col("status") == "superseded", 1).otherwise(0),
        F.when(F.col("protection_level") == "locked", 0).when(F.col("protection_level") == "protected", 1).otherwise(2),
        F.when(F.col("source_type") == "user_confirmed", 0).when(F.col("source_type") == "document_extracted", 1).otherwise(2),
        F.desc("confidence"), F.desc("ingest_time"), F.desc("event_time"), F.col("id"),
    ]


def span_read(df: DataFrame, start: int, end: int) -> DataFrame:
    """content[start:end] of rows long enough for it to begin; others have an error."""
    if not 0 <= start < end:
        raise ValueError("need 0 <= start < end")
    n = F.length("content")
    return df.select("id", F.when(n > start, F.substring("content", start + 1, end - start)).alias("span"), (n <= start).alias("past_end"))
