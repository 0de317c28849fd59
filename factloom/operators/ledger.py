"""Governed changes as events: the state is a fold of an append-only log, changes are checked against it.

A log is folded a record at a time in the order of ``seq``: each event sees the state that the events
before it have left, and is refused without effect if that state doesn't allow it.  Spark deals the
records and their events by key and puts them in order; a task passes over them once and holds the
state of one record, however long its log is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def plain(array: pa.Array) -> list:
    """What to_pylist gives, of nested fields a column at a time: several times faster."""
    if pa.types.is_struct(array.type):
        names = [f.name for f in array.type]
        rows = [dict(zip(names, x)) for x in zip(*map(plain, array.flatten()))]
        return [r if there else None for r, there in zip(rows, array.is_valid().to_pylist())] if array.null_count else rows
    if pa.types.is_list(array.type):
        values, out, at = plain(array.flatten()), [], 0
        for n in pc.list_value_length(array).to_pylist():
            out.append(None if n is None else values[at : at + n])
            at += n or 0
        return out
    return array.to_pylist()


def fold_log(records: DataFrame, log: DataFrame, key: str, step: Callable[[dict | None, dict], tuple[dict | None, tuple]], result: T.StructType) -> DataFrame:
    """log with the columns of ``result``, by ``step(state, event) -> (state, values)``; the first state is the record, or None."""
    of_record, of_log = F.struct(*records.columns), F.struct(*log.columns)
    void = lambda df, name: F.lit(None).cast(df.select(F.struct(*df.columns).alias(name)).schema[name].dataType)
    first = records.select(F.col(key).alias("k"), F.lit(None).cast("long").alias("seq"), of_record.alias("record"), void(log, "event").alias("event"))
    then = log.select(F.col(key).alias("k"), F.col("seq").cast("long").alias("seq"), void(records, "record").alias("record"), of_log.alias("event"))
    ordered = first.unionByName(then).repartition("k").sortWithinPartitions(F.col("k"), F.col("seq").asc_nulls_first())
    schema = T.StructType([T.StructField("event", then.schema["event"].dataType), *result.fields])
    kinds = [to_arrow_type(f.dataType) for f in result.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        for b in batches:
            rows, values = [], []
            for i, (k, record, event) in enumerate(zip(*(plain(b.column(c)) for c in ("k", "record", "event")))):
                if k != at or record is not None:
                    at, state = k, record
                if event is not None:
                    state, out = step(state, event)
                    rows.append(i)
                    values.append(out)
            if rows:
                columns = [pa.array(v, t) for v, t in zip(zip(*values), kinds)]
                yield pa.RecordBatch.from_arrays([b.column("event").take(pa.array(rows)), *columns], names=schema.names)

    return ordered.select("k", "record", "event").mapInArrow(run, schema).select("event.*", *result.names)


_EDIT = T.StructType([T.StructField("outcome", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("version_after", T.IntegerType()), T.StructField("content_before", T.StringType()), T.StructField("content_after", T.StringType())])


def edit_step(state: dict | None, e: dict) -> tuple[dict | None, tuple]:
    """One edit against a record's present version, content and protection."""
    refused = lambda outcome, reason=None: (state, (outcome, reason, None, None, None))
    if state is None:
        return refused("missing")
    if state["status"] != "active":
        return refused("not_active", state["status"])
    if (state["protection_level"] == "locked" or state["source_type"] == "user_confirmed") and not e["authorized"]:
        return refused("protected")
    if e["expect_version"] is not None and e["expect_version"] != state["version"]:
        return refused("stale", "version_mismatch")
    old = state["content"] or ""
    if e["expect_hash"] is not None and e["expect_hash"] != hashlib.sha256(old.encode()).hexdigest():
        return refused("stale", "content_hash_mismatch")
    partial = e["old_text"] is not None or e["new_text"] is not None
    if e["content"] is not None:
        if partial or not e["content"].strip():
            return refused("invalid", "full_and_partial" if partial else "empty_content")
        new = e["content"]
    elif e["old_text"] is None or e["new_text"] is None:
        return refused("invalid", "no_content")
    elif e["old_text"] not in old:
        return refused("stale", "old_text_not_found")
    else:
        new = old.replace(e["old_text"], e["new_text"], 1)
    return {**state, "content": new, "version": state["version"] + 1}, ("applied", None, state["version"] + 1, old, new)


def apply_edits(records: DataFrame, edits: DataFrame) -> DataFrame:
    """edits with outcome (applied, stale, protected, not_active, invalid or missing), reason, and for applied
    ones version_after, content_before and content_after.

    edits(seq, id, expect_version, content) replace a record's content as a whole; with old_text and
    new_text instead of content its first occurrence.  Optional columns: expect_hash (sha256 of the
    content that is expected), authorized (lets a protected record be edited).
    """
    given = edits
    for name, kind in (("expect_version", "int"), ("expect_hash", "string"), ("content", "string"), ("old_text", "string"), ("new_text", "string"), ("authorized", "boolean")):
        if name not in edits.columns:
            given = given.withColumn(name, F.lit(None).cast(kind))
    status = F.col("status") if "status" in records.columns else F.lit("active")
    state = records.select("id", F.col("version").cast("int").alias("version"), "content", status.alias("status"), "protection_level", "source_type")
    return fold_log(state, given, "id", edit_step, _EDIT).select(*edits.columns, *[c for c in _EDIT.names if c not in edits.columns])


def history_rows(outcomes: DataFrame) -> DataFrame:
    """What each applied edit has replaced: id, version, content, seq."""
    return outcomes.where("outcome = 'applied'").select("id", (F.col("version_after") - 1).alias("version"), F.col("content_before").alias("content"), "seq")


def current_state(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """id, version and content after all applied edits."""
    last = outcomes.where("outcome = 'applied'").groupBy("id").agg(F.max("version_after").alias("v"), F.max_by("content_after", "version_after").alias("c"))
    return records.join(last, "id", "left").select("id", F.coalesce("v", "version").cast("int").alias("version"), F.coalesce("c", "content").alias("content"))


def edit_tags(records: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(id, remove, add): removed first, then added; the version stays."""
    empty = F.array().cast("array<string>")
    new = F.array_union(F.array_except("tags", F.coalesce("remove", empty)), F.coalesce("add", empty))
    return records.join(changes, "id", "left").select("id", new.alias("tags"), "version")


def publish_units(current: DataFrame, published: DataFrame, new: DataFrame) -> DataFrame:
    """new(memory_id, memory_version, content_hash, unit_index, text) replaces a memory's units if its version and hash are still current."""
    live = current.select(F.col("id").alias("memory_id"), F.col("version").alias("memory_version"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    good = new.join(live, ["memory_id", "memory_version", "content_hash"], "left_semi")
    columns = ["memory_id", "memory_version", "unit_index", "text"]
    return good.select(*columns).unionByName(published.join(good.select("memory_id").distinct(), "memory_id", "left_anti").select(*columns))


def rename_workspace(records: DataFrame, old: str, new: str) -> DataFrame:
    swap = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c))
    return records.withColumns({c: swap(c) for c in ("workspace", "workspace_canonical", "ws")})
