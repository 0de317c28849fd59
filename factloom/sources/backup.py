"""Backups as JSON lines: read with their places, checked page by page, replayed once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.commits import written

# Fixed values of the format.
MOST_BYTES = 3 * 1024 * 1024
MOST_LINES = 10_000
MOST_KEY = 200
MOST_NAME = 2_000


def payload_hash(text: str | None) -> str | None:
    """sha256 of the parts of an envelope that are replayed, with sorted keys and no blanks; null of what is no object."""
    try:
        given = json.loads(text) if text is not None else None
    except ValueError:
        return None
    if not isinstance(given, dict):
        return None
    parts = {k: given.get(k) for k in ("backup_schema", "workspace_canonical", "record")}
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode("utf-8", "surrogatepass")).hexdigest()


def read_lines(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """file, line (from 1, over all files in the order of their paths), offset (bytes before it in its file), bytes,
    value (null if too long or no UTF-8), fault, payload_hash.

    Files are split as Spark splits them.  Each split counts its own lines and bytes as it streams them; a first pass
    over lengths alone gives what lies before each split, a row a split.  A line that is too long is read once by
    the scan and goes no further.
    """
    split = ["file", "block"]
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.octet_length("value").cast("long").alias("bytes"), "value")
    counted = raw.groupBy(*split).agg(F.count("*").alias("lines"), F.sum(F.col("bytes") + 1).alias("size"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("file").orderBy("block")
    files = counted.groupBy("file").agg(F.sum("lines").alias("lines"))
    starts = files.select("file", before("lines", Window.orderBy("file")).alias("files_before"))
    counted = counted.withColumns({"lines_before": before("lines", inside), "size_before": before("size", inside)})
    places = written(counted.join(starts, "file").select(*split, (F.col("lines_before") + F.col("files_before")).alias("line0"), F.col("size_before").alias("offset0")), "splits")
    fault = F.when(F.col("bytes") > most_bytes, "too_long").when(~F.is_valid_utf8("value"), "invalid_utf8")
    marked = raw.withColumn("fault", fault).withColumn("value", F.when(F.col("fault").isNull(), F.col("value")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k, at = None, 0, 0
        for b in batches:
            ks, ats = [], []
            for here in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("bytes").to_pylist()):
                if here[:2] != now:
                    now, k, at = here[:2], 0, 0
                k += 1
                ks.append(k)
                ats.append(at)
                at += here[2] + 1
            hashes = [payload_hash(x) for x in b.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ks, pa.int64()), pa.array(ats, pa.int64()), pa.array(hashes, pa.string())], names=[*b.schema.names, "k", "at", "payload_hash"])

    schema = "file string, block long, bytes long, value string, fault string, k long, at long, payload_hash string"
    lines = marked.mapInArrow(count, schema).join(places, split)
    return lines.select("file", (F.col("line0") + F.col("k")).alias("line"), (F.col("offset0") + F.col("at")).alias("offset"), "bytes", "value", "fault", "payload_hash")


def _faults(v: Column) -> tuple[Column, Column]:
    """What is wrong with an envelope before and after its key is looked for among those of its page."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    is_ = lambda path, name: F.coalesce(kind(path) == name, F.lit(False))
    text = lambda path: F.when(is_(path, "STRING"), F.try_variant_get(v, path, "string"))
    filled = lambda x, most: F.coalesce((F.regexp_replace(x, r"(?U)\s+", "") != "") & (F.length(x) <= most), F.lit(False))
    object_ = lambda k: F.coalesce(F.startswith(k, F.lit("OBJECT")), F.lit(False))
    first = (
        F.when(v.isNull(), "invalid_json").when(~object_(F.schema_of_variant(v)), "not_an_object").when(kind("$.backup_schema").isNull(), "no_schema")
        .when(~(is_("$.backup_schema", "BIGINT") & (F.try_variant_get(v, "$.backup_schema", "long") == 1)), "unsupported_schema")
        .when(~filled(text("$.replay_key"), MOST_KEY), "invalid_replay_key").when(F.expr("try_cast(_at as timestamp)").isNull(), "invalid_written_at")
    )
    then = (
        F.when(~object_(kind("$.record")), "record_not_an_object").when(~filled(text("$.record.content"), 1 << 30), "invalid_record")
        .when(~filled(text("$.workspace_canonical"), MOST_NAME), "invalid_workspace")
    )
    return first, then


def inspect(lines: DataFrame, receipts: DataFrame, page: int = 1_000) -> DataFrame:
    """Lines of read_lines to page, file, line, offset, bytes, replay_key, workspace_canonical, payload_hash, status, reason; no texts.

    Pages are runs of ``page`` lines (at most 10,000).  The first line of a page with a replay key counts, others are
    ``duplicate_in_page``; a key of a line that fails later on counts as seen.  receipts(replay_key, payload_hash) of
    earlier replays give ``already_replayed`` or, with another hash, ``receipt_hash_conflict``; the rest is
    ``importable`` or ``invalid``.  JSON with a key twice in an object is invalid.
    """
    page = max(1, min(page, MOST_LINES))
    v = F.try_parse_json("value")
    parsed = lines.withColumn("_v", v).withColumn("_at", F.try_variant_get("_v", "$.backup_written_at", "string"))
    first, then = _faults(F.col("_v"))
    text = lambda path: F.try_variant_get("_v", path, "string")
    told = parsed.select(
        F.expr(f"(line - 1) div {page}").alias("page"), "file", "line", "offset", "bytes", text("$.replay_key").alias("replay_key"), text("$.workspace_canonical").alias("workspace_canonical"),
        "payload_hash", F.coalesce("fault", first).alias("early"), then.alias("late"))
    told = written(told, "inspected")
    seen = told.where("early is null").groupBy("page", "replay_key").agg(F.min("line").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = receipts.groupBy("replay_key").agg(F.first("payload_hash").alias("known"))
    joined = told.join(seen, ["page", "replay_key"], "left").join(known, "replay_key", "left")
    reason = F.coalesce("early", F.when(F.col("line") > F.col("first"), "duplicate_in_page"), "late")
    status = (
        F.when(reason.isNotNull(), "invalid").when(F.col("known").isNull(), "importable")
        .when(F.col("known") == F.col("payload_hash"), "already_replayed").otherwise("receipt_hash_conflict")
    )
    return joined.select("page", "file", "line", "offset", "bytes", "replay_key", "workspace_canonical", "payload_hash", status.alias("status"), reason.alias("reason"))


def replay(lines: DataFrame, inspected: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame]:
    """What a replay of the inspected lines adds: records(id, replay_key, workspace_canonical, payload_hash, record as JSON) and the outcome of every line that isn't invalid.

    Of importable lines with one key, on different pages, the first is ``imported``; later ones meet its receipt.  Records with their hashes are
    the receipts of later replays, so a second replay adds nothing.  Ids go up with the lines, without gaps.
    """
    firsts = inspected.where("status = 'importable'").groupBy("replay_key").agg(F.min("line").alias("first"), F.min_by("payload_hash", "line").alias("hash"))
    good = inspected.where("status <> 'invalid'").join(firsts, "replay_key", "left")
    outcome = (
        F.when(F.col("status") != "importable", F.col("status")).when(F.col("line") == F.col("first"), "imported")
        .when(F.col("payload_hash") == F.col("hash"), "already_replayed").otherwise("receipt_hash_conflict")
    )
    outcomes = written(good.select("page", "line", "replay_key", "workspace_canonical", "payload_hash", outcome.alias("outcome")), "replayed")
    new = outcomes.where("outcome = 'imported'").drop("outcome")
    # ids by pages: a page has a bounded number of lines
    pages = new.groupBy("page").count()
    starts = pages.select("page", F.coalesce(F.sum("count").over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = new.join(starts, "page").withColumn("id", F.lit(next_id) + F.col("before") + F.row_number().over(Window.partitionBy("page").orderBy("line")) - 1)
    record = F.to_json(F.try_variant_get(F.try_parse_json("value"), "$.record", "variant"))
    texts = lines.select("line", record.alias("record"))
    return placed.join(texts, "line").select(F.col("id").cast("long").alias("id"), "replay_key", "workspace_canonical", "payload_hash", "record"), outcomes


def append(rows: DataFrame, path: str) -> None:
    """rows(replay_key, backup_written_at, workspace_canonical, record as a struct) as further lines of a backup."""
    line = F.to_json(F.struct(F.lit(1).alias("backup_schema"), "replay_key", "backup_written_at", "workspace_canonical", "record"))
    rows.select(line.alias("value")).write.mode("append").option("lineSep", "\n").text(path)
