"""Queries: the boundary of a scan, what an index still lacks, a rebuild from start to switch, and a scan in pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.plans.registry import query
from factloom.sources.commits import shared_folder, written
from factloom.sources.views import MEMORIES_SQL, UNITS_SQL, memories, units
from factloom.streaming import scan as S
from factloom.streaming.rebuild import SpaceIndex, pending

M = "WITH " + MEMORIES_SQL
_INDEXABLE = "status <> 'deleted' AND regexp_replace(coalesce(subject, '') || coalesce(content, ''), '\\s+', '', 'g') <> ''"


@query("scan_boundary", f"""{M} SELECT id // 10000 AS range, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(id || '@' || version), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM m WHERE status = 'active' GROUP BY ALL""")
def scan_boundary(spark, sf):
    return S.range_digests(memories(spark, sf)).select("range", "n", F.col("digest").cast("string").alias("digest"))


@query("space_pending", f"""{M}, {UNITS_SQL} SELECT id FROM m WHERE {_INDEXABLE} AND NOT EXISTS (SELECT 1 FROM u WHERE u.memory_id = m.id AND u.memory_version = m.version)""")
def space_pending(spark, sf):
    return pending(memories(spark, sf), units(spark, sf))


@query("space_rebuild", f"""{M} SELECT id AS memory_id, version AS memory_version, 'second' AS space, 2.0::DOUBLE AS mark FROM m WHERE {_INDEXABLE}""")
def space_rebuild(spark, sf):
    """All memories indexed in one space, rebuilt in two batches for another, and what readers see after the switch."""
    m = written(memories(spark, sf).select("id", "version", "status", "subject", "content"), "memories")
    encode = lambda mark: lambda u: u.withColumn("embedding", F.array(F.lit(mark), F.length("text").cast("double")))
    index = SpaceIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.start("first")
    index.publish(m.where("status <> 'deleted'"), encode(1.0), "first")
    index.start("second")
    half = m.count() // 2 + 1
    while index.step(m, encode(2.0), "second", batch=half):
        pass
    index.complete(m, "second")
    return index.units().select("memory_id", "memory_version", F.lit(index.state()["space"]).alias("space"), F.col("embedding")[0].alias("mark")).distinct()


@query("scan_pages", f"""{M} SELECT id, version FROM m WHERE status = 'active'""")
def scan_pages(spark, sf):
    """What a scan of all live memories has judged, page by page, once it is over."""
    m = written(memories(spark, sf).select("id", "version", "status"), "memories")
    digests = written(S.range_digests(m), "digests")
    live = S.boundary(m, digests)
    log = S.ScanLog(spark, f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}")
    log.require("rules", live)
    page = live["active_count"] // 3 + 1
    while log.run_page(m, digests, "rules", lambda rows: rows.select("id", "version"), page)["required"]:
        pass
    return log.results()
