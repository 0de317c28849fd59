"""Resumable scans of all live memories: durable progress, pages committed in turn, a new start on drift.

A scan covers the live set as it was when it began: its number of memories, its largest id and a digest of
ids and versions, the boundary.  The digest is a sum over ranges of ids, kept as a table that
changes are added to and taken from, so a page looks at its own rows and at one row for each range.
Pages must follow each other; each is committed by compare-and-set.  If the live set or the detector is no
longer what the scan began with, it starts anew under a new epoch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.commits import CommitLog

#: Ids in one range of the digest table.
RANGE = 10_000


def range_digests(records: DataFrame) -> DataFrame:
    """range, n, digest of the live records(id, version, status): sums of 60 bits of a hash of each id and version."""
    live = records.where("status = 'active'")
    bits = F.conv(F.substring(F.sha2(F.concat_ws("@", F.col("id").cast("string"), F.col("version").cast("string")).cast("binary"), 256), 1, 15), 16, 10)
    return live.groupBy(F.floor(F.col("id") / RANGE).alias("range")).agg(F.count("*").alias("n"), F.sum(bits.cast("decimal(20,0)")).cast("decimal(38,0)").alias("digest"))


def change_digests(digests: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The digests once the rows of ``removed`` have gone and those of ``added`` have come; a changed record is in both."""
    less = range_digests(removed).select("range", (-F.col("n")).alias("n"), (-F.col("digest")).alias("digest"))
    every = digests.unionByName(less).unionByName(range_digests(added))
    summed = every.groupBy("range").agg(F.sum("n").alias("n"), F.sum("digest").cast("decimal(38,0)").alias("digest"))
    return summed.where("n > 0")


def boundary(records: DataFrame, digests: DataFrame) -> dict:
    """The live set's identity, from the digests and the last range's rows."""
    n, digest, last = digests.agg(F.sum("n"), F.sum("digest"), F.max("range")).first()
    if not n:
        return {"active_count": 0, "max_memory_id": 0, "digest": "0"}
    top = records.where((F.col("id") >= last * RANGE) & (F.col("id") < (last + 1) * RANGE) & (F.col("status") == "active"))
    return {"active_count": n, "max_memory_id": top.agg(F.max("id")).first()[0], "digest": str(digest)}


def anchors(records: DataFrame, after: int, page: int) -> DataFrame:
    """The next live records by id."""
    return records.where((F.col("status") == "active") & (F.col("id") > after)).orderBy("id").limit(page)


class ScanLog:
    """The state of one required scan: begun, paged and completed by compare-and-set."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.log = CommitLog(spark, f"{path}/_scan")

    def state(self) -> dict:
        return self.log.latest()[1] or {"required": False}

    def _begun(self, detector: str, live: dict) -> dict:
        return {"required": True, "epoch": uuid.uuid4().hex, "detector": detector, "boundary": live, "progress": None}

    def require(self, detector: str, live: dict) -> bool:
        """Begin a scan, unless one is on its way."""
        number, state = self.log.latest()
        if state and state["required"]:
            return False
        return self.log.commit(number, self._begun(detector, live))

    def rearm_if_drifted(self, detector: str, live: dict) -> bool:
        """Start a scan that is on its way anew, if the live set or the detector has changed since it began."""
        number, state = self.log.latest()
        if not state or not state["required"] or (state["boundary"] == live and state["detector"] == detector):
            return False
        return self.log.commit(number, self._begun(detector, live))

    def record_page(self, epoch: str, detector: str, live: dict, after: int, following: int | None, scanned: int, *, scoped: bool = False, folder: str | None = None) -> bool:
        """Whether the page from ``after`` (excluded) to ``following`` was taken over; following is None with the last page.

        Pages must join without a gap.  A scan that saw only some workspaces (``scoped``) never counts, nor does
        one of another epoch, detector or live set, nor a page after the last.
        """
        number, state = self.log.latest()
        if scoped or not state or not state["required"] or (state["epoch"], state["detector"], state["boundary"]) != (epoch, detector, live):
            return False
        progress = state["progress"] or {"pages": 0, "anchors_scanned": 0, "next_after": 0, "complete": False}
        if progress["complete"] or after != progress["next_after"] or scanned < 0:
            return False
        last = following is None
        if last and not scanned and after < live["max_memory_id"]:
            return False
        if not last and (scanned <= 0 or following <= after):
            return False
        progress = {"pages": progress["pages"] + 1, "anchors_scanned": progress["anchors_scanned"] + scanned, "next_after": live["max_memory_id"] if last else following, "complete": last}
        return self.log.commit(number, {**state, "progress": progress, "folder": folder})

    def complete(self, epoch: str, detector: str, live: dict) -> bool:
        """Whether the scan is over: all anchors of its live set have been seen, and it is still that set."""
        number, state = self.log.latest()
        if not state or not state["required"] or (state["epoch"], state["detector"], state["boundary"]) != (epoch, detector, live):
            return False
        done = state["progress"] or {}
        if not done.get("complete") or done["anchors_scanned"] != live["active_count"] or done["next_after"] != live["max_memory_id"]:
            return False
        return self.log.commit(number, {**state, "required": False, "folder": None})

    def run_page(self, records: DataFrame, digests: DataFrame, detector: str, judge: Callable[[DataFrame], DataFrame], page: int = 50) -> dict:
        """One page: its anchors through ``judge``, what that gives written to a folder, the folder committed.

        A page that is stopped half-way, or that another writer has taken, leaves a folder that no entry names.
        """
        live = boundary(records, digests)
        self.rearm_if_drifted(detector, live)
        state = self.state()
        if not state["required"]:
            return state
        after = (state["progress"] or {"next_after": 0})["next_after"]
        if not (state["progress"] or {}).get("complete"):
            rows = anchors(records, after, page)
            scanned, end = rows.agg(F.count("*"), F.max("id")).first()
            folder = f"{self.path}/epoch={state['epoch']}/after={after}-{uuid.uuid4().hex}"
            judge(rows).write.parquet(folder)
            following = None if end is None or end >= live["max_memory_id"] else end
            self.record_page(state["epoch"], detector, live, after, following, scanned, folder=folder)
        self.complete(state["epoch"], detector, live)
        return self.state()

    def results(self) -> DataFrame | None:
        """What the committed pages of the present epoch gave; None before the first."""
        entries = [self.log.read(n) for n in self.log.numbers()]
        folders = [e["folder"] for e in entries if e.get("folder") and e["epoch"] == entries[-1]["epoch"]]
        return self.spark.read.parquet(*folders) if folders else None
