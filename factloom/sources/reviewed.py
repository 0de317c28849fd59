"""Snapshots of the workspace registry as somebody has reviewed it, and what has come since."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.vector import DEFAULT_TERMS
from factloom.sources.commits import CommitLog

#: Most names of an explicit list, and most characters of a name or a reason.
MOST_NAMES, MOST_CHARACTERS = 100, 2_000


class ReviewedRegistry:
    """Snapshots in a folder: each is a table of names, and an entry of a commit log that says where it lies; the last one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path, self._log = spark, path, CommitLog(spark, f"{path}/log")

    @staticmethod
    def _proper(names: DataFrame) -> DataFrame:
        return names.select(F.trim("name").alias("name")).where(F.col("name").isNotNull() & ~F.lower("name").isin(*DEFAULT_TERMS)).distinct()

    def confirm(self, registry: DataFrame, names: list[str] | None = None, reason: str | None = None, authorized: bool = False) -> dict:
        """Record the whole registry(name), or the names given, as reviewed; gives outcome and count.

        Outcomes: ``confirmed``, ``not_authorized``, ``invalid_input`` (names that are no list of at most 100 strings of at
        most 2,000 characters), ``concurrent`` (another snapshot was taken meanwhile; nothing is changed).  Only this
        changes a snapshot, never a review.
        """
        if authorized is not True:
            return {"outcome": "not_authorized", "count": 0}
        if names is not None:
            if not isinstance(names, list) or len(names) > MOST_NAMES or any(not isinstance(n, str) or len(n) > MOST_CHARACTERS for n in names):
                return {"outcome": "invalid_input", "count": 0}
            registry = self._spark.createDataFrame([(n,) for n in names], "name string")
        number, _ = self._log.latest()
        place = f"{self._path}/names-{uuid.uuid4().hex}"
        self._proper(registry).write.parquet(place)
        count = self._spark.read.schema("name string").parquet(place).count()
        entry = {"place": place, "count": count, "confirmed_at": datetime.now(timezone.utc).isoformat(), "reason": (reason or "").strip()[:MOST_CHARACTERS] or None}
        return {"outcome": "confirmed" if self._log.commit(number, entry) else "concurrent", "count": count}

    def names(self) -> DataFrame:
        """The names of the last snapshot; none before the first."""
        _, entry = self._log.latest()
        if entry is None:
            return self._spark.createDataFrame([], "name string")
        return self._spark.read.schema("name string").parquet(entry["place"])

    def unreviewed(self, registry: DataFrame) -> DataFrame:
        """name of the registry's names that the last snapshot lacks; names that are gone since don't matter, nor does the common pool."""
        return self._proper(registry).join(self.names(), "name", "left_anti")

    def finding(self, registry: DataFrame) -> DataFrame:
        """One row: check, passed, severity, confirmed, current, new."""
        current = self._proper(registry).select("name", F.lit(1).alias("current"))
        both = current.join(self.names().select("name", F.lit(1).alias("confirmed")), "name", "full")
        counts = both.agg(F.count("confirmed").alias("confirmed"), F.count("current").alias("current"), F.count_if(F.col("confirmed").isNull()).alias("new"))
        passed = F.col("new") == 0
        return counts.select(F.lit("workspace.review").alias("check"), passed.alias("passed"), F.when(passed, "ok").otherwise("warning").alias("severity"), "confirmed", "current", "new")
