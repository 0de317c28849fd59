"""A table built anew beside the one that is read, brought up to date by its differences, and then put in its place.

A copy is a list of layers: the first holds all rows, each later one the rows of some ranges of ids,
which count instead of what earlier layers have there.  Beside it stands the tree of digests of what the
layers, read back, hold.  ``sync`` compares that tree with one of the source and copies only ranges that differ;
``switch`` needs two equal trees, and one entry of the manifest then changes what readers see.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import compare as C
from factloom.sources.commits import CommitLog


class SideCopy:
    """Rows have a key ``id``; ``line`` tells what must agree.  ``build(rows)`` gives the rows of the new table, with the columns of ``line`` as they are."""

    def __init__(self, spark: SparkSession, path: str, line: Column, build: Callable[[DataFrame], DataFrame] = lambda rows: rows, *, leaf: int = C.LEAF, fanout: int = C.FANOUT, levels: int = C.LEVELS):
        self.spark, self.path, self.line, self.build = spark, path, line, build
        self.leaf, self.fanout, self.levels = leaf, fanout, levels
        self.log = CommitLog(spark, f"{path}/_manifest")

    def state(self) -> dict:
        return self.log.latest()[1] or {"read": [], "beside": [], "tree": []}

    def _save(self, df: DataFrame, label: str) -> str:
        folder = f"{self.path}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def _kept(self, df: DataFrame, label: str) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self._save(df, label))

    def _layer(self, rows: DataFrame) -> str:
        return self._save(self.build(rows).repartitionByRange("id").sortWithinPartitions("id"), "rows")

    def _rows(self, layers: list[dict]) -> DataFrame | None:
        out = None
        for k, layer in enumerate(layers):
            df = self.spark.read.parquet(layer["rows"])
            for later in layers[k + 1 :]:
                gone = self.spark.read.parquet(later["ranges"]).withColumnRenamed("range", "_range")
                df = df.join(gone, F.expr(f"id div {self.leaf}") == F.col("_range"), "left_anti")
            out = df if out is None else out.unionByName(df)
        return out

    def rows(self) -> DataFrame | None:
        """What readers see; None before the first switch."""
        return self._rows(self.state()["read"])

    def _grown(self, bottom: DataFrame) -> list[str]:
        folders = []

        def keep(df: DataFrame, label: str) -> DataFrame:
            folders.append(self._save(df, label))
            return self.spark.read.schema(df.schema).parquet(folders[-1])

        C.grown(bottom, self.fanout, self.levels, keep)
        return folders

    def start(self, source: DataFrame) -> bool:
        """Copy all of the source; a copy that was begun before is dropped."""
        number, now = self.log.latest()
        folder = self._layer(source)
        tree = self._grown(C.leaves(self.spark.read.parquet(folder), self.line, self.leaf))
        return self.log.commit(number, {**(now or self.state()), "beside": [{"rows": folder, "ranges": None}], "tree": tree})

    def _compared(self, source: DataFrame, now: dict) -> DataFrame:
        mine = [self.spark.read.parquet(x) for x in now["tree"]]
        theirs = C.tree(source, self.line, leaf=self.leaf, fanout=self.fanout, levels=self.levels)
        return C.differing(theirs, mine, self.fanout)[0]

    def sync(self, source: DataFrame) -> int:
        """Copy the ranges that differ; how many they were, or -1 if there is no copy or another writer came first."""
        number, now = self.log.latest()
        if now is None or not now["beside"]:
            return -1
        ranges = self._kept(self._compared(source, now), "ranges")
        n = ranges.count()
        if not n:
            return 0
        gone = ranges.withColumnRenamed("range", "_range")
        some = source.where(C.hull(ranges, F.col("id"), self.leaf)).join(gone, F.expr(f"id div {self.leaf}") == F.col("_range"), "left_semi")
        folder = self._layer(some)
        old = self.spark.read.parquet(now["tree"][0]).join(ranges, "range", "left_anti")
        tree = self._grown(old.unionByName(C.leaves(self.spark.read.parquet(folder), self.line, self.leaf)))
        layer = {"rows": folder, "ranges": self._save(ranges, "ranges")}
        return n if self.log.commit(number, {**now, "beside": [*now["beside"], layer], "tree": tree}) else -1

    def switch(self, source: DataFrame) -> bool:
        """Let readers see the copy, if it holds what the source holds now."""
        number, now = self.log.latest()
        if now is None or not now["beside"] or not self._compared(source, now).isEmpty():
            return False
        return self.log.commit(number, {"read": now["beside"], "beside": [], "tree": []})
