"""Evidence units of one embedding space, rebuilt beside the old ones when the space changes.

The index is a set of folders that a manifest names.  A rebuild writes units of the target space in
batches to folders of their own; readers go on to see those of the active space.  A memory is pending while no
batch of the rebuild holds units of its present version, which an anti join finds; what a stopped
run has committed is not done again.  When nothing is pending, one entry of the manifest
switches all readers over.  A change of the target starts anew, and going back to the active space drops
what was rebuilt.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.segment import segment
from factloom.sources.commits import CommitLog, written

#: Columns of an index: those of a unit, its vector, and the batch it came with.
COLUMNS = ["memory_id", "memory_version", "unit_index", "kind", "text", "start_offset", "end_offset", "embedding", "batch"]
_SCHEMA = "memory_id long, memory_version int, unit_index int, kind string, text string, start_offset int, end_offset int, embedding array<double>, batch long"


def indexable(records: DataFrame) -> DataFrame:
    """Records that give a unit: not deleted, with something but blanks in subject or content."""
    text = F.concat(F.coalesce("subject", F.lit("")), F.coalesce("content", F.lit("")))
    return records.where((F.col("status") != "deleted") & text.rlike(r"(?U)\S"))


def pending(records: DataFrame, units: DataFrame) -> DataFrame:
    """id of each indexable record of which ``units`` hold none in its present version."""
    has = units.select(F.col("memory_id").alias("id"), F.col("memory_version").alias("version")).distinct()
    return indexable(records).join(has, ["id", "version"], "left_anti").select("id")


class SpaceIndex:
    """encode(units) gives the units with ``embedding``; it is called on a batch of units as a DataFrame."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.log = CommitLog(spark, f"{path}/_manifest")

    def state(self) -> dict:
        none = {"state": "unmanaged", "space": None, "folders": [], "target": None, "epoch": None, "rebuilt": []}
        return self.log.latest()[1] or none

    def _read(self, folders: list[str]) -> DataFrame:
        """The units of the folders; of a memory only those of the last batch that holds any."""
        if not folders:
            return self.spark.createDataFrame([], _SCHEMA)
        every = self.spark.read.schema(_SCHEMA).parquet(*folders)
        last = F.max("batch").over(Window.partitionBy("memory_id"))
        return every.withColumn("last", last).where("batch = last").select(*COLUMNS)

    def units(self) -> DataFrame:
        """What readers see: the active space, whole."""
        return self._read(self.state()["folders"])

    def rebuilt(self) -> DataFrame:
        return self._read(self.state()["rebuilt"])

    def start(self, space: str) -> bool:
        """Take ``space`` as the one to be in; True if the manifest has changed.

        An index without any folder is in it at once.  The active space ends a rebuild and drops its batches; the
        target that is being built goes on; another one starts anew, with a new epoch.
        """
        number, now = self.log.latest()
        now = now or self.state()
        if now["space"] == space:
            if now["state"] == "ready":
                return False
            new = {**now, "state": "ready", "target": None, "epoch": None, "rebuilt": []}
        elif now["state"] == "mismatch" and now["target"] == space:
            return False
        elif not now["folders"]:
            new = {**now, "state": "ready", "space": space, "target": None, "epoch": None, "rebuilt": []}
        else:
            new = {**now, "state": "mismatch", "target": space, "epoch": uuid.uuid4().hex, "rebuilt": []}
        return self.log.commit(number, new)

    def publish(self, records: DataFrame, encode: Callable[[DataFrame], DataFrame], space: str) -> bool:
        """Units of records(id, version, subject, content) as a batch of the active space, or of the rebuild if that is for ``space``.

        False, and nothing is seen of it, if the index is for another space or has changed meanwhile.
        """
        number, now = self.log.latest()
        if now is None or space != (now["target"] if now["state"] == "mismatch" else now["space"]):
            return False
        folder = f"{self.path}/units-{uuid.uuid4().hex}"
        encode(segment(records)).withColumn("batch", F.lit(number + 1).cast("long")).select(*COLUMNS).write.parquet(folder)
        part = "rebuilt" if now["state"] == "mismatch" else "folders"
        return self.log.commit(number, {**now, part: [*now[part], folder]})

    def pending(self, records: DataFrame) -> DataFrame:
        """What still has to be published, in a rebuild or out of one."""
        return pending(records, self.rebuilt() if self.state()["state"] == "mismatch" else self.units())

    def step(self, records: DataFrame, encode: Callable[[DataFrame], DataFrame], space: str, batch: int = 100_000) -> bool:
        """Publish the next pending records, in order of their ids; False if none were, or another writer came first."""
        ids = written(self.pending(records).orderBy("id").limit(batch), "pending")  # looked for once
        return not ids.isEmpty() and self.publish(records.join(ids, "id", "left_semi"), encode, space)

    def complete(self, records: DataFrame, space: str) -> bool:
        """Switch readers to the rebuilt space, if nothing is pending there and it is still the target."""
        number, now = self.log.latest()
        if now is None or now["state"] != "mismatch" or now["target"] != space or pending(records, self._read(now["rebuilt"])).limit(1).count():
            return False
        return self.log.commit(number, {**now, "state": "ready", "space": space, "folders": now["rebuilt"], "target": None, "epoch": None, "rebuilt": []})
