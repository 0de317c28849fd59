"""What the training-data operators share: tables, the shared folder, appended columns."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parents[2]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark so that any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session names none (tests on one machine) a local one is made.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """The rows of df as a table in the shared folder: lineage is cut and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() gave, once nothing that is still to be computed reads them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_HELD: dict = {}


def worker_value(key, build: Callable):
    """build(), once a worker process, and kept until another key is asked for.

    A worker that goes on to the next stage does not carry the last one's tables along.
    """
    if key not in _HELD:
        drop_worker_value()
        _HELD[key] = build()
    return _HELD[key]


def drop_worker_value() -> None:
    """Give back what the worker holds from another stage, to the system too where its allocator can."""
    if not _HELD:
        return
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def ship_package(spark: SparkSession) -> None:
    """Ready the session for tasks that run this package's Python.

    Batches of texts are kept small (2,000 rows and 8 MB, unless the session has set less), and the
    package is sent to the executors when their Python would not find it by itself.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= 2_000:
        spark.conf.set(rows, "2000")
    if spark.conf.get(size, "64m") in ("64m", "67108864b"):  # as Spark has it
        spark.conf.set(size, "8m")
    places = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in places or os.path.realpath(os.getcwd()) == str(ROOT):
        return
    if getattr(spark.sparkContext, "_factloom_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "factloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "factloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._factloom_shipped = True


def append_columns(
    df: DataFrame,
    columns: dict[str, T.DataType],
    factory: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """df with columns computed batch by batch in Python.

    ``factory()`` is called once a partition and gives a function from a record batch to the new
    columns, in order.  A column of df that has the name of a new one is replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in columns]
    schema = T.StructType(kept + [T.StructField(k, v) for k, v in columns.items()])
    names = [f.name for f in kept]
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = factory()
        for batch in batches:
            if not batch.num_rows:
                continue
            new = compute(batch)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + new, names=names + list(columns))

    return df.mapInArrow(run, schema)


def narrowed(x: np.ndarray) -> bytes:
    """Whole numbers as bytes of the narrowest of 16, 32 and 64 bits that holds them all."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return x.astype(kind).tobytes()


def opened(numbers: bytes, n: int, width: int) -> np.ndarray:
    """What narrowed() made of n rows."""
    return np.frombuffer(numbers, f"i{len(numbers) // (n * width)}").reshape(n, width)


#: Most numbers of a slot's vectors, which a task holds; tasks to deal out, if there are so many groups and blocks.
SLOT_NUMBERS, TASKS = 1 << 24, 48


def slots_and_shards(n: int, n_asked: int, width: int, block_rows: int, group_rows: int, blocks_a_slot: int) -> tuple[int, int]:
    """Into how many slots n rows are dealt, and into how many shards those that are asked."""
    slots = max(1, -(-n // (block_rows * blocks_a_slot)), -(-n * width // SLOT_NUMBERS), min(8, -(-n // block_rows)))
    return slots, max(1, min(-(-n_asked // group_rows), -(-TASKS // slots)))


def met(asked: DataFrame, blocks: DataFrame, slots: int, shards: int) -> DataFrame:
    """Each shard of asked(shard, ...) and each slot of blocks(slot, ...) in one task: task, the slot's blocks, and then (is_asked) the shard's rows.

    It is no join, so neither side can be broadcast through the driver.  Columns of the other side are null.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    sent = asked.select("*", every(slots).alias("slot"), F.lit(True).alias("is_asked"))
    both = blocks.select("*", every(shards).alias("shard"), F.lit(False).alias("is_asked")).unionByName(sent, allowMissingColumns=True)
    both = both.withColumn("task", (F.col("slot") * shards + F.col("shard")).cast("int")).drop("slot", "shard")
    return both.repartitionById(slots * shards, "task").sortWithinPartitions("task", "is_asked")


def fold(column: str) -> F.Column:
    """The column with A-Z lower-cased and every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: F.Column, by: int) -> F.Column:
    """crc32 of doc_id as text, mod by: the rule by which rows are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def keep_matching(df: DataFrame, wanted: DataFrame, on: list[str], most: int = 1_000_000) -> DataFrame:
    """df joined with wanted on equal columns (null equals null); wanted is broadcast if it has at most ``most`` rows."""
    names = {c: f"__{c}" for c in on}
    side = wanted.withColumnsRenamed(names)
    if wanted.select(on[0]).limit(most + 1).count() <= most:
        side = F.broadcast(side)
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(names[c]))
    return df.join(side, match).drop(*names.values())
