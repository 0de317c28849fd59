"""Durable small states: a log of numbered entries in which each number is written once.

A writer reads the latest entry, decides, and commits its own under the next number; if another
has taken that number meanwhile, the commit fails and changes nothing.  So every entry follows from
the one before it.  Entries are small; what they speak of (tables) lies in folders that they name.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only where none is set and all is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: made once, and there still if executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class CommitLog:
    """Numbered entries in a folder of any file system that Spark knows; entries are dictionaries that JSON can hold.

    An entry is written aside and then renamed to its number, which fails if that is there already.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._folder = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._folder.getFileSystem(self._conf)
        self._fs.mkdirs(self._folder)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._folder, name)

    def numbers(self) -> list[int]:
        names = (f.getPath().getName() for f in self._fs.listStatus(self._folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{number:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        """The last number and its entry; 0 and None before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)

    def commit(self, after: int, entry: dict) -> bool:
        """Whether the entry was written as the one after ``after``."""
        aside = self._path(f".{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(entry, ensure_ascii=False, sort_keys=True).encode()))
        stream.close()
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._gateway.new_array(kinds, 1)
        how[0] = kinds.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._path(f"{after + 1:012d}.json")), how)
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True
