"""Folders whose contents change by numbered commits: writers add a numbered part, then one small file that makes it count.

A part is `<folder>/<name>/n=<number>`, its commit `<folder>/_commits/<number>.json`, renamed into place when it is whole.
Readers see the parts of commits only, so a part that a broken run left behind is neither read nor in the way of the run
that does it again. Nothing that is committed is written again: logs grow by parts, snapshots by versions.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType


class CommitLog:
    """The commits of a folder. One writer at a time: a second one's commit of the same number fails."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commit_path(self, number: int):
        return self._path(f"{self.folder}/_commits/{number:012d}.json")

    def numbers(self) -> list[int]:
        """Numbers of the commits, rising."""
        place = self._path(f"{self.folder}/_commits")
        names = [s.getPath().getName() for s in self.fs.listStatus(place)] if self.fs.exists(place) else []
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit())

    def facts(self, number: int) -> dict:
        """What a commit says."""
        stream = self.fs.open(self._commit_path(number))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def last(self) -> tuple[int, dict]:
        """The newest commit's number and facts; 0 and none without commits."""
        found = self.numbers()
        return (found[-1], self.facts(found[-1])) if found else (0, {})

    def part(self, name: str, number: int) -> str:
        return f"{self.folder}/{name}/n={number}"

    def write(self, rows: DataFrame, name: str, number: int, format: str = "parquet", by: tuple[str, ...] = ()) -> str:
        """Write a part that counts once its number is committed; one of a broken run is replaced."""
        path = self.part(name, number)
        writer = rows.write.mode("overwrite").format(format)
        (writer.partitionBy(*by) if by else writer).save(path)
        return path

    def commit(self, number: int, **facts) -> None:
        """Make the parts of a number count."""
        to, new = self._commit_path(number), self._path(f"{self.folder}/_commits/.{uuid.uuid4().hex}")
        if self.fs.exists(to):
            raise FileExistsError(f"{to} is committed already")
        out = self.fs.create(new, False)
        try:
            out.write(json.dumps({"at": time.time(), **facts}).encode())
        finally:
            out.close()
        if not self.fs.rename(new, to):
            self.fs.delete(new, False)
            raise OSError(f"{to} was not committed")

    def read(self, name: str, schema: StructType, upto: int | None = None) -> DataFrame:
        """All committed rows of a log, with the number `n` of their part."""
        upto = self.last()[0] if upto is None else upto
        place, kinds = f"{self.folder}/{name}", StructType([*schema.fields])
        if not self.fs.exists(self._path(place)):
            return self.spark.createDataFrame([], kinds.add("n", LongType()))
        return self.spark.read.schema(kinds.add("n", LongType())).parquet(place).filter(F.col("n") <= upto)

    def drop(self, number: int, *names: str) -> None:
        """Delete a commit, then its parts."""
        self.fs.delete(self._commit_path(number), False)
        for name in names:
            self.fs.delete(self._path(self.part(name, number)), True)


def replace(folder: str, format: str = "parquet", by: tuple[str, ...] = (), retain: float = 600.0, **tables: DataFrame) -> int:
    """A new version of a snapshot: all its tables change at once, by one commit. Versions that gave way more than `retain`
    seconds ago are deleted, so that readers that found one have that long to read it."""
    log = CommitLog(next(iter(tables.values())).sparkSession, folder)
    numbers = log.numbers()
    number = (numbers[-1] if numbers else 0) + 1
    for name, rows in tables.items():
        log.write(rows, name, number, format, by)
    log.commit(number, tables=sorted(tables))
    for old, successor in zip(numbers, numbers[1:]):
        if time.time() - log.facts(successor)["at"] > retain:
            log.drop(old, *log.facts(old)["tables"])
    return number


def current(spark: SparkSession, folder: str, name: str) -> str:
    """The path of a table of the newest version."""
    log = CommitLog(spark, folder)
    number, facts = log.last()
    if name not in facts.get("tables", ()):
        raise FileNotFoundError(f"{folder} has no version of {name}")
    return log.part(name, number)
