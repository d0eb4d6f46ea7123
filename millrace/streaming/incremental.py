"""Incremental scans on Structured Streaming, scratch folders, and results kept by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import commits


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, deleted when the driver's JVM ends; in a temporary one only where that is unset and
    Spark runs on one machine."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="millrace-"))
        found = _own_dir[0]
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found.rstrip("/") + f"/run-{uuid.uuid4().hex}")
    made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(made)
    return made.toString()


def save_to(spark: SparkSession):
    """A function that writes a DataFrame to the shared folder and reads it back."""
    folder = shared_dir(spark)

    def save(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def files_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of a table that is a folder of files, or one file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def append_stream(spark: SparkSession, folder: str, schema, transform, sink: str, checkpoint: str) -> None:
    """Run all new files of a folder through transform into an append-only Parquet log; reruns take up where they ended."""
    stream = transform(files_stream(spark, folder, schema))
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink).awaitTermination()


def remembered(spark: SparkSession, folder: str, name: str, path: str, build, seconds: float | None = None) -> DataFrame:
    """What build() gave under `name` for the file or folder `path` when it last had its present size and time; built and kept as
    a new version if it never did, or if that was more than `seconds` ago."""
    import hashlib
    import time

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state, size = fs.getFileStatus(hadoop), fs.getContentSummary(hadoop).getLength()
    kept = f"{folder}/{hashlib.sha256(f'{name}|{path}|{state.getModificationTime()}|{size}'.encode()).hexdigest()}"
    number, facts = commits.CommitLog(spark, kept).last()
    if not number or (seconds is not None and time.time() - facts["at"] > seconds):
        commits.replace(kept, rows=build())
    return spark.read.parquet(commits.current(spark, kept, "rows"))
