"""What the training-data operators share: word classes, the shared scratch folder, blocks of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Hashed slots, 64 to a word, that mark keys: at most 2^20 words of 16 bytes are broadcast, whatever the input's size.
SLOTS = 1 << 26

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="millrace-"))
    return _own_dir[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later step reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


_written: list[str] = []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


@contextmanager
def discarding(spark: SparkSession):
    """Delete what is materialised inside, but for the frames put into the list that is yielded."""
    start, kept = len(_written), []
    yield kept
    stay = {df.scratch_path for df in kept}
    for path in _written[start:]:
        if path not in stay:
            drop_path(spark, path)
    _written[start:] = [p for p in _written[start:] if p in stay]


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sums_before(rows: DataFrame, order: list, sums: dict[str, Column], label: str) -> DataFrame:
    """The rows with, for each name, the sum over the rows before in a total order, and `<name>_all`, that over all rows.

    A range sort deals the rows; only a row of sums for each of its parts meets in one task.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = materialise(rows.withColumns({f"{n}__": c for n, c in sums.items()}).orderBy(*order).withColumns({"part__": F.spark_partition_id(), "at__": at}), label)
    every = Window.partitionBy(F.lit(0)).orderBy("part__")
    parts = kept.groupBy("part__").agg(*[F.sum(f"{n}__").alias(f"{n}__") for n in sums])
    before = [F.coalesce(F.sum(f"{n}__").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{n}_base") for n in sums]
    whole = [F.sum(f"{n}__").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{n}_all") for n in sums]
    parts = parts.select("part__", *before, *whole)
    within = Window.partitionBy("part__").orderBy("at__").rowsBetween(Window.unboundedPreceding, -1)
    own = [(F.col(f"{n}_base") + F.coalesce(F.sum(f"{n}__").over(within), F.lit(0))).alias(n) for n in sums]
    return kept.join(F.broadcast(parts), "part__").select(*rows.columns, *own, *[f"{n}_all" for n in sums])


def told_apart(docs: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose key surely isn't in ids' `__gone`, and the rest, told apart by a broadcast bitmap of bounded size."""
    bit = F.expr("shiftleft(1L, cast(__slot & 63 as int))")
    words = ids.select(F.xxhash64("__gone").bitwiseAND(F.lit(SLOTS - 1)).alias("__slot"))
    words = words.groupBy(F.shiftright("__slot", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(docs[key]).bitwiseAND(F.lit(SLOTS - 1)).alias("__slot"))
    marked = rows.join(F.broadcast(words), F.shiftright("__slot", 6) == F.col("__word"), "left")
    doubtful = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    return tuple(marked.filter(x).select("row.*") for x in (~doubtful, doubtful))


def blocks(batches, column: str, limit: int = 1 << 20):
    """Slices of Arrow batches of at most about `limit` bytes of text each (a longer text is a slice of its own)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        block = np.cumsum(np.asarray(size, dtype=np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)
    release()


@contextmanager
def no_collection():
    """No search for cycles in the block: what it makes has none, but is so much that the search is set off again and again."""
    import gc

    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def release() -> None:
    """Give a worker's freed memory back to the system: workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
