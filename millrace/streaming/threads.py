"""Threads (conversations, users) as keyed state of a stream: what was said last, and sessions that end when nothing more comes."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.streaming.incremental import files_stream

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_in_rocksdb(spark: SparkSession):
    """Arbitrary state needs this store; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class LastSaid(StatefulProcessor):
    """Of each key the number of its rows, and the value that is last by `at`; a row for each key that a batch changes."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("thread", "turns long, at long, last string")

    def handleInputRows(self, key, rows, timerValues):
        turns, at, last = self.state.get() if self.state.exists() else (0, None, None)
        for part in rows:
            turns += len(part)
            newest = part.iloc[int(part["at"].to_numpy().argmax())]
            if at is None or int(newest["at"]) >= at:
                at, last = int(newest["at"]), newest["last"]
        self.state.update((turns, at, last))
        yield pd.DataFrame({self.key: [key[0]], "turns": [turns], "last": [last]})

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """A key's rows in sessions: one ends when the next row comes more than `idle` milliseconds later, or when the watermark has
    passed that time. An ended session is given out once and forgotten; the key then starts anew."""

    def __init__(self, key: str, idle: int):
        self.key, self.idle = key, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "began long, ended long, turns long")

    def _row(self, key, session):
        return (key[0], *session)

    def _frame(self, rows):
        return pd.DataFrame(rows, columns=[self.key, "began", "ended", "turns"])

    def handleInputRows(self, key, rows, timerValues):
        session, done = (self.state.get() if self.state.exists() else None), []
        if session is not None:
            self.handle.deleteTimer(session[1] + self.idle + 1)
        for at in sorted(int(x) for part in rows for x in part["at"]):
            if session is not None and at - session[1] > self.idle:
                done.append(self._row(key, session))
                session = None
            session = (at, at, 1) if session is None else (min(at, session[0]), max(at, session[1]), session[2] + 1)
        self.state.update(session)
        self.handle.registerTimer(session[1] + self.idle + 1)
        yield self._frame(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        done = []
        if self.state.exists():
            done = [self._row(key, self.state.get())]
            self.state.clear()
        yield self._frame(done)

    def close(self) -> None:
        pass


def latest_state(spark: SparkSession, folder: str, schema, key: str, value: str, order: str, checkpoint: str, sink: str) -> DataFrame:
    """key, turns, last: the newest value of each key by `order` (a number), kept in the state store between runs; the changed keys
    of each batch go to a log of batches, whose newest row of a key counts."""
    kind = next(f.dataType.simpleString() for f in schema.fields if f.name == key)
    rows = files_stream(spark, folder, schema).select(key, F.col(order).cast("long").alias("at"), F.col(value).alias("last"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    with _state_in_rocksdb(spark):
        state = rows.groupBy(key).transformWithStateInPandas(LastSaid(key), f"{key} {kind}, turns long, last string", "Update", "None")
        state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    log = spark.read.parquet(sink)
    return log.groupBy(key).agg(F.max_by(F.struct("turns", "last"), "batch").alias("s")).select(key, "s.turns", "s.last")


def sessions(spark: SparkSession, folder: str, schema, key: str, time: str, idle: int, delay: int, checkpoint: str, sink: str) -> DataFrame:
    """key, began, ended (milliseconds since 1970), turns of the sessions that have ended, of all runs with this checkpoint.

    Rows may come up to `delay` milliseconds late. A session that may still grow stays in the state store until a later run."""
    kind = next(f.dataType.simpleString() for f in schema.fields if f.name == key)
    stamp = F.col(time).cast("timestamp")
    rows = files_stream(spark, folder, schema).select(key, stamp.alias("time"), F.unix_millis(stamp).alias("at")).withWatermark("time", f"{delay} milliseconds")
    with _state_in_rocksdb(spark):
        ended = rows.groupBy(key).transformWithStateInPandas(Sessions(key, idle), f"{key} {kind}, began long, ended long, turns long", "Append", "EventTime")
        ended.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.parquet(sink)
