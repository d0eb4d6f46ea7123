"""Streams with state and the source of growing logs: restarts, expiry, and lines that are told once."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import logtail
from millrace.streaming import threads


def put(spark, rows, folder, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_last_said_over_restarts(spark, tmp_path):
    folder, schema = f"{tmp_path}/in", "thread string, turn int, text string"
    ask = lambda: {r.thread: (r.turns, r.last) for r in threads.latest_state(spark, folder, spark.read.parquet(folder).schema, "thread", "text", "turn", f"{tmp_path}/state", f"{tmp_path}/log").collect()}
    put(spark, [("a", 1, "x"), ("a", 3, "z"), ("b", 1, None)], folder, schema)
    assert ask() == {"a": (2, "z"), "b": (1, None)}
    put(spark, [("a", 2, "late"), ("b", 2, "y"), ("c", 1, "new")], folder, schema)
    assert ask() == {"a": (3, "z"), "b": (2, "y"), "c": (1, "new")}
    assert ask() == {"a": (3, "z"), "b": (2, "y"), "c": (1, "new")}  # nothing new
    assert not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider")


def test_sessions_end_by_gap_or_by_timer_and_start_anew(spark, tmp_path):
    folder, schema = f"{tmp_path}/in", "user long, ms long"

    def run(*rows):
        spark.createDataFrame(list(rows), schema).select("user", F.timestamp_millis("ms").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
        made = threads.sessions(spark, folder, spark.read.parquet(folder).schema, "user", "ts", 100, 10, f"{tmp_path}/state", f"{tmp_path}/log")
        return sorted((r.user, r.began, r.ended, r.turns) for r in made.collect())

    assert run((1, 1000), (1, 1100), (1, 1300), (2, 1250)) == [(1, 1000, 1100, 2)]  # a gap; the others may still grow
    assert run((1, 1390), (3, 1395)) == [(1, 1000, 1100, 2), (2, 1250, 1250, 1)]  # the state of user 1 was kept, a timer ended user 2's
    assert run((2, 5000), (2, 5001)) == [(1, 1000, 1100, 2), (1, 1300, 1390, 2), (2, 1250, 1250, 1), (3, 1395, 1395, 1)]


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_log_lines_by_ranges(spark, tmp_path, size):
    logtail.register(spark)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.log").write_bytes("one\n\nthree é\n".encode() + b"x" * 70000 + b"\nnot whole")
    (tmp_path / "sub" / "b.log").write_bytes(b"\xff\n")
    (tmp_path / "c.txt").write_bytes(b"other\n")
    (tmp_path / "_hidden.log").write_bytes(b"no\n")
    if size < 100:
        (tmp_path / "a.log").write_bytes("one\n\nthree é\nnot whole".encode())
    rows = spark.read.format("log_lines").option("suffix", ".log").option("range_bytes", size).load(str(tmp_path)).collect()
    want = ["", "one", "three é"] + (["x" * 70000] if size > 100 else []) + ["�"]
    assert sorted(r.value for r in rows) == sorted(want)
    for r in rows:
        with open(r.path, "rb") as f:
            f.seek(r.at)
            assert f.readline()[:-1].decode("utf-8", "replace") == r.value
    assert spark.read.format("log_lines").load(f"{tmp_path}/none").count() == 0


def test_appended_lines_are_told_once(spark, tmp_path):
    logtail.register(spark)
    log = tmp_path / "in" / "a.log"
    log.parent.mkdir()

    def told():
        stream = spark.readStream.format("log_lines").option("range_bytes", 3).load(str(log.parent))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted(r.value for r in spark.read.parquet(f"{tmp_path}/out").collect())

    log.write_bytes(b"one\ntwo\nthr")
    assert told() == ["one", "two"]
    with open(log, "ab") as f:
        f.write(b"ee\n")
    (log.parent / "b.log").write_bytes(b"four\n")
    assert told() == ["four", "one", "three", "two"]
    assert told() == ["four", "one", "three", "two"]
