"""Logs and snapshots by numbered commits, and the crawl and the scan that are kept in them."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from millrace.operators import crawl, inventory, services
from millrace.sources import commits
from millrace.streaming.incremental import remembered, save_to


def pages_of(df):
    return sorted(r["page"] for r in df.collect())


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long").coalesce(1)


def seeds(spark, *pages):
    return spark.createDataFrame([(p,) for p in pages], "page long").coalesce(1)


def test_crawl_ends_with_null_pages_and_cycles(spark, tmp_path):
    edges = edges_of(spark, [(1, 2), (2, None), (None, 3), (2, 1), (2, 4), (4, 4)])
    visited, left = crawl.crawled(seeds(spark, 1, None, 1), edges, f"{tmp_path}/log", save_to(spark))
    assert {(r.page, r.step) for r in visited.collect()} == {(1, 1), (2, 2), (4, 3)} and pages_of(left) == []


def test_crawl_is_first_in_first_out_over_runs(spark, tmp_path):
    pairs = [(0, 9), (0, 5), (9, 1), (5, 2), (5, 9), (2, 0), (1, 7)]
    edges, log = edges_of(spark, pairs), f"{tmp_path}/log"
    order, save = [], save_to(spark)
    for _ in range(10):
        visited, left = crawl.crawled(seeds(spark, 0), edges, log, save, max_pages=1, batch=3)
        order += pages_of(visited)
        if not pages_of(left):
            break
    assert order == [0, 5, 9, 2, 1, 7]
    visited, left = crawl.crawled(seeds(spark, 0), edges, log, save)
    assert pages_of(visited) == pages_of(left) == []


def test_crawl_fetches_each_page_once_and_skips_what_is_done(spark, tmp_path):
    fetched = []

    def links(pages):
        own = pages_of(pages)
        fetched.extend(own)
        return edges_of(spark, [(p, q) for p in own for q in (2 * p, 2 * p + 1) if q < 32] or [(0, None)])

    visited, _ = crawl.crawled(seeds(spark, 1), links, f"{tmp_path}/log", save_to(spark), batch=5, done=seeds(spark, 3, 8))
    assert sorted(fetched) == pages_of(visited) == [p for p in range(1, 32) if not any(p >> k in (3, 8) for k in range(6))]


def test_crawl_log_grows_with_pages_not_with_steps(spark, tmp_path):
    n = 24
    crawl.crawled(seeds(spark, 0), edges_of(spark, [(k, k + 1) for k in range(n)]), f"{tmp_path}/log", save_to(spark))
    for name in ("found", "visited"):
        assert spark.read.parquet(f"{tmp_path}/log/{name}").count() == n + 1


def test_a_broken_step_does_not_count(spark, tmp_path):
    edges, log = edges_of(spark, [(0, 1), (1, 2)]), f"{tmp_path}/log"

    def broken(pages):
        if pages_of(pages) == [1]:
            raise OSError("lost")
        return pages.join(edges, F.col("page") == F.col("src"))

    with pytest.raises(OSError):
        crawl.crawled(seeds(spark, 0), broken, log, save_to(spark))
    visited, _ = crawl.crawled(seeds(spark, 0), edges, log, save_to(spark))
    assert pages_of(visited) == [1, 2]


def test_scan_ends_where_files_give_no_row(spark, tmp_path):
    files = spark.createDataFrame([(p,) for p in ("a", "b", "c", None, "d")], "path string").coalesce(1)
    tried = []

    def scan(part):
        tried.append([r.path for r in part.orderBy("path").collect()])
        return part.filter("path <> 'b'").withColumn("pages", F.lit(1))

    folder, save = f"{tmp_path}/scan", save_to(spark)
    first = inventory.scan_in_batches(files, scan, folder, save, 2)
    assert tried == [["a", "b"], ["c", "d"]] and sorted(r.path for r in first.collect()) == ["a", "c", "d"]
    assert [r.path for r in inventory.without_summary(spark, folder).collect()] == ["b"]
    more = files.unionByName(spark.createDataFrame([("e",)], "path string"))
    assert sorted(r.path for r in inventory.scan_in_batches(more, scan, folder, save, 2).collect()) == ["a", "c", "d", "e"]
    assert tried[2:] == [["e"]] and inventory.scan_in_batches(files, scan, folder, save, 2).count() == 4
    assert inventory.scan_in_batches(files.limit(0), scan, f"{tmp_path}/none", save).count() == 0


def test_readers_never_fail_during_replacements(spark, tmp_path):
    folder, stop, seen = f"{tmp_path}/snapshot", threading.Event(), []
    commits.replace(folder, rows=spark.range(0, 3).coalesce(1), other=spark.range(1))

    def read():
        while not stop.is_set():
            rows = spark.read.parquet(commits.current(spark, folder, "rows")).collect()
            seen.append(len(rows) == 3 and len({r.id // 3 for r in rows}) == 1)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 51):
        commits.replace(folder, rows=spark.range(3 * k, 3 * k + 3).coalesce(1))
    stop.set()
    reader.join()
    assert len(seen) > 3 and all(seen)
    assert {r.id for r in spark.read.parquet(commits.current(spark, folder, "rows")).collect()} == {150, 151, 152}
    with pytest.raises(FileNotFoundError):
        commits.current(spark, folder, "other")
    commits.replace(folder, retain=0.0, rows=spark.range(1))
    assert commits.CommitLog(spark, folder).numbers() == [51, 52]
    assert sorted(x for x in os.listdir(f"{folder}/rows") if x.startswith("n=")) == ["n=51", "n=52"]


def test_a_number_is_committed_once(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path))
    log.commit(1, by="first")
    with pytest.raises(FileExistsError):
        log.commit(1, by="second")
    assert log.last()[1]["by"] == "first"


def test_remembered_by_name_and_time(spark, tmp_path):
    (tmp_path / "in.txt").write_text("x")
    built = []

    def build(k):
        return lambda: built.append(k) or spark.range(k)

    ask = lambda name, k, **options: remembered(spark, f"{tmp_path}/kept", name, f"{tmp_path}/in.txt", build(k), **options).count()
    assert [ask("a", 1), ask("b", 2), ask("a", 3), ask("a", 4, seconds=60), ask("a", 5, seconds=0)] == [1, 2, 1, 1, 5]
    assert built == [1, 2, 5]


def test_downloads_keep_rows_without_a_url(spark):
    urls = spark.createDataFrame([("u", "p"), (None, "q"), (None, "r")], "url string, path string")
    have = spark.createDataFrame([("r", 4)], "path string, bytes long")
    got = services.downloads(urls, have, lambda url: (url, "application/pdf", b"%PDF-")).collect()
    assert sorted((r.path, r.status, r.error) for r in got) == [("p", "downloaded", None), ("q", None, "ValueError: no url"), ("r", "existing", None)]
