"""Steps whose work is done by something outside: fetchers, parsers, converters, models. Each takes a function that runs on the
executors, once for every row, and returns its outcome as a row; what fails is a row with its error, never a failed job."""

from __future__ import annotations

import itertools
import time

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import crawl, evaluation, workflow
from millrace.sources.readers import at_most


def each_row(rows: DataFrame, columns: list[str], work, schema: str, names: list[str]) -> DataFrame:
    """work(*values) yields tuples of the schema; an exception is work's own to make a row of."""

    def run(batches):
        for batch in batches:
            out = [r for values in zip(*(c.to_pylist() for c in batch.columns)) for r in work(*values)]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return rows.select(*columns).mapInArrow(run, schema)


def _error(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def concurrently(items, work, host, in_flight: int = 8, per_host: int = 2, seconds: float | None = None, window: int = 1000):
    """work(item) of each item, in the order of the items, at most `in_flight` at a time and `per_host` of a host's.

    Up to `window` items are read ahead, and the next item of any host that is free starts, a host's in their order. An item that
    takes over `seconds` gives a TimeoutError and its place is free again; what work raises is its outcome, too."""
    import queue
    import threading
    from collections import deque

    items, done, news = iter(items), {}, queue.SimpleQueue()
    waiting: dict = {}  # items of each host, in order
    running: dict = {}  # number -> (host, deadline)
    busy: dict = {}
    read = told = 0
    more = True

    def start(number, item):
        def run():
            try:
                news.put((number, work(item)))
            except BaseException as e:  # the outcome of the item
                news.put((number, e))

        threading.Thread(target=run, daemon=True).start()

    while more or told < read:
        while more and read - told < window:
            item = next(items, StopIteration)
            if item is StopIteration:
                more = False
                break
            waiting.setdefault(host(item), deque()).append((read, item))
            read += 1
        for name in [h for h in waiting if busy.get(h, 0) < per_host]:
            while waiting[name] and busy.get(name, 0) < per_host and len(running) < in_flight:
                number, item = waiting[name].popleft()
                busy[name] = busy.get(name, 0) + 1
                running[number] = (name, None if seconds is None else time.monotonic() + seconds)
                start(number, item)
            if not waiting[name]:
                del waiting[name]
        while told in done:
            yield done.pop(told)
            told += 1
        if not running:
            continue
        try:
            number, outcome = news.get(timeout=None if seconds is None else max(0.0, min(d for _, d in running.values()) - time.monotonic()))
        except queue.Empty:
            number = min(running, key=lambda n: running[n][1])
            outcome = TimeoutError(f"more than {seconds} s")
        if number in running:  # else it came after its time
            busy[running.pop(number)[0]] -= 1
            done[number] = outcome


def fetched(urls: DataFrame, fetch, seconds: float | None = None, in_flight: int = 8, per_host: int = 2, lanes: int = 1) -> DataFrame:
    """url, final_url, content_type (without parameters, lower case), body, error: fetch(url) gives (final url, type, bytes).

    URLs are dealt by host, so that a host's are asked by one task (by `lanes` tasks at most, for a host with a large share of
    them), in the order of their texts, `per_host` at a time; a task has `in_flight` at work. fetch must bear being called from threads."""
    from urllib.parse import urlsplit

    def host(url):
        try:
            return urlsplit(url or "").hostname or ""
        except ValueError:
            return ""

    def run(batches):
        rows = (u for b in batches for u in b.column(0).to_pylist())
        pairs, kept = itertools.tee(rows)
        held = []
        for url, outcome in zip(kept, concurrently(pairs, fetch, host, in_flight, per_host, seconds)):
            if isinstance(outcome, BaseException):
                held.append((url, None, None, None, _error(outcome)))
            else:
                final, kind, body = outcome
                held.append((url, final, (kind or "").split(";")[0].strip().lower(), body, None))
            if len(held) >= 64:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.string())
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["url", "final_url", "content_type", "body", "error"])
    dealt = urls.select("url", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"), F.pmod(F.hash("url"), F.lit(lanes)).alias("lane"))
    dealt = dealt.repartition("host", "lane").sortWithinPartitions(F.xxhash64("host"), "url").select("url")
    return dealt.mapInArrow(run, "url string, final_url string, content_type string, body binary, error string")


def downloads(urls: DataFrame, existing: DataFrame, fetch) -> DataFrame:
    """url, path, bytes, status, error: a file that is there and not empty (path, bytes) is `existing`; another is fetched and is
    `downloaded` if it is a PDF by its type or its first bytes. A null url is an error."""
    have = existing.filter("bytes > 0").select("path", F.col("bytes").alias("old"))
    met = urls.join(have, "path", "left")
    kept = met.filter("old is not null").select("url", "path", F.col("old").alias("bytes"), F.lit("existing").alias("status"), F.lit(None).cast("string").alias("error"))
    new = met.filter("old is null").select("url", "path")
    got = fetched(new.select("url").filter("url is not null").distinct(), fetch).withColumn("pdf", F.col("error").isNull() & (crawl.content_kind(F.col("content_type"), F.col("body")) == "pdf"))
    new = new.join(got, "url", "left")
    error = F.when(F.col("url").isNull(), "ValueError: no url").when(~F.col("pdf"), F.coalesce("error", F.lit("ValueError: response is not a PDF")))
    new = new.select("url", "path", F.when(F.col("pdf"), F.octet_length("body")).cast("long").alias("bytes"), F.when(F.col("pdf"), "downloaded").alias("status"), error.alias("error"))
    return kept.unionByName(new)


def element_pages(files: DataFrame, partition) -> DataFrame:
    """path, page_num, text, error: a second loader. partition(bytes) yields (page number, element's text); a page's elements
    are joined by lines, its broken lines by spaces, and white space is normalized."""

    def work(path, content):
        try:
            return [(path, int(page), k, text or "", None) for k, (page, text) in enumerate(partition(content))]
        except Exception as e:
            return [(path, None, None, None, _error(e))]

    rows = each_row(files, ["path", "content"], work, "path string, page_num long, k long, text string, error string", ["path", "page_num", "k", "text", "error"])
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("k", "text")))["text"], "\n")
    pages = rows.groupBy("path", "page_num").agg(T.normalize(T.join_lines(joined)).alias("text"), F.max("error").alias("error"))
    return pages.select("path", "page_num", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")


def page_assets(files: DataFrame, open_file, max_pages: int = 0, prefix: str | None = None) -> DataFrame:
    """path, page, key, pdf, png, error: each page of a file (path, content) on its own and as an image, of the first `max_pages`
    pages (all if 0). open_file(bytes) gives a sequence whose item k is (pdf bytes, image bytes) of page k + 1.

    A page that fails is a row with its error, and the next goes on; a file that can't be opened is one row without a page.
    key: where its assets go, the prefix or `processed/<name without ending>`, and the page's number in four digits."""
    if max_pages < 0:
        raise ValueError("max_pages is 0 for all pages, or a number of them")

    def work(path, content):
        try:
            pages = open_file(content)
            n = min(len(pages), max_pages) if max_pages else len(pages)
        except Exception as e:
            yield path, None, None, None, _error(e)
            return
        for k in range(n):
            try:
                pdf, png = pages[k]
                yield path, k + 1, pdf, png, None
            except Exception as e:
                yield path, k + 1, None, None, _error(e)

    made = each_row(files, ["path", "content"], work, "path string, page long, pdf binary, png binary, error string", ["path", "page", "pdf", "png", "error"])
    own = F.lit(prefix.strip("/")) if prefix else F.concat(F.lit("processed/"), F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", ""))
    key = F.when(F.col("page").isNotNull(), F.concat(own, F.lit("/page_"), F.when(F.col("page") < 10000, F.lpad(F.col("page").cast("string"), 4, "0")).otherwise(F.col("page").cast("string"))))
    return made.select("path", "page", key.alias("key"), "pdf", "png", "error")


def structural_profiles(files: DataFrame, convert, fields: tuple[str, ...], seconds: float | None = None) -> DataFrame:
    """path, status, conversion_seconds (3 digits), error and the counts `fields`: convert(bytes) gives (status, counts by name)."""

    def work(path, content):
        began = time.monotonic()
        try:
            with at_most(seconds):
                status, counts = convert(content)
            if status.lower() not in ("success", "partial_success"):
                raise RuntimeError(f"conversion status: {status.lower()}")
            return [(path, status.lower(), round(time.monotonic() - began, 3), None, *(int(counts.get(f, 0)) for f in fields))]
        except Exception as e:
            return [(path, "failure", round(time.monotonic() - began, 3), _error(e), *(None for _ in fields))]

    schema = "path string, status string, conversion_seconds double, error string" + "".join(f", {f} long" for f in fields)
    return each_row(files, ["path", "content"], work, schema, ["path", "status", "conversion_seconds", "error", *fields])


def reviewed_pages(pages: DataFrame, ocr, write, verify, max_revisions: int = 3, least_coverage: float = 0.995) -> DataFrame:
    """page, status (auto_pass, review, error), reason, attempts, coverage of the last attempt.

    ocr(content) gives words; write(content, words, issues) a revision's words; verify(content, revision) a verdict
    (equivalent, issues). A page is written and verified at most max_revisions + 1 times, each time with the issues before."""

    def work(page, content):
        done, coverage = 0, None
        try:
            words = list(ocr(content))
            if not words:
                return [(page, "review", "no text found", 0, None)]
            issues: list = []
            for done in range(1, max_revisions + 2):
                own = list(write(content, words, issues))
                left = {w: own.count(w) for w in set(words)}
                coverage = sum(min(words.count(w), left[w]) for w in left) / len(words)
                equivalent, issues = verify(content, own)
                if equivalent and not issues and coverage >= least_coverage:
                    return [(page, "auto_pass", None, done, round(coverage, 9))]
            return [(page, "review", "revisions exhausted", done, round(coverage, 9))]
        except Exception as e:
            return [(page, "error", _error(e), done, None)]

    return each_row(pages, ["page", "content"], work, "page long, status string, reason string, attempts long, coverage double", ["page", "status", "reason", "attempts", "coverage"])


def generated_evals(pages: DataFrame, generate, rows: DataFrame, errors: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """Eval rows and page errors after one run over the pages (doc_id, page_num, text) in range that have no complete rows.

    generate(text) gives (query, answer, quote) rows. Valid ones replace the page's rows and clear its error; others leave the
    rows and set the error, so that the next run tries the page again. rows: doc_id, page_num, query, answer, quote; errors:
    doc_id, page_num, message."""

    def work(doc, page, text):
        try:
            return [(doc, page, *map(str, r), None) for r in generate(text)] or [(doc, page, None, None, None, "ValueError: no rows")]
        except Exception as e:
            return [(doc, page, None, None, None, _error(e))]

    todo = evaluation.pages_to_do(pages, rows, first, last).filter("state = 'todo'").select("doc_id", "page_num")
    names = ["doc_id", "page_num", "query", "answer", "quote", "message"]
    made = each_row(pages.join(todo, ["doc_id", "page_num"]), ["doc_id", "page_num", "text"], work, "doc_id long, page_num long, query string, answer string, quote string, message string", names)
    judged = evaluation.valid_pages(made.filter("message is null"), pages)
    good = made.filter("message is null").join(judged.filter("accepted"), ["doc_id", "page_num"], "left_semi").drop("message")
    failed = made.filter("message is not null").select("doc_id", "page_num", "message").unionByName(judged.filter("not accepted").select("doc_id", "page_num", F.lit("ValueError: rows do not hold").alias("message")))
    tried = made.select("doc_id", "page_num").distinct()
    kept = errors.join(tried, ["doc_id", "page_num"], "left_anti").unionByName(failed.withColumn("message", T.squeeze(F.col("message"))))
    return evaluation.upsert(rows, good, "doc_id", "page_num"), kept


def ask(questions: DataFrame, children: DataFrame, parents: DataFrame, save, model=None) -> DataFrame:
    """The answers of the question workflow for (thread_id, query): thread_id (a new one where null), answer, verified,
    verification_coverage, needs_human_review, citations, trace."""
    asked = save(questions.select(F.coalesce("thread_id", F.uuid()).alias("qid"), "query"))
    made = workflow.run(asked, children, parents, save, model)
    return made.select(F.col("qid").alias("thread_id"), "answer", "verified", "verification_coverage", "needs_human_review", "citations", "trace")
