"""Crawls over tables of fetched pages: robots rules, sitemaps, breadth-first search, manifests."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.functions import web
from millrace.operators.ordering import row_numbers
from millrace.sources.commits import CommitLog


def robots_allowed(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The longest rule (path prefix, allowed) that fits decides; without one the path is allowed."""
    out = F.lit(True)
    for prefix, allowed in sorted(rules, key=lambda r: (len(r[0]), r[1])):
        out = F.when(path.startswith(prefix), F.lit(allowed)).otherwise(out)
    return out


def robots_rules(text: str, agent: str) -> list[tuple[str, bool]]:
    """The (path prefix, allowed) rules of a robots file for an agent: of the group that names it, else of the group `*`."""
    groups, names, open_ = {}, [], False
    for line in text.splitlines():
        field, _, value = line.partition("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            names = [*names, value.lower()] if open_ else [value.lower()]
            open_ = True
            groups.setdefault(value.lower(), [])
        elif field in ("allow", "disallow"):
            open_ = False
            for n in names:
                if value or field == "allow":
                    groups[n].append((value, field == "allow"))
    own = [n for n in groups if n != "*" and n in agent.lower()]
    return groups[max(own, key=len)] if own else groups.get("*", [])


def admission(url: Column, own: Column, rules: list[tuple[str, bool]]) -> Column:
    """pdf, page or null: PDF links of other hosts always, links of own hosts as robots allow."""
    allowed = robots_allowed(web.part(url, "path"), rules)
    return F.when(web.is_pdf_url(url) & (~own | allowed), "pdf").when(own & allowed, "page")


def admitted(url: Column, hosts: tuple[str, ...], rules: list[tuple[str, bool]]) -> Column:
    return admission(url, F.lower(web.part(url, "host")).isin(*hosts), rules)


def sitemap_pages(sitemaps: DataFrame, index: str, root: str, hosts: tuple[str, ...], rules: list[tuple[str, bool]], save) -> DataFrame:
    """url of the pages that sitemaps reached from `index` name, on own hosts and allowed by robots, and of `root`.

    sitemaps: fetched (url, xml); an index of sitemaps names further ones, each read once."""
    kinds = sitemaps.withColumn("nested", F.regexp_like("xml", F.lit(r"(?is)^[^<]*(?:<[?!][^>]*>\s*)*<(?:\w+:)?sitemapindex\b")))
    locations = kinds.select("url", "nested", F.explode(F.regexp_extract_all("xml", F.lit(r"<(?:\w+:)?loc\b[^>]*>\s*([^<]*?)\s*</"), F.lit(1))).alias("loc"))
    locations = save(locations.withColumn("loc", web.unescape(F.col("loc"))))
    start = sitemaps.sparkSession.createDataFrame([(index,)], "node string")
    reached = breadth_first(locations.filter("nested").select(F.col("url").alias("src"), F.col("loc").alias("dst")), start, save)
    named = locations.filter(~F.col("nested")).join(reached, F.col("url") == F.col("node"), "left_semi")
    pages = named.select(web.canonical(F.col("loc"), F.col("url")).alias("url")).filter("url is not null")
    host = F.regexp_replace(web.part(F.col("url"), "host"), "^.*@|:[0-9]*$", "")
    pages = pages.filter(host.isin(*hosts) & robots_allowed(web.part(F.col("url"), "path"), rules))
    return pages.unionByName(sitemaps.sparkSession.createDataFrame([(root,)], "url string")).distinct()


def content_kind(content_type: Column, body: Column) -> Column:
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return F.when((kind == "application/pdf") | body.startswith(F.lit("%PDF-").cast("binary")), "pdf").when(kind.isin("text/html", "application/xhtml+xml"), "html").otherwise("other")


def breadth_first(edges: DataFrame, start: DataFrame, save) -> DataFrame:
    """node, level of what is reached from start (node) along edges (src, dst). `save` writes a round's frontier to shared storage."""
    seen = save(start.select("node", F.lit(0).cast("long").alias("level")).distinct())
    frontier = seen
    for level in itertools.count(1):
        nxt = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = save(nxt.withColumn("level", F.lit(level).cast("long")))
        if not frontier.take(1):
            return seen
        seen = seen.unionByName(frontier)
        if level % 16 == 0:  # keeps the plan short
            seen = save(seen)


def not_attempted(urls: DataFrame, *done: DataFrame) -> DataFrame:
    for d in done:
        urls = urls.join(d.select("url"), "url", "left_anti")
    return urls


def manifest(pdfs: DataFrame, errors: DataFrame, root: str, pages: int = 0) -> DataFrame:
    """One row: root, generated_at, pages of this run and counts. PDFs and errors themselves are files (writers.write_manifest)."""
    from millrace.functions.text import utc_stamp

    both = pdfs.select(F.lit(1).alias("pdf")).unionByName(errors.select(F.lit(0).alias("pdf")))
    return both.agg(F.count_if(F.col("pdf") == 1).alias("pdf_count"), F.count_if(F.col("pdf") == 0).alias("error_count")).select(F.lit(root).alias("root"), utc_stamp().alias("generated_at"), F.lit(pages).cast("long").alias("pages"), "pdf_count", "error_count")


def crawled(start: DataFrame, links, folder: str, save, max_pages: int | None = None, batch: int | None = None, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(page, step) of the pages that this run visits, and (page) of those found but not visited yet: first found, first visited.

    start: (page). links: a DataFrame (src, dst), or a function from the pages of a step (page) to one, so that it may fetch.
    At most `batch` pages are visited in a step (all that an earlier step found if None), `max_pages` in this run. Pages in
    done (page) are not visited. Null pages and links are none.

    `folder` holds the frontier as a log: each step appends the pages that nobody found before, numbered in order, and its
    visits, then commits. A page is written once in each, however many steps follow, and a later run with the same folder
    goes on behind the last commit. Found pages are met by a semi-join of the log with a step's links, so that Spark may broadcast
    the links if they are small; only links that are known already come back to be left out. `save` is for row_numbers.
    """
    spark = start.sparkSession
    log = CommitLog(spark, folder)
    kind = StructType([start.schema["page"]])
    found_kind, seen_kind = StructType([*kind.fields, StructField("place", LongType())]), StructType([*kind.fields, StructField("step", LongType())])

    def append_found(pages: DataFrame, number: int, earlier: bool) -> int:
        pages = save(pages.filter(F.col("page").isNotNull()).distinct())
        known = log.read("found", found_kind, number - 1).select("page") if earlier else None
        if done is not None:
            known = done.select("page") if known is None else known.unionByName(done.select("page"))
        if known is not None:
            pages = pages.join(known.join(pages, "page", "left_semi").distinct(), "page", "left_anti")
        numbered = row_numbers(pages, "page", save=save, name="place").select("page", "place")
        path = log.write(numbered, "found", number)
        return spark.read.schema(found_kind).parquet(path).count()

    number, facts = log.last()
    if not number:
        number, facts = 1, {"found": append_found(start, 1, False), "queue": 1, "taken": 0}
        log.commit(number, **facts)
    first, room = number, max_pages
    queue, taken = facts["queue"], facts["taken"]  # the part that is being visited, and how many of its pages were
    while room is None or room > 0:
        size = log.facts(queue)["found"]
        if taken >= size:
            if queue >= number:
                break
            queue, taken = queue + 1, 0
            continue
        n = min(x for x in (size - taken, batch, room) if x is not None)
        part = spark.read.schema(found_kind).parquet(log.part("found", queue)).filter(F.col("place").between(taken + 1, taken + n))
        number += 1
        now = spark.read.schema(seen_kind).parquet(log.write(part.select("page", F.lit(number - 1).cast("long").alias("step")), "visited", number)).select("page")
        taken += n
        room = None if room is None else room - n
        edges = links(now) if callable(links) else now.join(links, F.col("page") == F.col("src"))
        log.commit(number, found=append_found(edges.select(F.col("dst").alias("page")), number, True), queue=queue, taken=taken)
    visited = log.read("visited", seen_kind).filter(F.col("n") > first).select("page", "step")
    left = log.read("found", found_kind).filter((F.col("n") > queue) | ((F.col("n") == queue) & (F.col("place") > taken)))
    return visited, left.select("page")


def audit_counts(audited: DataFrame) -> DataFrame:
    """valid, invalid, exit_status (0 if none is invalid, else 1) of (error)."""
    counts = audited.agg(F.count_if(F.col("error").isNull()).alias("valid"), F.count_if(F.col("error").isNotNull()).alias("invalid"))
    return counts.withColumn("exit_status", (F.col("invalid") > 0).cast("long"))


def audit_reason(content: Column, pages: Column, locked: Column) -> Column:
    """Why a PDF is not valid; null if it is. pages: null if it can't be parsed."""
    return F.when(~content.startswith(F.lit("%PDF-").cast("binary")), "not a PDF").when(locked, "password").when(pages.isNull(), "unreadable").when(pages == 0, "no pages")
