"""File sinks: JSON, CSV and TSV splits, snapshots by version, HTML exports, exit states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import utc_stamp
from millrace.sources import commits


def write_manifest(pdfs: DataFrame, errors: DataFrame, folder: str) -> None:
    pdfs.orderBy("url").write.mode("overwrite").json(f"{folder}/manifest")
    pdfs.select("url", "path", "bytes", "status").orderBy("url").write.mode("overwrite").csv(f"{folder}/manifest_csv", header=True)
    errors.write.mode("overwrite").json(f"{folder}/errors")


def write_audit(audited: DataFrame, folder: str) -> None:
    """(full_path, page_count, error) to a table of valid files and one of errors, tab-separated."""
    audited.filter("error is null").select("full_path", "page_count").write.mode("overwrite").csv(f"{folder}/pages", sep="\t", header=True)
    audited.filter("error is not null").select("full_path", "error").write.mode("overwrite").csv(f"{folder}/errors", sep="\t", header=True)


def write_paths(files: DataFrame, folder: str) -> None:
    """The paths to scan, sorted: written before the scan."""
    files.select("path").orderBy("path").write.mode("overwrite").json(folder)


def write_inventory(summaries: DataFrame, features: DataFrame, folder: str) -> None:
    """Summaries with the time of writing, and pages by document: a version of both, committed together."""
    commits.replace(folder, "json", summaries=summaries.withColumn("generated_at", utc_stamp()), page_details=features)


def append_log(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(folder)


def write_results(rows: DataFrame, folder: str) -> None:
    """Scored results, a folder per chunk policy, as a new version."""
    commits.replace(folder, "json", ("chunk_policy",), results=rows)


def write_rows(rows: DataFrame, folder: str, **about) -> None:
    """CSV and JSON with columns in alphabetical order; `about` (seed, method, model ...) is a JSON row of its own."""
    ordered = rows.select(*sorted(rows.columns))
    ordered.write.mode("overwrite").csv(f"{folder}/csv", header=True)
    ordered.write.mode("overwrite").json(f"{folder}/json")
    if about:
        rows.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in sorted(about.items())]).write.mode("overwrite").json(f"{folder}/about")


def put_objects(rows: DataFrame, folder: str, buckets: int = 16) -> None:
    """(key, value) rows put under their keys. Keys are dealt to `buckets` folders by hash, so that many small objects make few
    files; each holds JSON lines (see readers.objects_in). Writing again replaces all."""
    bucket = F.pmod(F.hash("key"), F.lit(buckets))
    rows.select("key", "value", bucket.alias("bucket")).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").option("ignoreNullFields", False).json(folder)


def html_export(pages: DataFrame) -> DataFrame:
    """doc_id, html: an escaped title and a section per page (doc_id, title, page_num, html), in order; a page's first page0 id gets its number."""
    number = F.col("page_num").cast("string")
    at = F.instr("html", 'id="page0"')
    own = F.when(at > 0, F.concat(F.expr("left(html, instr(html, 'id=\"page0\"') - 1)"), F.lit('id="page'), number, F.lit('"'), F.expr("substring(html, instr(html, 'id=\"page0\"') + 10)"))).otherwise(F.col("html"))
    section = F.concat(F.lit('<section aria-label="Page '), number, F.lit('">\n'), own, F.lit("\n</section>\n"))
    merged = pages.withColumn("section", section).groupBy("doc_id").agg(F.max("title").alias("title"), F.array_join(F.array_sort(F.collect_list(F.struct("page_num", "section")))["section"], "").alias("body"))
    title = F.col("title")
    for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        title = F.replace(title, F.lit(plain), F.lit(mark))
    return merged.select("doc_id", F.concat(F.lit('<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>'), title, F.lit("</title>\n</head>\n<body>\n"), F.col("body"), F.lit("</body>\n</html>\n")).alias("html"))


def exit_status(rows: DataFrame, good: str) -> int:
    return 0 if rows.filter(~F.expr(good)).limit(1).count() == 0 else 2
