"""Profile logs: last line wins, totals over successes, incremental work, page review outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import row_numbers

GOOD = ("success", "partial_success")


def last_written(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    others = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def summarise(rows: DataFrame, value: str, status: str = "status", good=GOOD, *, save) -> DataFrame:
    """Totals and exact min, median, mean and max of a number over successful rows; 0 without any.

    The median is the mean of the middle two of the rows in order, which are dealt by range: no task holds all values."""
    v = save(rows.filter(F.col(status).isin(*good)).select(F.coalesce(F.col(value), F.lit(0)).cast("double").alias("v")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    whole = v.agg(F.count("v").alias("profiled"), *[F.round(zero(f("v")), 6).alias(n) for n, f in (("total", F.sum), ("least", F.min), ("mean", F.avg), ("most", F.max))])
    places = row_numbers(v, "v", save=save).filter("rn in ((total + 1) div 2, (total + 2) div 2)")
    middle = places.agg(F.round(zero(F.avg("v")), 6).alias("middle")).first()["middle"]
    return whole.select("profiled", "total", "least", F.lit(middle).alias("middle"), "mean", "most")


def totals(rows: DataFrame, fields: tuple[str, ...], status: str = "status", good=GOOD) -> DataFrame:
    """The sum of each field over successful rows, a missing one as 0."""
    own = rows.filter(F.col(status).isin(*good))
    return own.agg(F.count("*").alias("profiled"), *[F.coalesce(F.sum(F.coalesce(F.col(f), F.lit(0))), F.lit(0)).cast("long").alias(f) for f in fields])


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(status), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def to_do(files: DataFrame, prior: DataFrame, retry_failed: bool = True, force: bool = False, limit: int | None = None) -> DataFrame:
    """Files (path, size, mtime) without an equal prior record; failures are tried again only if asked. `limit` caps new work."""
    done = prior if not retry_failed else prior.filter(F.col("status").isin(*GOOD))
    left = files if force else files.join(done.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")
    return left if limit is None else left.orderBy("path").limit(limit)


def reading_order(blocks: Column) -> Column:
    """Lines of OCR blocks by height (two digits), then from the left, joined by new lines."""
    lines = F.filter(blocks, lambda b: b["BlockType"] == "LINE")
    box = lambda b: b["Geometry"]["BoundingBox"]
    keyed = F.transform(lines, lambda b, i: F.struct(F.bround(F.coalesce(box(b)["Top"], F.lit(0.0)), 2).alias("top"), F.coalesce(box(b)["Left"], F.lit(0.0)).alias("left"), i.alias("i"), F.coalesce(b["Text"], F.lit("")).alias("text")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda k: k["text"]), "\n")


BLOCKS = "array<struct<BlockType string, Text string, Geometry struct<BoundingBox struct<Top double, Left double>>>>"


def outcomes(attempts: DataFrame, max_revisions: int = 3, least_coverage: float = 0.995) -> DataFrame:
    """page, status, revision: the first accepted attempt passes; without one the page goes to review, or is an error.

    attempts: page, revision, coverage, equivalent, issues (array), error (string or null)."""
    fine = F.col("equivalent") & (F.size("issues") == 0) & (F.col("coverage") >= least_coverage) & (F.col("revision") <= max_revisions)
    rolled = attempts.groupBy("page").agg(F.min(F.when(fine, F.col("revision"))).alias("revision"), F.count("error").alias("errors"), F.count_if(F.col("revision") <= max_revisions).cast("long").alias("attempts"))
    status = F.when(F.col("revision").isNotNull(), "auto_pass").when(F.col("errors") > 0, "error").otherwise("review")
    return rolled.select("page", status.alias("status"), "revision", "attempts")


def run_passes(pages: DataFrame) -> DataFrame:
    return pages.agg(F.coalesce(F.bool_and(F.col("status") == "auto_pass"), F.lit(True)).alias("all_pass"), F.count("*").alias("pages"))


def run_manifest(pages: DataFrame) -> DataFrame:
    """job, statuses in page order, all_pass, exit_status (0 if all pages of the job passed, else 2) of (job, page, status)."""
    own = pages.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("page", "status")))["status"].alias("statuses"), F.bool_and(F.col("status") == "auto_pass").alias("all_pass"))
    return own.withColumn("exit_status", F.when(F.col("all_pass"), 0).otherwise(2).cast("long"))


def word_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, coverage: the multiset share of left's words (key, words array) that right has too."""
    a = left.select(key, F.explode("words").alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    b = right.select(key, F.explode("words").alias("w")).groupBy(key, "w").agg(F.count("*").alias("m"))
    met = a.join(b, [key, "w"], "left").groupBy(key).agg((F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.greatest(F.lit(1), F.sum("n"))).alias("coverage"))
    return left.select(key).join(met, key, "left").select(key, F.round(F.coalesce("coverage", F.lit(0.0)), 9).alias("coverage"))
