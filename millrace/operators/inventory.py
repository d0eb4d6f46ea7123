"""Page features, per-document rollups and corpus totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions import text as T
from millrace.operators.ordering import row_numbers
from millrace.sources.commits import CommitLog

#: Files of more bytes are not scanned.
LARGE = 25 * 1024 * 1024


def page_features(pages: DataFrame) -> DataFrame:
    """doc_id, page_num and has_text, characters, words, tables_estimate, language of each page's raw text; images and text_blocks as the parser counted them."""
    t = F.col("text")
    return pages.select("doc_id", "page_num", T.has_text(t).alias("has_text"), T.characters(t).alias("characters"), T.word_count(t).alias("words"), T.table_estimate(t).alias("tables_estimate"), T.language(t).alias("language"), *[c for c in ("images", "text_blocks") if c in pages.columns])


def risk(pages: Column, with_text: Column, characters: Column) -> Column:
    return F.when(with_text < pages, "high").when(characters < 1000, "medium").otherwise("low")


def inventory(features: DataFrame) -> DataFrame:
    """One row per document."""
    more = [c for c in ("images", "text_blocks") if c in features.columns]
    rolled = features.groupBy("doc_id").agg(
        *[F.sum(c).alias(c) for c in more],
        F.count("*").alias("pages"), F.count_if("has_text").alias("pages_with_text"), F.sum("characters").alias("total_characters"),
        F.sum("words").alias("total_words"), F.sum("tables_estimate").alias("tables_estimate"), F.array_sort(F.collect_set("language")).alias("found"),
    )
    return rolled.select(
        "doc_id", "pages", "pages_with_text", (F.col("pages") - F.col("pages_with_text")).alias("pages_without_text"),
        F.when(F.col("total_characters") > 0, "yes").otherwise("no").alias("text_present"),
        F.when((F.col("pages") > 0) & (F.col("pages") == F.col("pages_with_text")), "yes").otherwise("no").alias("text_on_all_pages"),
        F.coalesce(F.bround(F.try_divide("pages_with_text", "pages") * 100, 1), F.lit(0.0)).alias("text_coverage_pct"),
        "total_characters", "total_words", "tables_estimate", *more, F.when(F.size("found") > 0, F.array_join("found", ", ")).otherwise("none").alias("languages"),
        risk(F.col("pages"), F.col("pages_with_text"), F.col("total_characters")).alias("docling_risk"),
    )


def language_pages(features: DataFrame) -> DataFrame:
    """doc_id and a map from language to pages."""
    counts = features.groupBy("doc_id", "language").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("language_pages"))


def language_totals(maps: DataFrame) -> DataFrame:
    return maps.select(F.explode("language_pages").alias("language", "n")).groupBy("language").agg(F.sum("n").alias("pages"))


def corpus_totals(summaries: DataFrame) -> DataFrame:
    return summaries.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.count_if(F.col("pages_without_text") > 0).alias("with_empty_pages"),
        F.coalesce(F.sum("tables_estimate"), F.lit(0)).alias("tables"),
    )


def value_counts(summaries: DataFrame, column: str) -> DataFrame:
    return summaries.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("documents"))


def unscanned(files: DataFrame, prior: DataFrame) -> DataFrame:
    """Files without a summary yet; one with an error counts as scanned."""
    return files.join(prior.select("path"), "path", "left_anti")


def placeholders(files: DataFrame, errors: DataFrame, most: int = LARGE) -> DataFrame:
    """Summaries, with all their columns, of files too large to scan (path, length) and of those that failed (path, kind, message)."""
    zero, unknown = F.lit(0).cast("long"), F.lit("unknown")
    numbers = [zero.alias(c) for c in ("pages", "pages_with_text", "pages_without_text", "total_characters", "total_words", "tables_estimate", "images", "text_blocks")]
    row = lambda languages, error: [*numbers, unknown.alias("text_present"), unknown.alias("text_on_all_pages"), F.lit(0.0).alias("text_coverage_pct"), F.lit(languages).alias("languages"), F.lit("error").alias("docling_risk"), error.alias("error")]
    large = files.filter(F.col("length") > most).select("path", *row("skipped_large", F.lit(None).cast("string")))
    return large.unionByName(errors.select("path", *row("error", T.error_text(F.col("kind"), F.col("message")))))


def with_details(summaries: DataFrame, features: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each summary with its pages' features in page order; an empty list without any."""
    own = features.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_num", *[c for c in features.columns if c not in (key, "page_num")]))).alias("details"))
    return summaries.join(own, key, "left")


def scan_in_batches(files: DataFrame, scan, folder: str, save, every: int = 200) -> DataFrame:
    """Summaries of all files (path) that some run with this folder tried: those without a commit are scanned now, `every` files
    to a commit, in the order of their paths, so that a run that breaks off loses at most one batch.

    The files are dealt to batches once, by their places. A batch's commit says which files were tried, whatever came back:
    a file without a row is not asked again but told by `without_summary`. Null paths are no files.
    """
    spark = files.sparkSession
    log = CommitLog(spark, folder)
    tried = StructType([StructField("path", StringType())])
    number, first = log.last()[0], log.last()[0]
    left = files.filter(F.col("path").isNotNull())
    if number:
        left = unscanned(left, log.read("tried", tried))
    dealt = row_numbers(left, "path", save=save).withColumn("batch", F.expr(f"(rn - 1) div {int(every)}"))
    dealt = save(dealt.select(*files.columns, "batch"))
    batches = dealt.agg(F.max("batch")).first()[0]
    summary = None
    for k in range(0 if batches is None else batches + 1):
        number += 1
        part = dealt.filter(F.col("batch") == k).drop("batch")
        rows = scan(part)
        summary = rows.schema
        log.write(rows, "rows", number)
        log.write(part.select("path"), "tried", number)
        log.commit(number, schema=summary.jsonValue())
    if summary is None:
        summary = StructType.fromJson(log.facts(first)["schema"]) if first else scan(files.limit(0)).schema
    return log.read("rows", summary).drop("n")


def without_summary(spark, folder: str) -> DataFrame:
    """path of the files that were tried and gave no row."""
    log = CommitLog(spark, folder)
    kind = StructType([StructField("path", StringType())])
    return log.read("tried", kind).select("path").join(log.read("rows", kind).select("path"), "path", "left_anti")


def clamped(page, pages):
    """A page number kept between 1 and the number of pages."""
    return F.least(pages, F.greatest(F.lit(1), page))


def thumbnail(width, height, most_width: int = 900, most_height: int = 1000):
    """struct(width, height) of an image scaled down, never up, to fit; at least one pixel each way."""
    scale = F.least(most_width / width, most_height / height, F.lit(1.0))
    side = lambda x: F.greatest(F.lit(1), F.bround(x * scale, 0).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def elapsed(began, ended):
    """Seconds between two timestamps, to three digits."""
    return F.round((F.unix_micros(ended) - F.unix_micros(began)) / 1e6, 3)


def over_limit(counts: DataFrame, column: str, limit) -> DataFrame:
    """How many numbers are over a model's limit; null where the limit is unknown."""
    return counts.agg(F.count_if(F.col(column) > limit).alias("n")).select(F.when(limit.isNotNull(), F.col("n")).alias("over_limit"))
