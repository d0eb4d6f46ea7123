"""File sources: discovery, JSON and JSON-lines readers, S3 objects, PDFs through a pluggable parser."""

from __future__ import annotations

import re
import signal
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

# Folders that discovery skips.
SKIPPED = (".venv", "venv", ".git", "__pycache__", "node_modules")


def discovered(files: DataFrame, root: str, skipped=()) -> DataFrame:
    """Files (path, ...) below root that end in .pdf in any case, with their relative path and name; files in folders `skipped` go."""
    relative = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    found = files.filter(F.lower("path").endswith(".pdf")).withColumn("relative", relative).withColumn("name", F.substring_index("path", "/", -1))
    if skipped:
        found = found.filter(~F.exists(F.split("relative", "/"), lambda x: x.isin(*skipped)))
    return found


def find_pdfs(spark: SparkSession, root: str, skipped=()) -> DataFrame:
    """path, relative, name, length, modificationTime of files that end in .pdf; contents are read only if selected."""
    return discovered(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root), root, skipped)


def read_object(spark: SparkSession, uri: str) -> DataFrame:
    """path, content, length of an object (or those that a pattern names) of any store that Spark reaches."""
    return spark.read.format("binaryFile").load(uri).select("path", "content", "length")


def objects_in(content: Column) -> Column:
    """array of (key, value) of a bucket's file of JSON lines, as writers.put_objects writes them."""
    lines = F.filter(F.split(F.decode(content, "utf-8"), "\n"), lambda x: x != "")
    return F.transform(lines, lambda x: F.from_json(x, "key string, value string"))


def size_inventory(files: DataFrame) -> DataFrame:
    return files.select("relative", F.bround(F.col("length") / 1048576.0, 2).alias("mib")).orderBy(F.lower("relative"))


@contextmanager
def at_most(seconds: float | None):
    """Raises TimeoutError in the block after so many seconds; no limit if None. For the main thread of a worker."""

    def stop(number, frame):
        raise TimeoutError(f"more than {seconds} s")

    if seconds is None:
        yield
        return
    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def pdf_pages(files: DataFrame, parse, seconds: float | None = None) -> DataFrame:
    """doc (path), page_num, text, error: parse(bytes) yields page texts on the executors; a failure, or a file that takes
    over `seconds`, is a row with its error and without pages."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with at_most(seconds):
                        own = [(path, k, " ".join((t or "").split()), None) for k, t in enumerate(parse(content), 1)]
                    rows += own
                except Exception as e:  # an error is a value here
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "page_num", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page_num long, text string, error string")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; none if there is no such file. Blank lines are skipped."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def page_errors(rows: DataFrame, digest: str) -> DataFrame:
    """page_num, message of a file's (digest, page_num, message) rows; of another digest, or without a page or message, none."""
    return rows.filter((F.col("digest") == digest) & F.col("page_num").isNotNull() & F.col("message").isNotNull()).select("page_num", "message")


def page_error_files(files: DataFrame, digest: Column) -> DataFrame:
    """path, page_num, message of files of page errors (path, value): a JSON object with pdf_sha256 and errors, messages by page.

    A file that is no such object, that is of another digest, or that names a page which is no number, has no errors."""
    schema = "pdf_sha256 string, errors map<string,string>"
    read = files.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("pages", F.map_keys("r.errors"))
    whole = F.forall("pages", lambda k: F.trim(k).try_cast("int").isNotNull())
    good = read.filter((F.col("r.pdf_sha256") == digest) & whole)
    return good.select("path", F.explode("r.errors").alias("page", "message")).select("path", F.trim("page").cast("int").cast("long").alias("page_num"), F.coalesce("message", F.lit("None")).alias("message"))


def tolerant_json_lines(lines: DataFrame, schema: str, key: str) -> DataFrame:
    """Parsed rows of (value, seq); malformed lines, non-objects and rows without a string key go."""
    good = F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT<")
    own = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), f"$.{key}", "variant")) == "STRING"
    return lines.filter(good & own).select(F.from_json("value", schema).alias("r"), "seq").select("r.*", "seq")


def inventory_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """summaries and page_details (path, pages) of an inventory file, or of a folder of them; with `lines` each line is one.
    A file may lack either."""
    page = "array<struct<page int, has_text boolean, characters long, words long, language string>>"
    # Both are read as text, so that a map of paths is no column for each path, neither of the rows nor of an inferred schema.
    texts = spark.read.schema("summaries string, page_details string").option("multiLine", not lines).json(path)
    listed = texts.select("summaries").filter("summaries is not null")
    kind = spark.read.json(listed.rdd.map(lambda r: r["summaries"])).schema
    none = spark.createDataFrame([], "path string")
    summaries = listed.select(F.explode(F.from_json("summaries", ArrayType(kind))).alias("s")).select("s.*") if len(kind) else none
    details = texts.select(F.explode(F.from_json("page_details", f"map<string, {page}>")).alias("path", "pages"))
    return summaries, details


def complete_rows(rows: DataFrame, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows that have all required columns, and those that don't with what they lack."""
    lacks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return rows.filter(F.size(lacks) == 0), rows.withColumn("lacks", lacks).filter(F.size("lacks") > 0)
