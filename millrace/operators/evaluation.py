"""Evidence offsets, relevance by containment, retrieval metrics, eval rows and their upserts."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from millrace.functions import text as T
from millrace.operators import intervals


def starts(text: str, part: str | None) -> list[int]:
    """All starts of a part in a text, overlapping ones too; an empty part has none."""
    found, at = [], text.find(part) if part else -1
    while at >= 0:
        found.append(at)
        at = text.find(part, at + 1)
    return found


@F.pandas_udf(ArrayType(LongType()))
def _occurrences(texts: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([starts(t or "", p or "") for t, p in zip(texts, parts)])


def occurrences(text: Column, part: Column) -> Column:
    """All starts (from 0) of a part in a text, overlapping ones too; time follows the text's length."""
    return _occurrences(text, part)


def evidence_spans(evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of (eval_id, doc_id, page_num, quote) with lo and hi of each occurrence in the document's joined text."""
    met = evidence.join(spans, ["doc_id", "page_num"]).filter(F.contains("text", "quote")).withColumn("at", F.explode(occurrences(F.col("text"), F.col("quote"))))
    return met.select("eval_id", "doc_id", "page_num", (F.col("start") + F.col("at")).alias("lo"), (F.col("start") + F.col("at") + F.length("quote")).alias("hi"))


def evidence_in(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """As `evidence_spans`, of documents with bound pages (`chunking.bound`): a document's quotes come to it, and its text stays."""
    asked = evidence.groupBy("doc_id").agg(F.collect_list(F.struct("eval_id", "page_num", "quote")).alias("asked"))
    kinds = [evidence.schema["eval_id"], evidence.schema["page_num"], StructField("lo", LongType()), StructField("hi", LongType())]

    @F.arrow_udf(ArrayType(StructType(kinds)))
    def placed(pages: pa.Array, asked: pa.Array) -> pa.Array:
        own, quotes = pages.flatten(), asked.flatten()
        numbers, texts = own.field("page_num").to_pylist(), own.field("text").to_pylist()
        of, parts = quotes.field("page_num").to_pylist(), quotes.field("quote").to_pylist()
        i = first = 0
        row, lo, hi, ends = [], [], [], [0]
        for n, m in zip(pages.value_lengths().to_pylist(), asked.value_lengths().to_pylist()):
            here, at = {}, 0
            for number, text in zip(numbers[i : i + n], texts[i : i + n]):
                here.setdefault(number, []).append((at, text))
                at += len(text) + 1
            i += n
            for j in range(first, first + m):
                for start, text in here.get(of[j], ()):
                    for k in starts(text, parts[j]):
                        row.append(j)
                        lo.append(start + k)
                        hi.append(start + k + len(parts[j]))
            first += m
            ends.append(len(row))
        found = [*(quotes.field(c).take(pa.array(row, pa.int64())) for c in ("eval_id", "page_num")), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(found, ["eval_id", "page_num", "lo", "hi"]))

    met = documents.join(asked, "doc_id").select("doc_id", F.explode(placed("pages", "asked")).alias("f"))
    return met.select("f.eval_id", "doc_id", "f.page_num", "f.lo", "f.hi")


def _chunk_spans(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_id, s, e of chunks with their text or their end_index; chunks with a negative start hold nothing."""
    end = F.col("end_index") if "end_index" in chunks.columns else F.col("start_index") + F.length("text")
    own = chunks.select("doc_id", "chunk_id", F.col("start_index").cast("long").alias("s"), end.cast("long").alias("e"))
    return own.filter("s >= 0")


def relevant_chunks(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """eval_id, doc_id, chunk_id: chunks that hold some occurrence whole. Chunks with a negative start hold nothing."""
    met = intervals.holding(evidence.select("eval_id", "doc_id", "lo", "hi"), _chunk_spans(chunks), ["doc_id"])
    return met.select("eval_id", "doc_id", "chunk_id").distinct()


def page_overlaps(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, page_num, chunk_id of chunks that share characters with a page."""
    pages = spans.select("doc_id", "page_num", "start", "end")
    return intervals.overlapping(pages, _chunk_spans(chunks), ["doc_id"], "start", "end").select("doc_id", "page_num", "chunk_id")


def grade(ranking: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """Per qid: recall_at_1..k, mrr, ndcg, first_relevant_rank, evidence_covered. ranking: qid, idx, rk; relevant: qid, idx."""
    hits = ranking.filter(F.col("rk") <= k).join(relevant.withColumn("hit", F.lit(1)), ["qid", "idx"])
    first = F.min("rk")
    found = hits.groupBy("qid").agg(first.cast("long").alias("first"), F.sum(1 / F.log2(F.col("rk") + 1.0)).alias("dcg"))
    wanted = relevant.groupBy("qid").agg(F.count("*").alias("n"))
    rows = queries.select("qid").join(found, "qid", "left").join(wanted, "qid", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return rows.select(
        "qid", *[F.coalesce((F.col("first") <= j).cast("long"), F.lit(0)).cast("long").alias(f"recall_at_{j}") for j in range(1, k + 1)],
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.round(F.col("dcg") / ideal, 9), F.lit(0.0)).alias("ndcg"),
        F.col("first").alias("first_relevant_rank"), F.col("n").isNotNull().alias("evidence_covered"),
    )


def mean_metrics(graded: DataFrame, *columns: str) -> DataFrame:
    return graded.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in columns])


def valid_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages whose eval rows may stay: three of them, trimmed and non-empty, quotes verbatim in the page, answers in their
    quotes, three different queries."""
    trimmed = rows.select("doc_id", "page_num", *[T.normalize(F.col(c)).alias(c) for c in ("query", "answer", "quote")])
    met = trimmed.join(pages, ["doc_id", "page_num"], "left")
    good = (F.col("query") != "") & (F.col("answer") != "") & (F.col("quote") != "") & F.contains("text", "quote") & T.contains_ignoring_case(F.col("quote"), F.col("answer"))
    judged = met.groupBy("doc_id", "page_num").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("good"), F.count("*").alias("n"), F.count_distinct(F.lower("query")).alias("queries"))
    return judged.select("doc_id", "page_num", (F.col("good") & (F.col("n") == 3) & (F.col("queries") == 3)).alias("accepted"))


def upsert(old: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not in incoming, and all of incoming."""
    return old.join(incoming.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(incoming)


def set_errors(errors: DataFrame, updates: DataFrame) -> DataFrame:
    """Page messages (digest, page_num, message): a message replaces, null clears, another digest's messages go."""
    kept = errors.join(updates.select("digest").distinct(), "digest", "left_semi").join(updates.select("digest", "page_num"), ["digest", "page_num"], "left_anti")
    return kept.unionByName(updates.filter("message is not null").withColumn("message", T.squeeze(F.col("message"))))


def pages_to_do(pages: DataFrame, rows: DataFrame, first: int, last: int, complete: int = 3) -> DataFrame:
    """doc_id, page_num, state of the pages in range: done (exactly `complete` rows), skipped (no text) or todo."""
    counts = rows.groupBy("doc_id", "page_num").agg(F.count("*").alias("n"))
    own = pages.filter(F.col("page_num").between(first, last)).join(counts, ["doc_id", "page_num"], "left")
    state = F.when(F.col("text") == "", "skipped").when(F.col("n") == complete, "done").otherwise("todo")
    return own.select("doc_id", "page_num", state.alias("state"))


def page_rows(rows: DataFrame, page: int, scored: bool = True) -> DataFrame:
    """The eval rows of a page, those with scores only if asked."""
    return rows.filter((F.col("page_num") == page) & (F.col("recall_at_3").isNotNull() if scored else F.lit(True)))


def checked_evals(rows: DataFrame, digest: str) -> DataFrame:
    """The rows, or an error when run if any has another digest."""
    same = F.assert_true(F.col("pdf_sha256").eqNullSafe(F.lit(digest)), "eval rows belong to another file")
    return rows.filter(same.isNull())
