"""The question workflow: protect, route, retrieve, grade, rewrite at most twice, expand, answer, verify or escalate.

All questions go through each round as one DataFrame; a round splits them by condition. The model is a set of Column
functions, so another model is another class with the same three methods.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import retrieval

# Fixed values.
STOPWORDS = ("what", "which", "does", "the", "and", "for", "is", "a", "an", "to")
GENERIC = ("policy", "coverage", "approval", "criteria", "billing", "code", "require", "required", "requirements", "documentation")
STRUCTURED = ("j9033", "billing code", "policy id")
ALIASES = (("chemo", "bendamustine"), ("scan", "advanced imaging"), ("glucose sensor", "continuous glucose monitor"))
SUFFIX = " policy approval criteria billing code"
BOILERPLATE = ("based", "retrieved", "policy", "evidence")
ANSWER = "Based on the retrieved policy evidence: "
NO_ANSWER = "Insufficient verified policy evidence."
ESCALATED = "Automated verification did not pass. Route this request to an authorized reviewer."
EXHAUSTED = "bounded correction attempts exhausted"
SUFFICIENT, SUPPORTED, DEPTH, CONTEXT, CORRECTIONS = 0.35, 0.85, 5, 3, 2


class Model(Protocol):
    """What the workflow asks of a model: Columns from Columns."""

    def rewrite(self, query: Column) -> Column: ...

    def answer(self, context: Column) -> Column: ...

    def coverage(self, answer: Column, context: Column) -> Column: ...


class DeterministicModel:
    """Rewrites by aliases, answers by quoting the context, verifies by shared terms."""

    def rewrite(self, query: Column) -> Column:
        out = F.lower(query)
        for old, new in ALIASES:
            out = F.replace(out, F.lit(old), F.lit(new))
        return F.concat(out, F.lit(SUFFIX))

    def answer(self, context: Column) -> Column:
        return F.when(F.coalesce(context, F.lit("")) == "", NO_ANSWER).otherwise(F.concat(F.lit(ANSWER), context))

    def coverage(self, answer: Column, context: Column) -> Column:
        terms = F.array_except(T.tokens(answer), F.array(*map(F.lit, BOILERPLATE)))
        share = F.size(F.array_intersect(terms, T.tokens(context))) / F.greatest(F.size(terms), F.lit(1))
        return F.when(answer.startswith("Insufficient") | (F.coalesce(context, F.lit("")) == ""), 0.0).otherwise(share)


def route(query: Column) -> Column:
    found = F.lit(False)
    for t in STRUCTURED:
        found = found | F.contains(F.lower(query), F.lit(t))
    return F.when(found, "structured").otherwise("semantic")


def sufficient(query: Column, evidence: Column) -> Column:
    """Whether the evidence (text of the first hits; null without hits) covers enough of the query and its subject."""
    q = F.array_except(T.tokens(query), F.array(*map(F.lit, STOPWORDS)))
    subject = F.array_except(q, F.array(*map(F.lit, GENERIC)))
    e = F.array_distinct(T.tokens(evidence))
    share = F.size(F.array_intersect(q, e)) / F.greatest(F.size(q), F.lit(1))
    return F.coalesce(F.arrays_overlap(subject, e) & (share >= SUFFICIENT), F.lit(False))


def evidence_of(hits: DataFrame, children: DataFrame, top: int = CONTEXT) -> DataFrame:
    met = hits.filter(F.col("rk") <= top).join(children.select("idx", "text"), "idx")
    return met.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rk", "text")))["text"], " ").alias("evidence"))


def cited(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, position, and the cited chunks' columns, in the order of each answer's `ids`; unknown ids go. chunks: chunk_id and what to show."""
    return answers.select("qid", F.posexplode("ids").alias("position", "chunk_id")).join(chunks, "chunk_id")


def event(node: str, details: Column) -> Column:
    return F.array(F.struct(F.lit(node).alias("node"), details.alias("detail")))


def run(questions: DataFrame, children: DataFrame, parents: DataFrame, save, model: Model | None = None, corrections: int = CORRECTIONS) -> DataFrame:
    """(qid, query) to qid, safe_query, route, answer, verified, needs_human_review, correction_count, parent_ids, trace,
    and the last verification_coverage and citations (of parents).

    children: idx, parent_id, text. parents: parent_id, text. A question's state starts anew with it. `save` writes a
    DataFrame to shared storage and reads it back, so that a round's plan does not hold those of the rounds before.
    """
    model = model or DeterministicModel()
    safe = T.redact(F.col("query"))
    rows = questions.select("qid", safe.alias("safe_query"), safe.alias("current"), route(safe).alias("route"), F.concat(event("protect", (safe != F.col("query")).cast("string")), event("route", route(safe))).alias("trace"), F.lit(0.0).alias("seen"), F.expr("cast(array() as array<string>)").alias("cited"))
    rows, finished = save(rows), None
    for attempt in range(corrections + 1):
        hits = save(retrieval.hybrid(children.select("idx", "text"), rows.select("qid", F.col("current").alias("query")), DEPTH, save=save))
        rows = rows.join(evidence_of(hits, children), "qid", "left")
        ids = hits.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rk", F.col("idx").cast("string").alias("i"))))["i"], ",").alias("hit_ids"))
        enough = sufficient(F.col("current"), F.col("evidence"))
        rows = rows.join(ids, "qid", "left").withColumn("enough", enough)
        rows = rows.withColumn("trace", F.concat("trace", event("retrieve", F.coalesce("hit_ids", F.lit(""))), event("grade_retrieval", F.col("enough").cast("string"))))
        context = retrieval.expand_parents(hits, children, parents, CONTEXT).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", "parent_id", "text"))).alias("p"))
        rows = rows.join(context, "qid", "left").withColumn("context", F.array_join("p.text", " "))
        rows = rows.withColumn("answer", F.when(F.col("enough"), model.answer(F.col("context"))))
        rows = rows.withColumn("coverage", F.when(F.col("enough"), model.coverage(F.col("answer"), F.col("context"))))
        rows = rows.withColumn("verified", F.coalesce(F.col("coverage") >= SUPPORTED, F.lit(False)))
        steps = F.concat(event("expand_parent", F.array_join(F.col("p.parent_id").cast("array<string>"), ",")), event("generate", F.size("p").cast("string")), event("verify", F.col("verified").cast("string")))
        rows = rows.withColumn("trace", F.when(F.col("enough"), F.concat("trace", steps)).otherwise(F.col("trace")))
        rows = rows.withColumns({"seen": F.coalesce("coverage", "seen"), "cited": F.when(F.col("enough"), F.coalesce(F.col("p.parent_id").cast("array<string>"), "cited")).otherwise(F.col("cited"))})
        rows, last = save(rows), attempt == corrections
        out = rows if last else rows.filter("verified")
        out = out.select(
            "qid", "safe_query", "route", F.when(F.col("verified"), F.col("answer")).otherwise(ESCALATED).alias("answer"), "verified", (~F.col("verified")).alias("needs_human_review"),
            F.lit(attempt).cast("long").alias("correction_count"), F.when(F.col("verified"), F.array_join(F.col("p.parent_id").cast("array<string>"), ",")).alias("parent_ids"),
            F.when(F.col("verified"), F.col("trace")).otherwise(F.concat("trace", event("human_review", F.lit(EXHAUSTED)))).alias("trace"),
            F.col("seen").alias("verification_coverage"), F.col("cited").alias("citations"),
        )
        finished = out if finished is None else finished.unionByName(out)
        if not last:
            rewritten = model.rewrite(F.col("current"))
            rows = rows.filter("not verified").select("qid", "safe_query", "route", rewritten.alias("current"), F.concat("trace", event("rewrite", rewritten)).alias("trace"), "seen", "cited")
    return finished
