"""Mixing sources to target weights over a time-varying curriculum, in DataFrame functions only.

Each source has a weight schedule over training time 0..1 (piecewise linear). The schedules' integrals are the
sources' weights; water-filling turns them into word targets of at most `max_epochs` times a source's size. A source's
documents, in a pseudo-random order fixed by doc_id and text and repeated up to `max_epochs` times, form its word stream; the
stream ends at the target. Word number q of a source's demand is trained at the time where the integral of its schedule
reaches q, so inverting the integral gives each document's position.

Defined results: a null text has no words; a document without words is never taken; null sources form one source, the
last; repeated rows are separate documents; null and repeated doc_ids are told apart by their texts; an empty table gives an
empty mix; texts of any length are taken whole; other columns, whatever their names, travel inside the struct `row`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import materialise, sums_before

#: Rows of a range of a source's order, about.
RANGE_ROWS = 1000
#: Knots (time, weight) of the schedules that sources take in turn: early, steady and late. Integrals 1, 2, 3.
CURRICULUM = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 1.5), (1.0, 4.5)))


def integral(knots) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))


def _segments(knots) -> Column:
    """A schedule as segments (t0, weight, slope, share before, share after), scaled so that its integral is 1."""
    whole, done, out = integral(knots), 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        share = (t1 - t0) * (w0 + w1) / 2 / whole
        if share > 0:
            out.append((t0, w0 / whole, (w1 - w0) / (t1 - t0) / whole, done, done + share))
            done += share
    names = ("t0", "w", "slope", "c0", "c1")
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, s)]) for s in out])


def time_of(share: Column, segments: Column) -> Column:
    """The time at which a schedule's integral reaches `share`: the root of its quadratic segment."""
    s = F.coalesce(F.get(F.filter(segments, lambda x: share < x["c1"]), F.lit(0)), F.element_at(segments, -1))
    d = F.greatest(share - s["c0"], F.lit(0.0))
    root = s["w"] + F.sqrt(F.greatest(s["w"] * s["w"] + 2 * s["slope"] * d, F.lit(0.0)))
    return s["t0"] + F.when(root > 0, 2 * d / root).otherwise(F.lit(0.0))


def source_targets(sources: DataFrame, cycle=CURRICULUM, max_epochs: int = 3) -> DataFrame:
    """Targets of (key, source_size): one row per source; there may be as many sources as urls or users.

    Water level: with sources by rising cap / weight, the level is the largest of (all words - caps before) / weights
    from here on; a source's target is the lesser of its cap and weight * level.
    """
    named = sums_before(sources, [F.col("key") == "", "key"], {"place": F.lit(1)}, "source-places")
    k = F.col("place") % len(cycle)
    weight, segments = F.lit(integral(cycle[-1])), _segments(cycle[-1])
    for i, knots in enumerate(cycle[:-1]):
        weight = F.when(k == i, F.lit(integral(knots))).otherwise(weight)
        segments = F.when(k == i, _segments(knots)).otherwise(segments)
    ranked = named.select("key", "source_size", "place", weight.alias("weight"), (F.lit(max_epochs) * F.col("source_size")).alias("cap"))
    by_cap = [F.col("cap") / F.col("weight"), F.col("key")]
    ranked = sums_before(ranked, by_cap, {"caps": F.col("cap"), "weights": F.col("weight"), "words": F.col("source_size")}, "source-levels")
    level = ranked.agg(F.max((F.col("words_all") - F.col("caps")) / (F.col("weights_all") - F.col("weights")))).first()[0]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level or 0)))
    demand = F.least(F.col("cap"), F.floor(target + F.lit(0.5)))
    return ranked.select("key", "source_size", target.alias("target"), demand.alias("demand"), segments.alias("segments"))


def mix(docs: DataFrame, size: Column, doc_id="doc_id", source="source", tie: Column | None = None, cycle=CURRICULUM, max_epochs: int = 3, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each row as `row` (a struct of docs' columns) with size, source_size, target, taken, order and copies.

    copies: array of (copy, words, position). tie: tells rows of one doc_id, or of none, apart. Prefix sums run within
    ranges of the order key, about `range_rows` rows each if all are of one source, and over the ranges' totals, so that a
    hot source is spread.
    """
    key = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source)))
    order = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("/"), F.lit("") if tie is None else tie))
    digits = max(1, math.ceil(math.log(max(1, docs.count() / range_rows), 16)))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), order.alias("order"), size.alias("size"))
    rows = rows.withColumn("range", F.substring("order", 1, digits))
    sizes = docs.select(key.alias("key"), F.substring(order, 1, digits).alias("range"), size.alias("size"))
    # At most 16^digits rows a source, a small part of the rows, written once: two aggregations use them, and the texts are counted for one.
    ranges = materialise(sizes.groupBy("key", "range").agg(F.sum("size").alias("range_size")), "ranges")
    # Sums before a range come from parts of the order of all ranges, less those before its source: no task holds a hot source's.
    placed = sums_before(ranges, [F.col("key"), F.col("range")], {"base": F.col("range_size")}, "range-sums")
    placed = materialise(placed.select("key", "range", "range_size", "base"), "range-places")
    sources = placed.groupBy("key").agg(F.sum("range_size").alias("source_size"), F.min("base").alias("start"))
    targets = source_targets(sources.select("key", "source_size"), cycle, max_epochs).join(sources.select("key", "start"), "key")
    plan = placed.join(targets, "key").withColumn("base", F.col("base") - F.col("start")).drop("range_size", "start")
    within = Window.partitionBy("key", "range").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(plan, ["key", "range"])
    out = out.withColumn("before", F.col("base") + F.sum("size").over(within) - F.col("size"))
    has = F.col("source_size") > 0
    full = F.when(has, F.expr("demand div nullif(source_size, 0)")).otherwise(F.lit(0))
    out = out.withColumn("full", full)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("demand") - F.col("full") * F.col("source_size") - F.col("before")))
    out = out.withColumn("part", part)
    n = F.when(F.col("size") > 0, F.col("full") + (F.col("part") > 0).cast("long")).otherwise(F.lit(0))

    def copy(k):
        share = (k * F.col("source_size") + F.col("before")) / F.col("demand")
        words = F.when(k < F.col("full"), F.col("size")).otherwise(F.col("part"))
        return F.struct(k.alias("copy"), words.alias("words"), time_of(share, F.col("segments")).alias("position"))

    copies = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), copy)).otherwise(F.expr("array()"))
    taken = F.col("size") * F.col("full") + F.col("part")
    return out.select("row", "size", "source_size", "target", taken.alias("taken"), "order", copies.alias("copies"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n), "")


def mixed_documents(docs: DataFrame, size: Column, text="text", n_chars="n_chars", **options) -> DataFrame:
    """The mix as documents in training order: a row per copy; a copy that the target cuts short ends there."""
    columns = docs.columns
    made = mix(docs, size, tie=F.md5(F.coalesce(F.col(text), F.lit(""))), **options).select("row", "size", "order", F.explode("copies").alias("c"))
    cut = F.col("c.words") < F.col("size")
    made = made.select("row", "order", "c", F.when(cut, first_words(F.col(f"row.{text}"), F.col("c.words").cast("int"))).alias("cut"))
    changed = {text: F.coalesce(F.col("cut"), F.col(f"row.{text}"))}
    if n_chars in columns:
        changed[n_chars] = F.when(F.col("cut").isNotNull(), F.length("cut").cast(docs.schema[n_chars].dataType)).otherwise(F.col(f"row.{n_chars}"))
    made = made.orderBy("c.position", "order", "c.copy")
    return made.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in columns])
