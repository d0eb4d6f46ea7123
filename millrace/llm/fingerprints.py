"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's weighted terms are its words with their counts. For a term and a lane, r and c are Gamma(2, 1) and b is uniform,
all from hashes of term and lane; with weight S, t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1). The term with the
least a is the lane's sample, and (term, t) its code: two texts' codes agree with the probability sum(min) / sum(max) of
their weights, the generalised Jaccard similarity. Terms are 64-bit hashes of words.

Rows are ordered within ranges of falling doc_id whose heads are doc_ids of the table; a range's first document also goes to
the range before it, as a ghost behind its last, so that "the next document" needs no other range. Ranges are found in two
steps, whatever their number: a binary search in at most `COARSE` percentiles, one literal that is parsed once, and one in the heads
of that coarse range, which are rows of a small table (8 bytes a range), made by Spark and met by an equi-join.

Defined results: a null text is empty; a text without words has the code ffffffff in every lane; of rows with equal doc_id
the lesser text comes first; null doc_ids come last, by the hashes of their texts; a single row is its own next; an empty table
gives an empty result; texts of any length are taken whole, by their words' counts; other columns, whatever their names, stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import SPACE, materialise

LANES, GROUP = 32, 8
#: Documents in a range, about; the most coarse ranges; and the most ranges whose heads are broadcast (8 bytes each).
RANGE_ROWS, COARSE, BROADCAST_HEADS = 1500, 1 << 14, 1 << 24
#: The heads that a search in a coarse range tells apart: those of more documents than an array of keys holds.
MOST_HEADS = (1 << 21) - 1


def order_key(doc_id: str, text: str) -> Column:
    """doc_id; of a row without one a number below -2^62 - 2^61 by its text's hash, so that many such rows part into ranges, too."""
    spread = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 3)
    return F.coalesce(F.col(doc_id).cast("long"), spread - F.lit(1 << 62) - F.lit(1 << 62))


def longs(values: list, kind: str = "bigint") -> Column:
    """The array of the numbers: one literal that is parsed once, not a literal for each."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>") if values else F.expr(f"cast(array() as array<{kind}>)")


def count_not_below(values: Column, key: Column, most: int) -> Column:
    """How many of the falling values, at most `most`, are >= key, by binary search."""
    steps = longs([1 << i for i in range(max(1, most).bit_length() - 1, -1, -1)], "int")
    reached = lambda lo, s: (lo + s <= F.size(values)) & (F.get(values, lo + s - 1) >= key)
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when(reached(lo, s), lo + s).otherwise(lo))


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the falling cuts are >= key, less one, by binary search."""
    return count_not_below(longs(cuts), key, len(cuts)) - 1 if len(cuts) > 1 else F.lit(0)


def with_searched(rows: DataFrame, name: str, found: Column) -> DataFrame:
    """The rows with a searched column that may be a join's key. It comes from a generator, so that the optimizer holds no equation
    of it with its search: where it did, it put a filter on the search at times on the join's other side, which lacks the key."""
    return rows.select("*", F.explode(F.array(found)).alias(name))


def coarse_cuts(keys: DataFrame, range_rows: int) -> tuple[list[int], int]:
    """Falling percentiles of the column `key`, the largest key first, at most `COARSE`; and about how many ranges there will be."""
    n, most = keys.agg(F.count("key"), F.max("key")).first()
    if not n:
        return [], 0
    ranges = max(1, n // range_rows)
    parts = min(COARSE, ranges)
    at = keys.agg(F.percentile_approx("key", longs([i / parts for i in range(1, parts + 1)], "double"), F.lit(20 * parts))).first()[0]
    return sorted({most, *at}, reverse=True), ranges


def range_heads(keys: DataFrame, cuts: list[int], range_rows: int) -> DataFrame:
    """coarse, base, heads, total: the largest keys of a coarse range's ranges, falling, and how many ranges there are before it and
    in all. The keys of a coarse range, 8 bytes each, are sorted in one task; a row for each of them meets in one."""
    held = keys.groupBy(range_of(F.col("key"), cuts).alias("coarse")).agg(F.sort_array(F.collect_list("key"), asc=False).alias("k"))
    every = F.sequence(F.lit(0), F.size("k") - 1, F.lit(range_rows))
    held = held.select("coarse", F.array_distinct(F.transform(every, lambda i: F.get("k", i))).alias("heads"))
    by = Window.partitionBy(F.lit(0)).orderBy("coarse")
    before = F.coalesce(F.sum(F.size("heads")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.size("heads")).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return materialise(held.select("coarse", before.alias("base"), "heads", total.alias("total")), "range-heads")


def with_next(docs: DataFrame, doc_id="doc_id", text="text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """range, place, ghost, doc_id, text, next_text: the rows of each range in falling key, ghosts last."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), order_key(doc_id, text).alias("key"))
    cuts, ranges = coarse_cuts(rows.select("key"), range_rows)
    heads = range_heads(rows.select("key"), cuts, range_rows)
    heads = F.broadcast(heads) if ranges <= BROADCAST_HEADS else heads
    met = with_searched(rows, "coarse", range_of(F.col("key"), cuts)).join(heads, "coarse")
    fine = count_not_below(F.col("heads"), F.col("key"), MOST_HEADS) - 1
    met = met.withColumn("fine", fine).withColumn("first", F.get("heads", F.col("fine")) == F.col("key"))
    met = met.select("doc_id", "text", "key", (F.col("base") + F.col("fine")).alias("own"), "first", "total")
    own = F.struct(F.col("own").alias("range"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.pmod(F.col("own") - 1, F.col("total")).alias("range"), F.lit(True).alias("ghost"))
    met = met.select("doc_id", "text", "key", F.explode(F.when(F.col("first"), F.array(own, ghost)).otherwise(F.array(own))).alias("r"))
    met = met.select("doc_id", "text", "key", "r.range", "r.ghost")
    # doc_id adds nothing to the order, but keeps the exchange alike for all that reads these rows, so that it is reused.
    order = Window.partitionBy("range").orderBy("ghost", F.col("key").desc(), "doc_id", "text")
    return met.withColumn("place", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order)).drop("key")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third of code points replaced by the first as many of the following text."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(F.coalesce(following, F.lit("")), F.lit(1), third))


def _uniform(bits: Column, shift: int, width: int) -> Column:
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) if shift + width < 64 else F.shiftrightunsigned(bits, shift)
    return (part + F.lit(0.5)) * F.lit(2.0**-width)


def signatures(texts: DataFrame, keys: list[str], names: list[str], lanes: int = LANES) -> DataFrame:
    """keys with an array of lane codes for each text column of `names`. keys name a row; rows of `texts` must be
    partitioned by some of them, and are not moved again."""
    which = F.posexplode(F.array(*names)).alias("which", "one")
    words = texts.select(*keys, which).select(*keys, "which", F.explode(F.split("one", SPACE)).alias("word"))
    words = words.select(*keys, "which", F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))
    weights = [F.sum((F.col("which") == i).cast("int")).alias(f"w{i}") for i in range(len(names))]
    terms = words.groupBy(*keys, "term").agg(*weights)
    logs = [F.when((F.col(f"w{i}") > 0) & F.col("term").isNotNull(), F.log(f"w{i}")).alias(f"l{i}") for i in range(len(names))]
    terms = terms.select(*keys, "term", *logs, F.explode(F.array(*[F.lit(g) for g in range(lanes // GROUP)])).alias("lane"))
    drawn = [*keys, "lane", "term", *[f"l{i}" for i in range(len(names))]]
    for i in range(GROUP):
        x = F.xxhash64("term", F.col("lane") * (2 * GROUP) + 2 * i)
        y = F.xxhash64("term", F.col("lane") * (2 * GROUP) + 2 * i + 1)
        drawn += [
            (-F.log(_uniform(x, 0, 21) * _uniform(x, 21, 21))).alias(f"r{i}"),
            _uniform(x, 42, 22).alias(f"b{i}"),
            F.log(-F.log(_uniform(y, 0, 32) * _uniform(y, 32, 32))).alias(f"c{i}"),
        ]
    drawn = terms.select(*drawn)
    # The least ln a, as the upper 32 bits of a long, brings its code along in the lower 32.
    samples = []
    for k in range(len(names)):
        for i in range(GROUP):
            t = F.floor(F.col(f"l{k}") / F.col(f"r{i}") + F.col(f"b{i}"))
            a = F.col(f"c{i}") - F.col(f"r{i}") * (t - F.col(f"b{i}") + F.lit(1.0))
            code = F.xxhash64("term", t).bitwiseAND(F.lit(0xFFFFFFFF))
            samples.append(F.min(F.shiftleft(F.floor((a + 128.0) * F.lit(float(1 << 23))), 32).bitwiseOR(code)).alias(f"s{k}_{i}"))
    least = drawn.groupBy(*keys, "lane").agg(*samples)
    codes = [F.transform(F.array(*[f"s{k}_{i}" for i in range(GROUP)]), lambda v: F.coalesce(v.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0xFFFFFFFF))).alias(f"c{k}") for k in range(len(names))]
    least = least.select(*keys, "lane", *codes)
    ordered = [F.flatten(F.array_sort(F.collect_list(F.struct("lane", F.col(f"c{k}").alias("codes"))))["codes"]).alias(f"sig_{n}") for k, n in enumerate(names)]
    return least.groupBy(*keys).agg(*ordered)


def likeness(a: Column, b: Column) -> Column:
    """The share of lanes in which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a).cast("double")


def printed(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def fingerprint_neighbours(docs: DataFrame, doc_id="doc_id", text="text", lanes: int = LANES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256 and the signatures of each text, its edited text and the next document's text."""
    rows = with_next(docs, doc_id, text, range_rows)
    rows = rows.select("range", "place", "ghost", "doc_id", "text", edited(F.col("text"), F.col("next_text")).alias("edited"))
    facts = rows.select("range", "place", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    made = facts.join(signatures(rows, ["range", "place"], ["text", "edited"], lanes), ["range", "place"])
    order = Window.partitionBy("range").orderBy("place")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = made.withColumn("sig_next", F.coalesce(F.lead("sig_text").over(order), F.first("sig_text").over(whole)))
    return made.filter(~F.col("ghost")).select("doc_id", "n_chars", "edited_sha256", "sig_text", "sig_edited", "sig_next")
