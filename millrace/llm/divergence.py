"""Audit of how sources of one language differ in their words: chi-square-like divergences of smoothed term shares.

Terms are counted block by block in Arrow batches, so that what is shuffled are sums of blocks. Each kept term of a language
is pivoted into a wide vector, an array of its counts indexed by source. Terms with equal vectors are taken together, with how
many they are. Higher-order functions turn a vector into the contributions of every pair of sources, one source
at a time, and map-side aggregation sums them; shares are integers of a billionth, so all sums are exact.

A language's facts (names, counts and V) are a row of arrays, joined by language and salt: no task needs all terms of a language.
The same vectors, pulled apart again, give each source's most outstanding terms; only the first `ranks` of a part go on.

Defined results: null text, language and source are ''; equal values rank by item in UTF-8 order; repeated rows are separate
documents; a source without kept terms has all the shares of nought; a language without kept terms has pairs of value 0; an empty
table gives an empty result; texts of any length are counted whole; other columns, whatever their names, stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import blocks, materialise, no_collection

#: Documents of a language that must hold a term, the scale of shares, and the terms listed of a source.
LEAST_DOCS, SCALE, TERM_RANKS = 3, 1_000_000_000, 200
#: Bytes of text whose counts a task sums before it hands them on, and the parts a hot language is dealt to.
BLOCK_BYTES, SALTS = 32 << 20, 32
#: ASCII letters, in lower case, and all bytes of other characters are terms; the rest parts them.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of letters and characters beyond ASCII, only A-Z lower-cased, in UTF-8."""
    return (text or "").encode().translate(_LETTERS).split()


class BlockCounts:
    """Counts of the texts of a block: how often each group (language, source) has each term, and in how many documents."""

    def __init__(self):
        self.groups, self.numbers, self.sums, self.size = {}, {}, [], 0

    def add(self, groups: list[tuple[str, str]], texts: list[str | None]) -> None:
        own = [terms(t) for t in texts]
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        lengths = np.array([len(x) for x in own], np.int64)
        self.size += sum(len(t) for t in texts if t)
        if not lengths.sum():
            return
        codes = pa.array([x for w in own for x in w], pa.binary()).dictionary_encode()
        number = np.array([self.numbers.setdefault(x, len(self.numbers)) for x in codes.dictionary.to_pylist()], np.int64)
        # How often each document has each term; then sums by group and term. Numbers of a block are far below 2^31.
        pairs, n = np.unique((np.repeat(np.arange(len(own)), lengths) << 32) | number[codes.indices.to_numpy()], return_counts=True)
        self._keep((group[pairs >> 32] << 32) | (pairs & 0xFFFFFFFF), n, np.ones(len(n), np.int64))

    def _keep(self, key, n, docs) -> None:
        key, at = np.unique(key, return_inverse=True)
        self.sums.append((key, *(np.bincount(at, x, len(key)).astype(np.int64) for x in (n, docs))))

    def batch(self) -> pa.RecordBatch:
        """The sums, and for each group a row without a term."""
        groups, names = list(self.groups), list(self.numbers)
        if self.sums:
            self._keep(*(np.concatenate(x) for x in zip(*self.sums)))
        key, n, docs = self.sums[-1] if self.sums else (np.zeros(0, np.int64),) * 3
        of = [groups[g] for g in (key >> 32).tolist()] + groups
        word = pa.array([names[t].decode() for t in (key & 0xFFFFFFFF).tolist()] + [None] * len(groups), pa.string())
        n, docs = (pa.array(np.concatenate([x, np.zeros(len(groups), np.int64)])) for x in (n, docs))
        return pa.RecordBatch.from_arrays([*(pa.array([g[k] for g in of], pa.string()) for k in (0, 1)), word, n, docs], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, lang="lang", source="source", text="text") -> DataFrame:
    """lang, source, term, n, docs of blocks of texts, to be summed; a group's row with a null term says that it occurs."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]

    def run(batches):
        held = BlockCounts()
        for part in blocks(batches, "text"):
            with no_collection():
                langs, sources, texts = (c.to_pylist() for c in part.columns)
                held.add(list(zip(langs, sources)), texts)
            if held.size >= BLOCK_BYTES:
                yield held.batch()
                held = BlockCounts()
        if held.groups:
            yield held.batch()

    return docs.select(*named, F.col(text).cast("string").alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, size: Column, terms: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + 1) / (size + terms)), exact for any longs: in longs where the product is one, else in decimals."""
    whole = size + terms
    wide = F.call_function("div", F.lit(scale).cast("decimal(12,0)") * (count + 1).cast("decimal(20,0)"), whole.cast("decimal(20,0)"))
    return 1 + F.when(count < (1 << 63) // scale - 1, F.call_function("div", F.lit(scale).cast("long") * (count + 1), whole)).otherwise(wide)


def squared(p: Column, q: Column) -> Column:
    return (p - q) * (p - q)


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of shares."""
    return F.call_function("div", squared(p, q), q)


def wide_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, **columns) -> tuple[DataFrame, DataFrame]:
    """(lang, term, counts, total) of the kept terms, counts by source, and (lang, groups, sizes, size, terms) of the languages.

    groups: sources in UTF-8 order with the sums of their counts; sizes: the same as a map; terms: how many are kept.
    """
    # Blocks are summed already: one exchange by language and term serves both aggregations. The row without a term stays.
    cells = term_counts(docs, **columns).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    wide = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"), F.sum("n").alias("total"))
    wide = wide.filter((F.col("docs") >= least_docs) | F.col("term").isNull()).select("lang", "term", F.map_from_entries("cells").alias("counts"), "total")
    wide = materialise(wide, "wide-terms")
    groups = wide.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    wide = wide.filter(F.col("term").isNotNull())
    groups = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"), F.sum("n").alias("size"))
    kept = wide.groupBy("lang").agg(F.count("*").alias("terms"))
    facts = groups.join(kept, "lang", "left").select("lang", "groups", F.map_from_entries("groups").alias("sizes"), "size", F.coalesce("terms", F.lit(0)).cast("long").alias("terms"))
    return wide, materialise(facts, "languages")


def _with_facts(wide: DataFrame, facts: DataFrame) -> DataFrame:
    """Each term with the facts of its language; a language's terms are dealt to `SALTS` keys."""
    salted = facts.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return wide.withColumn("salt", F.pmod(F.hash("term"), F.lit(SALTS))).join(salted, ["lang", "salt"])


def pair_divergences(wide: DataFrame, facts: DataFrame) -> DataFrame:
    """lang, source, item, value: for every ordered pair of a language's sources the sum of excesses over its kept terms."""
    shares = F.transform("groups", lambda g: share(F.coalesce(F.element_at("counts", g["source"]), F.lit(0)), g["n"], F.col("terms")))
    vectors = _with_facts(wide, facts).select("lang", shares.alias("p")).groupBy("lang", "p").agg(F.count("*").alias("times"))
    # A vector that counts for nothing brings in the pairs of languages without kept terms.
    none = facts.select("lang", F.transform("groups", lambda g: F.lit(1).cast("long")).alias("p"), F.lit(0).cast("long").alias("times"))
    one = vectors.unionByName(none).select("lang", "p", "times", F.posexplode("p").alias("i", "own"))
    later = F.slice("p", F.col("i") + 2, F.greatest(F.size("p") - F.col("i") - 1, F.lit(0)))
    # Of each pair the share and the square that both of its ways have; the sums divide it, floored, by either share.
    both = F.transform(later, lambda q: F.struct(q.alias("q"), squared(F.col("own"), q).alias("square")))
    pairs = one.select("lang", "i", "own", "times", F.posexplode(both).alias("k", "c")).select("lang", "i", (F.col("i") + 1 + F.col("k")).alias("j"), "own", "times", "c.q", "c.square")
    way = lambda q: F.sum(F.call_function("div", F.col("square"), F.col(q)) * F.col("times"))
    pairs = pairs.groupBy("lang", "i", "j").agg(way("q").alias("there"), way("own").alias("back"))
    ways = F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b"), F.col("there").alias("value")), F.struct(F.col("j").alias("a"), F.col("i").alias("b"), F.col("back").alias("value"))))
    pairs = pairs.select("lang", ways.alias("w")).select("lang", "w.*")
    names = facts.select("lang", F.posexplode(F.transform("groups", lambda g: g["source"])).alias("at", "name"))
    a, b = names.select("lang", F.col("at").alias("a"), F.col("name").alias("source")), names.select("lang", F.col("at").alias("b"), F.col("name").alias("item"))
    return pairs.join(a, ["lang", "a"]).join(b, ["lang", "b"]).select("lang", "source", "item", "value")


def outstanding_terms(wide: DataFrame, facts: DataFrame) -> DataFrame:
    """lang, source, item, value: terms that a source has and whose share there is above that of its language."""
    rows = _with_facts(wide, facts).select("lang", "term", "total", "size", "terms", "sizes", F.explode("counts").alias("source", "n"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.element_at("sizes", F.col("source")), F.col("terms")).alias("p"), share(F.col("total"), F.col("size"), F.col("terms")).alias("q"))
    return rows.filter(F.col("p") > F.col("q")).select("lang", "source", "item", excess(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = TERM_RANKS, **columns) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language, and the first outstanding terms."""
    wide, facts = wide_terms(docs, least_docs, **columns)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = [rows.withColumn("rank", F.row_number().over(order)) for rows in (pair_divergences(wide, facts), outstanding_terms(wide, facts))]
    out[1] = out[1].filter(F.col("rank") <= ranks)
    return out[0].withColumn("part", F.lit("pair")).unionByName(out[1].withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
