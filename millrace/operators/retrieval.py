"""Lexical and dense ranking. Corpora are (idx, text), queries (qid, query); idx is the corpus order that breaks ties.

Only tokens that some query has leave a document's row, so what is shuffled follows the queries, not the corpus. A text's tokens
are counted in one pass of it. The first k of a BM25 list come from an index of block bounds: documents are dealt to small blocks,
and the most promising blocks of a query set a bar. Blocks, and then documents, whose largest impacts can't reach it are left out,
and frequent tokens that can't reach it by themselves are looked up for the remaining documents only. Cosine lists and fused ranks
score all pairs that share a token, in blocks that the pairs do not leave: the first of a query and counts do. The others' ranks
follow in corpus order and are computed, not joined. No join has a hint: Spark broadcasts by the bytes it measures.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as T

# Fixed values of BM25 and of reciprocal-rank fusion.
K1, B, RRF = 1.5, 0.75, 60
#: Digits that scores keep before ranking: engines add in different orders.
DIGITS = 9
#: Documents of a block of the index, and the most promising blocks of a query that set its bar.
BLOCK, PROMISING = 64, 2
#: Tokens of the rows that leave a task together.
HELD_TOKENS = 1 << 18
#: Postings of the corpus and queries of a block of scores, and the scores and products of a tile of it.
POSTINGS, ASKED, CELLS = 1 << 20, 4096, 1 << 21
#: The most tasks over pairs of blocks.
TASKS = 4096
#: Vectors of a block of a dense search.
VECTORS = 16384


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, tok, tf, size, norm: a row for each different token of a row, with the number of the row's tokens and the root of
    the sum of their squared counts. For each batch there is besides a row without key and token, whose tf is the number of the
    batch's tokens and whose size is that of its rows, so that figures of the whole corpus need no second pass."""
    import pyarrow as pa

    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        find = re.compile(T.TOKEN).findall
        for batch in batches:
            total, held = 0, ([], [], [], [], [], [])  # places, lengths, tokens, counts, sizes, norms
            for at, text in enumerate(batch.column(1).to_pylist()):
                toks = find(text.lower()) if text else ()
                if toks:
                    counts = Counter(toks)
                    total += len(toks)
                    held[0].append(at), held[1].append(len(counts)), held[4].append(len(toks)), held[5].append(math.sqrt(sum([n * n for n in counts.values()])))
                    held[2].extend(counts), held[3].extend(counts.values())
                if len(held[2]) > HELD_TOKENS:
                    yield made(batch, *held)
                    held = ([], [], [], [], [], [])
            yield made(batch, *held)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.column(0).type), pa.array([None], pa.string()), pa.array([total]), pa.array([batch.num_rows]), pa.array([0.0])], names=[key, "tok", "tf", "size", "norm"])

    def made(batch, places, lengths, toks, counts, sizes, norms):
        import numpy as np

        spread = lambda x, t: np.repeat(np.asarray(x, t), np.asarray(lengths, np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(spread(places, np.int64))), pa.array(toks, pa.string()), pa.array(counts, pa.int64()), pa.array(spread(sizes, np.int64)), pa.array(spread(norms, float))], names=[key, "tok", "tf", "size", "norm"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, tok string, tf long, size long, norm double")


def windows(rows: DataFrame, key: str, text: str, width: int = 8, only_first: bool = False) -> DataFrame:
    """key, head: a 64-bit number for each different run of `width` tokens of a row (all of them if it has fewer), or for the first
    run only. Equal runs have equal numbers; different ones may, so what meets by them has to be confirmed."""
    import pyarrow as pa

    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        import zlib

        import numpy as np

        find, known = re.compile(T.TOKEN).findall, {}
        factors = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j in range(width)]
        for batch in batches:
            places, held = [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                toks = find((text or "").lower())
                if only_first:
                    toks = toks[:width]
                if len(known) > HELD_TOKENS:
                    known.clear()
                for t in set(toks).difference(known):
                    known[t] = zlib.crc32(t.encode()) << 32 | zlib.crc32(t.encode()[::-1])
                h = np.array([known[t] for t in toks], np.uint64)
                n = max(1, len(h) - width + 1)
                head = np.zeros(n, np.uint64)
                for j in range(min(width, len(h))):
                    head += h[j : j + n] * factors[j]
                head = np.unique(head)
                places.append(np.full(len(head), at))
                held.append(head)
            if places:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(places))), pa.array(np.concatenate(held).view(np.int64))], names=[key, "head"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, head long")


class LexicalIndex:
    """Postings of the tokens that the queries (qid, query) have, with their impacts: what a document's tokens add to a score.

    q: qid, tok, weights of each measure. d: block, idx, tok and impacts. A score is the sum of weight x impact, rounded.
    `save` writes to shared storage and reads back.
    """

    def __init__(self, corpus: DataFrame, queries: DataFrame, save, measures: tuple[str, ...] = ("cosine", "bm25"), block: int = BLOCK):
        self.save, self.measures = save, measures
        asked = save(postings(queries, "qid", "query").filter("tok is not null"))
        # Tokens are numbers from here on; kept, since numbers given anew may differ.
        known = save(asked.select("tok").distinct().withColumn("id", F.monotonically_increasing_id()))
        q = asked.join(known, "tok").select("qid", F.col("id").alias("tok"), F.col("tf").alias("qtf"), F.col("norm").alias("qnorm"))
        met = postings(corpus, "idx", "text").join(known, "tok", "left").filter("id is not null or tok is null")
        met = save(met.select("idx", F.col("id").alias("tok"), "tf", "size", "norm"))
        facts = met.filter("tok is null").agg(F.sum("size").alias("n"), F.sum("tf").alias("words")).first()
        n = facts["n"] or 0
        avgdl = max((facts["words"] or 0) / max(n, 1), 1.0)
        impact = {"cosine": F.col("tf") / F.col("norm"), "bm25": F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(avgdl)))}
        dealt = F.pmod(F.xxhash64("idx"), F.lit(max(1, math.ceil(n / block))))
        self.d = met.filter("tok is not null").select(dealt.alias("block"), "idx", "tok", *[impact[m].alias(m) for m in measures])
        df = self.d.groupBy("tok").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = {"cosine": F.col("qtf") / F.col("qnorm"), "bm25": F.col("qtf") * idf}
        self.q = save(q.join(df, "tok").select("qid", "tok", *[weight[m].alias(f"w_{m}") for m in measures]))

    def _scored(self, met: DataFrame, *measures: str) -> DataFrame:
        return met.groupBy("qid", "idx").agg(*[F.round(F.sum(F.col(f"w_{m}") * F.col(m)), DIGITS).alias(m) for m in measures])

    def scores(self) -> DataFrame:
        """qid, idx and the measures of all pairs that share a token."""
        return self._scored(self.d.join(self.q, "tok"), *self.measures)

    def _pruned(self, measure: str, k: int, promising: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Terms (qid, tok, w, essential), surviving blocks (qid, block) and bars (qid, bar: null if anything may be among the k best).

        The bar is the k-th score of a query's most promising blocks. Terms whose largest impacts together stay below it are not
        essential: a document that has only such terms can't reach the bar."""
        largest = self.save(self.d.groupBy("block", "tok").agg(F.max(measure).alias("most")))
        w = F.col(f"w_{measure}")
        bounds = self.save(self.q.join(largest, "tok").groupBy("qid", "block").agg(F.sum(w * F.col("most")).alias("ub")))
        first = bounds.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("ub").desc(), "block"))).filter(F.col("at") <= promising)
        asked = first.select("qid", "block").join(self.q, "qid")
        best = ranked(self._scored(asked.join(self.d.select("block", "tok", "idx", measure), ["block", "tok"]), measure), measure, k)
        # Bounds and scores are sums in another order, and scores are rounded.
        bar = F.min(measure) * (1 - 1e-9) - 10.0**-DIGITS
        bars = self.q.select("qid").distinct().join(best.groupBy("qid").agg(bar.alias("bar"), F.count("*").alias("n")).filter(F.col("n") == k), "qid", "left")
        bars = self.save(bars.select("qid", "bar"))
        blocks = bounds.join(bars, "qid").filter(F.coalesce(F.col("ub") >= F.col("bar"), F.lit(True))).select("qid", "block")
        terms = self.q.join(largest.groupBy("tok").agg(F.max("most").alias("most")), "tok").join(bars, "qid")
        up_to = F.sum(w * F.col("most")).over(Window.partitionBy("qid").orderBy(w * F.col("most"), "tok").rowsBetween(Window.unboundedPreceding, 0))
        essential = F.coalesce(up_to >= F.col("bar"), F.lit(True))
        return self.save(terms.select("qid", "tok", w.alias("w"), (w * F.col("most")).alias("most"), essential.alias("essential"))), blocks, bars

    def _candidates(self, terms: DataFrame, blocks: DataFrame, bars: DataFrame, measure: str) -> DataFrame:
        """qid, idx, part: documents of surviving blocks that have an essential term, and could reach the bar with all others."""
        rest = terms.groupBy("qid").agg(F.sum(F.when(~F.col("essential"), F.col("most")).otherwise(0.0)).alias("rest"))
        met = self.d.select("block", "idx", "tok", measure).join(terms.filter("essential").select("qid", "tok", "w"), "tok").join(blocks, ["qid", "block"], "left_semi")
        met = met.groupBy("qid", "idx").agg(F.sum(F.col("w") * F.col(measure)).alias("part")).join(bars, "qid").join(rest, "qid")
        return met.filter(F.coalesce(F.col("part") + F.col("rest") >= F.col("bar"), F.lit(True))).select("qid", "idx", "part")

    def top(self, measure: str, k: int, promising: int = PROMISING) -> DataFrame:
        """qid, idx, the measure and rk of the k best of the documents that share a token: as of the full scores."""
        terms, blocks, bars = self._pruned(measure, k, promising)
        found = self.save(self._candidates(terms, blocks, bars, measure))
        others = found.select("qid", "idx").join(terms.filter("not essential").select("qid", "tok", "w"), "qid").join(self.d.select("idx", "tok", measure), ["idx", "tok"])
        parts = found.unionByName(others.select("qid", "idx", (F.col("w") * F.col(measure)).alias("part")))
        return ranked(parts.groupBy("qid", "idx").agg(F.round(F.sum("part"), DIGITS).alias(measure)), measure, k)

    def work(self, measure: str, k: int, promising: int = PROMISING) -> DataFrame:
        """qid, pairs, scored: documents that share a token with a query, and those of them whose scores are completed."""
        found = self._candidates(*self._pruned(measure, k, promising), measure).groupBy("qid").agg(F.count("*").alias("scored"))
        docs = self.d.join(self.q.select("qid", "tok"), "tok").groupBy("qid").agg(F.count_distinct("idx").alias("pairs"))
        return docs.join(found, "qid", "left").select("qid", "pairs", F.coalesce("scored", F.lit(0)).alias("scored"))


def lexical_scores(corpus: DataFrame, queries: DataFrame, save, cosine: bool = True, bm25: bool = True) -> DataFrame:
    """qid, idx, cosine, bm25 (as asked) of all pairs that share a token. `save` writes to shared storage and reads back."""
    return LexicalIndex(corpus, queries, save, ("cosine",) * cosine + ("bm25",) * bm25).scores()


def lexical_top(corpus: DataFrame, queries: DataFrame, k: int, save, measure: str = "bm25") -> DataFrame:
    """qid, idx, the measure and rk of the k best documents of each query that share a token with it."""
    index = LexicalIndex(corpus, queries, save, (measure,))
    if measure == "cosine":  # its bounds leave out little, as no token weighs more for being rare
        return ranked(BlockScores(index, queries, save).first(k), measure, k)
    return index.top(measure, k)


def ranked(scores: DataFrame, score: str, k: int | None = None, name: str = "rk") -> DataFrame:
    """rk by falling score, ties by idx; the first k if given (each task then sends on its own first k of a query only)."""
    out = scores.withColumn(name, F.row_number().over(Window.partitionBy("qid").orderBy(F.col(score).desc(), "idx")))
    return out if k is None else out.filter(F.col(name) <= k)


def places(scores: DataFrame, candidates: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """qid, idx and at_<measure> of the candidates (qid, idx, measures): their places in the list of all scores of their query,
    by falling score and idx. Both are rows of one table of scores.

    A query's candidates, sorted, cut its list into pieces. One pass over the scores finds each row's piece by binary search and
    counts the rows of pieces, and a place is the sum of the pieces before: a row of the scores meets its query's candidates
    as one array, never each of them.
    """
    out = None
    for m in measures:
        key = lambda m=m: F.struct((-F.col(m)).alias("s"), F.col("idx").alias("i"))
        arrays = candidates.groupBy("qid").agg(F.array_sort(F.collect_list(key())).alias("c"))
        most = arrays.agg(F.max(F.size("c"))).first()[0] or 0
        steps = F.array(*[F.lit(1 << b) for b in range(max(1, int(most).bit_length()) - 1, -1, -1)])
        own = scores.select("qid", key().alias("k")).join(arrays, "qid")
        # How many candidates are not behind the row: it stands before all others.
        within = lambda lo, step: (lo + step <= F.size("c")) & (F.get("c", lo + step - 1) <= F.col("k"))
        piece = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(within(lo, step), lo + step).otherwise(lo))
        counts = own.select("qid", piece.alias("piece")).groupBy("qid", "piece").agg(F.count("*").alias("n"))
        counts = counts.groupBy("qid").agg(F.collect_list(F.struct("piece", "n")).alias("p"))
        each = arrays.select("qid", F.posexplode("c").alias("j", "c")).join(counts, "qid", "left")
        before = F.aggregate(F.filter("p", lambda x: x["piece"] <= F.col("j")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
        own = each.select("qid", F.col("c.i").alias("idx"), (F.coalesce(before, F.lit(0)) + 1).alias(f"at_{m}"))
        out = own if out is None else out.join(own, ["qid", "idx"])
    return out


def hybrid(corpus: DataFrame, queries: DataFrame, k: int = 5, *, save) -> DataFrame:
    """qid, idx, score, dense_rank, sparse_rank, rk: reciprocal-rank fusion of cosine and BM25 over the whole corpus.

    The k best are among the first RRF + 2k - 1 of either list: one behind those in both has at most 2 / (2 RRF + 2k), less
    than the first k of a list have. Scores are made in blocks (see `BlockScores`), of which these first ones leave. A candidate's
    rank in the list where it comes later is its place among all scores, counted by the blocks and summed, and asked
    only where its best possible score could reach the k best. A corpus of one block is ranked there. `save` writes to shared storage and reads back.
    """
    most = RRF + 2 * k - 1
    blocks = BlockScores(LexicalIndex(corpus, queries, save), queries, save)
    # Documents without a common token follow in corpus order in both lists; they matter only behind fewer than `most` hits.
    first = [r["idx"] for r in corpus.select("idx").orderBy("idx").limit(most + k).collect()]
    if blocks.parts == 1:
        own = save(blocks.fused(first, k))
        asked = own.select("qid").distinct()
        own = own.select("qid", "idx", "dense_rank", "sparse_rank")
    else:
        found = save(blocks.first(most))
        asked = found.select("qid").distinct()
        for m, name in (("cosine", "dense_rank"), ("bm25", "sparse_rank")):
            found = ranked(found, m, name=name)
        place = lambda c: F.when(F.col(c) <= most, F.col(c)).alias(c)
        found = save(found.filter(f"dense_rank <= {most} or sparse_rank <= {most}").select("qid", "idx", "cosine", "bm25", place("dense_rank"), place("sparse_rank")))
        share = lambda c, otherwise: F.coalesce(1 / (RRF + F.col(c)), F.lit(otherwise))
        least, best = (share("dense_rank", x) + share("sparse_rank", x) for x in (0.0, 1 / (RRF + most + 1)))
        bar = ranked(found.withColumn("least", least), "least", k).groupBy("qid").agg(F.min("least").alias("bar"), F.count("*").alias("n"))
        unknown = found.filter("dense_rank is null or sparse_rank is null").join(bar, "qid").filter((best >= F.col("bar")) | (F.col("n") < k))
        counted = blocks.places(save(unknown.select("qid", "idx", "cosine", "bm25")))
        hits = found.join(counted, ["qid", "idx"], "left")
        hits = hits.select("qid", "idx", F.coalesce("dense_rank", "at_cosine").cast("int").alias("dense_rank"), F.coalesce("sparse_rank", "at_bm25").cast("int").alias("sparse_rank")).filter("dense_rank is not null and sparse_rank is not null")
        # With fewer hits than `most`, all of them are found.
        few = found.groupBy("qid").agg(F.count("*").alias("hits")).filter(F.col("hits") < most)
        rest = few.select("qid", "hits", F.explode(F.lit(first) if first else F.expr("cast(array() as array<bigint>)")).alias("idx")).join(found.select("qid", "idx"), ["qid", "idx"], "left_anti")
        rank = F.col("hits") + F.row_number().over(Window.partitionBy("qid").orderBy("idx"))
        own = hits.unionByName(rest.select("qid", "idx", rank.alias("dense_rank"), rank.alias("sparse_rank")))
    # Queries that share no token with any document have the first ones, in corpus order.
    none = queries.select("qid").join(asked, "qid", "left_anti").select("qid", F.posexplode(F.lit(first[:k]) if first else F.expr("cast(array() as array<bigint>)")).alias("at", "idx"))
    none = none.select("qid", "idx", (F.col("at") + 1).alias("dense_rank"), (F.col("at") + 1).alias("sparse_rank"))
    both = own.unionByName(none).select("qid", "idx", F.col("dense_rank").cast("int").alias("dense_rank"), F.col("sparse_rank").cast("int").alias("sparse_rank"))
    score = F.round(1 / (RRF + F.col("dense_rank")) + 1 / (RRF + F.col("sparse_rank")), 12)
    return ranked(both.withColumn("score", score), "score", k).select("qid", "idx", "dense_rank", "sparse_rank", "score", "rk")


class BlockScores:
    """Scores of all pairs of queries and documents that share a token, made in blocks that they do not leave.

    Documents and queries are dealt to blocks, and each block of the ones meets each block of the others in a task of its own; what
    leaves it is the first of each query there, or counts. Pairs are neither shuffled nor written. The sums are of products in
    the order of the tokens' numbers, so that a pair has the same score in every pass.
    """

    def __init__(self, index: LexicalIndex, queries: DataFrame, save):
        self.measures, self.save = index.measures, save
        cores = queries.sparkSession.sparkContext.defaultParallelism
        n, asked = index.d.count(), queries.count()
        self.parts = max(1, math.ceil(n / POSTINGS), min(4 * cores, n // (POSTINGS // 16)))
        self.own = max(1, math.ceil(asked / ASKED), min(math.ceil(4 * cores / self.parts), asked // 64))
        self.q = index.q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(self.own)).cast("int"))
        self.d = index.d.withColumn("c", F.pmod(F.xxhash64("idx"), F.lit(self.parts)).cast("int"))
        self.qid, self.idx = (t.schema[c].dataType.simpleString() for t, c in ((queries, "qid"), (index.d, "idx")))

    def _met(self, left: DataFrame, work, schema: str) -> DataFrame:
        """Each block of the left side with each block of the documents; about one pair of blocks a task, so that a task does not grow."""
        tasks = min(self.parts * self.own, TASKS)
        left = left.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))
        right = self.d.select("c", "idx", "tok", *self.measures).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(self.own - 1))))
        left, right = left.repartition(tasks, "qb", "cb"), right.repartition(tasks, "b", "c")
        return left.groupBy("qb", "cb").cogroup(right.groupBy("b", "c")).applyInArrow(work, schema)

    def first(self, most: int) -> DataFrame:
        """qid, idx and the measures of what is among the first `most` of its query and block by some measure."""
        measures = self.measures
        return self._met(self.q, lambda a, b: _block_first(a, b, measures, most), f"qid {self.qid}, idx {self.idx}, " + ", ".join(f"{m} double" for m in measures))

    def places(self, asked: DataFrame) -> DataFrame:
        """qid, idx and at_<measure>: places of some pairs (qid, idx, measures) in the lists of all scores of their queries."""
        measures = self.measures
        terms = self.q.join(asked.select("qid").distinct(), "qid", "left_semi")
        own = asked.select(F.pmod(F.xxhash64("qid"), F.lit(self.own)).cast("int").alias("qb"), "qid", "idx", *measures)
        both = terms.unionByName(own, allowMissingColumns=True)
        made = self._met(both, lambda a, b: _block_places(a, b, measures), f"qid {self.qid}, idx {self.idx}, " + ", ".join(f"at_{m} long" for m in measures))
        return made.groupBy("qid", "idx").agg(*[(F.sum(f"at_{m}") + 1).alias(f"at_{m}") for m in measures])

    def fused(self, first: list, k: int) -> DataFrame:
        """qid, idx, dense_rank, sparse_rank of the k best by reciprocal ranks, where all documents are in one block; `first` are the
        first documents of the corpus, which follow those that share a token."""
        return self._met(self.q, lambda a, b: _block_fused(a, b, first, k), f"qid {self.qid}, idx {self.idx}, dense_rank int, sparse_rank int")


def _tiles(terms, docs, measures, more=()):
    """The queries (Arrow array), documents (sorted array), and for tiles of queries: the first of them and the scores of each measure,
    a row for each query and a column for each document, -1 where no token is shared."""
    import numpy as np

    key = terms["qid"].combine_chunks().dictionary_encode()
    row, tok = key.indices.to_numpy(zero_copy_only=False), np.asarray(terms["tok"], np.int64)
    order = np.lexsort((tok, row))
    row, tok = row[order], tok[order]
    idx, column = np.unique(np.concatenate([np.asarray(docs["idx"], np.int64), np.asarray(more, np.int64)]), return_inverse=True)
    d_tok = np.asarray(docs["tok"], np.int64)
    by_tok = np.argsort(d_tok, kind="stable")
    d_tok, column = d_tok[by_tok], column[: len(by_tok)][by_tok]
    begin, size = np.searchsorted(d_tok, tok), np.searchsorted(d_tok, tok, "right") - np.searchsorted(d_tok, tok)
    ends = np.searchsorted(row, np.arange(len(key.dictionary) + 1))
    products = np.concatenate([[0], np.cumsum(size)])[ends]
    weights, impacts = [np.asarray(terms[f"w_{m}"], float)[order] for m in measures], [np.asarray(docs[m], float)[by_tok] for m in measures]

    def made():
        at = 0
        while at < len(key.dictionary):
            stop = max(at + 1, min(at + CELLS // max(1, len(idx)), int(np.searchsorted(products, products[at] + CELLS, "right")) - 1))
            part = slice(ends[at], ends[stop])
            n = size[part]
            here = np.repeat(begin[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            cell = np.repeat((row[part] - at).astype(np.int64) * len(idx), n) + column[here]
            cells = (stop - at) * len(idx)
            shared = np.zeros(cells, bool)
            shared[cell] = True
            scores = []
            for w, x in zip(weights, impacts):
                s = np.round(np.bincount(cell, np.repeat(w[part], n) * x[here], cells), DIGITS)
                s[~shared] = -1.0
                scores.append(s.reshape(stop - at, len(idx)))
            yield at, scores
            at = stop

    return key.dictionary, idx, made()


def _block_first(terms, docs, measures, most: int):
    import numpy as np
    import pyarrow as pa

    out = [[] for _ in range(2 + len(measures))]
    if len(terms) and len(docs):
        ids, idx, tiles = _tiles(terms, docs, measures)
        for at, scores in tiles:
            kept = np.zeros(scores[0].shape, bool)
            for s in scores:
                last = max(0, s.shape[1] - most)
                bar = np.maximum(np.partition(s, last, axis=1)[:, last], 0.0)
                row, col = np.nonzero(s >= bar[:, None])  # ties of the last too
                order = np.lexsort((col, -s[row, col], row))
                row, col = row[order], col[order]
                chosen = np.arange(len(row)) - np.searchsorted(row, row) < most
                kept[row[chosen], col[chosen]] = True
            row, col = np.nonzero(kept)
            for held, x in zip(out, (at + row, idx[col], *[s[row, col] for s in scores])):
                held.append(x)
        made = [np.concatenate(x) for x in out]
        return pa.table([ids.take(pa.array(made[0])), *map(pa.array, made[1:])], names=["qid", "idx", *measures])
    return pa.table([terms["qid"].slice(0, 0), pa.array([], pa.int64()), *[pa.array([], pa.float64())] * len(measures)], names=["qid", "idx", *measures])


def _block_places(both, docs, measures):
    """How many documents of a block stand before each asked pair, by each measure."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    pairs = both.filter(pc.is_null(both["tok"]))
    n = len(pairs)
    counts = [np.zeros(n, np.int64) for _ in measures]
    terms = both.filter(pc.is_valid(both["tok"]))
    if n and len(docs) and len(terms):
        ids, idx, tiles = _tiles(terms, docs, measures)
        row = np.asarray(pc.index_in(pairs["qid"], ids).combine_chunks())
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(len(ids) + 1))
        own = np.asarray(pairs["idx"], np.int64)
        for at, scores in tiles:
            for k, (s, m) in enumerate(zip(scores, measures)):
                asked = np.asarray(pairs[m], float)
                for j in range(len(s)):
                    p = order[ends[at + j] : ends[at + j + 1]]
                    if not len(p):
                        continue
                    reach = np.nonzero(s[j] >= asked[p].min())[0]
                    reach = reach[np.argsort(-s[j, reach], kind="stable")]  # ties by idx
                    down = -s[j, reach]
                    lo, hi = np.searchsorted(down, -asked[p]), np.searchsorted(down, -asked[p], "right")
                    counts[k][p] = lo
                    for t in np.nonzero(hi > lo)[0]:
                        counts[k][p[t]] += np.searchsorted(idx[reach[lo[t] : hi[t]]], own[p[t]])
    return pa.table([pairs["qid"], pairs["idx"], *map(pa.array, counts)], names=["qid", "idx", *[f"at_{m}" for m in measures]])


def _block_fused(terms, docs, first, k: int):
    import numpy as np
    import pyarrow as pa

    out = [[], [], [], []]
    if not len(terms):
        return pa.table([terms["qid"].slice(0, 0), pa.array([], pa.int64()), *[pa.array([], pa.int32())] * 2], names=["qid", "idx", "dense_rank", "sparse_rank"])
    ids, idx, tiles = _tiles(terms, docs, ("cosine", "bm25"), first)
    follows = np.isin(idx, np.asarray(first, np.int64))
    for at, scores in tiles:
        ranks = []
        for s in scores:
            r = np.empty(s.shape, np.int32)
            np.put_along_axis(r, np.argsort(-s, axis=1, kind="stable"), np.arange(1, s.shape[1] + 1, dtype=np.int32)[None, :], axis=1)  # ties by idx
            ranks.append(r)
        score = np.round(1 / (RRF + ranks[0]) + 1 / (RRF + ranks[1]), 12)
        score[(scores[0] < 0) & ~follows] = -1.0
        last = max(0, score.shape[1] - k)
        row, col = np.nonzero((score >= np.partition(score, last, axis=1)[:, last][:, None]) & (score > 0))
        order = np.lexsort((col, -score[row, col], row))
        row, col = row[order], col[order]
        chosen = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[chosen], col[chosen]
        for held, x in zip(out, (at + row, idx[col], ranks[0][row, col], ranks[1][row, col])):
            held.append(x)
    made = [np.concatenate(x) for x in out]
    return pa.table([ids.take(pa.array(made[0])), *map(pa.array, made[1:])], names=["qid", "idx", "dense_rank", "sparse_rank"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, block: int = VECTORS) -> DataFrame:
    """qid, idx, score, rk of (idx, vector) for (qid, vector): exact, in blocks. Both sides are dealt to blocks of about `block`
    rows, every block of the queries meets every block of the corpus in a task of its own, and what leaves it is the k
    best of each query there. No vector passes the driver; a vector is shuffled once for each block of the other side."""
    n, asked = vectors.count(), queries.count()
    parts = max(1, math.ceil(n / block), min(vectors.sparkSession.sparkContext.defaultParallelism, n // 1024))
    own = max(1, math.ceil(asked / block))
    left = queries.select(F.pmod(F.xxhash64("qid"), F.lit(own)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("cb"), F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector"))
    right = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(own - 1))).alias("b"), F.pmod(F.xxhash64("idx"), F.lit(parts)).cast("int").alias("c"), F.col("idx").cast("long").alias("idx"), F.col("vector").cast("array<double>").alias("vector"))
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("b", "c")).applyInArrow(lambda a, b: _block_best(a, b, k), "qid long, idx long, score double")
    return ranked(found, "score", k)


def _block_best(queries, vectors, k: int, tile: int = 256):
    """qid, idx, score of the k best of a block of vectors for each of a block of queries."""
    import numpy as np
    import pyarrow as pa

    def unit(table):
        rows = table["vector"].combine_chunks()
        m = np.asarray(rows.flatten(), float).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    ids, idx = (np.asarray(t[c], np.int64) for t, c in ((queries, "qid"), (vectors, "idx")))
    out = [[], [], []]
    if len(ids) and len(idx):
        q, v = unit(queries), unit(vectors)
        for at in range(0, len(ids), tile):
            score = np.round(q[at : at + tile] @ v.T, DIGITS)
            bar = np.partition(score, max(0, score.shape[1] - k), axis=1)[:, max(0, score.shape[1] - k)]
            row, col = np.nonzero(score >= bar[:, None])  # ties of the k-th too
            order = np.lexsort((idx[col], -score[row, col], row))
            row, col = row[order], col[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col = row[first], col[first]
            for held, x in zip(out, (ids[at + row], idx[col], score[row, col])):
                held.append(x)
    made = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, float))]
    return pa.table([pa.array(x) for x in made], names=["qid", "idx", "score"])


def expand_parents(hits: DataFrame, children: DataFrame, parents: DataFrame, top: int = 3) -> DataFrame:
    """qid, position, parent_id, text: the parents of the first hits, each once, in order. children: idx, parent_id."""
    met = hits.filter(F.col("rk") <= top).join(children.select("idx", "parent_id"), "idx").groupBy("qid", "parent_id").agg(F.min("rk").alias("rk"))
    order = Window.partitionBy("qid").orderBy("rk")
    return met.withColumn("position", F.row_number().over(order)).join(parents, "parent_id").select("qid", "position", "parent_id", "text")
