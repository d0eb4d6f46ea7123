"""Searches and interval joins against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import chunking, evaluation, intervals, retrieval
from millrace.streaming.incremental import save_to


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    words = [f"w{int(rnd.paretovariate(0.7)) % 400}" for _ in range(4000)]
    docs = [" ".join(["the"] * rnd.randint(1, 5) + rnd.choices(words, k=rnd.choice((3, 20, 120)))) for _ in range(500)] + ["none", "", None]
    asked = [" ".join(["the", *rnd.sample(words, 3)]) for _ in range(8)] + ["zzz", "the", "", None, "none the"]
    return docs, asked


def full_scores(docs, asked):
    find = re.compile("[a-z0-9]+").findall
    toks = [find(d or "") for d in docs]
    avgdl, n = max(sum(map(len, toks)) / len(toks), 1), len(toks)
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    for qid, q in enumerate(asked):
        qt = find(q or "")
        for i, t in enumerate(toks):
            shared = set(qt) & set(t)
            if shared:
                cos = sum(qt.count(w) * t.count(w) for w in shared) / math.sqrt(sum(qt.count(w) ** 2 for w in set(qt))) / math.sqrt(sum(t.count(w) ** 2 for w in set(t)))
                bm = sum(qt.count(w) * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in shared)
                yield qid, i, round(cos, 9), round(bm, 9)


def frames(spark, docs, asked):
    return spark.createDataFrame(list(enumerate(docs)), "idx long, text string").repartition(3), spark.createDataFrame(list(enumerate(asked)), "qid long, query string")


@pytest.mark.parametrize("measure, block", [("cosine", 8), ("bm25", 8), ("bm25", 1000)])
def test_pruned_top_equals_full_scores(spark, texts, measure, block):
    index = retrieval.LexicalIndex(*frames(spark, *texts), save_to(spark), (measure,), block)
    full = {}
    for qid, i, cos, bm in full_scores(*texts):
        full.setdefault(qid, []).append((-(cos if measure == "cosine" else bm), i))
    got = {}
    for r in index.top(measure, 5).orderBy("qid", "rk").collect():
        got.setdefault(r["qid"], []).append((-r[measure], r["idx"]))
    assert got.keys() == full.keys()
    for qid, rows in full.items():
        want = sorted(rows)[:5]
        assert [s for s, _ in got[qid]] == pytest.approx([s for s, _ in want], abs=2e-9) and [i for _, i in got[qid]] == [i for _, i in want], qid
    if block == 8:
        work = index.work(measure, 5).agg(F.sum("pairs"), F.sum("scored")).first()
        assert work[0] == sum(map(len, full.values())) and work[1] < work[0] / (2 if measure == "bm25" else 1)


def test_places_are_ranks_of_the_whole_list(spark):
    rnd = random.Random(5)
    rows = [(q, i, rnd.randint(0, 20) / 10, rnd.randint(0, 5) / 10) for q in range(3) for i in range(300)]
    scores = spark.createDataFrame(rows, "qid long, idx long, a double, b double").repartition(4)
    asked = scores.filter("idx % 7 = 3 and qid < 2")
    got = {(r["qid"], r["idx"]): (r["at_a"], r["at_b"]) for r in retrieval.places(scores, asked, ("a", "b")).collect()}
    assert len(got) == asked.count()
    for (q, i), at in got.items():
        own = [r for r in rows if r[0] == q]
        assert at == tuple(sorted(own, key=lambda r: (-r[k], r[1])).index(next(r for r in own if r[1] == i)) + 1 for k in (2, 3))
    assert retrieval.places(scores, asked.limit(0), ("a", "b")).count() == 0


@pytest.mark.parametrize("block", [7, 1000])
def test_dense_blocks(spark, block):
    import numpy as np

    rnd = np.random.default_rng(1)
    v, q = rnd.integers(-2, 3, (60, 4)).astype(float), rnd.integers(-2, 3, (20, 4)).astype(float)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "idx long, vector array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid int, vector array<float>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    score = np.round(unit(q) @ unit(v).T, 9)
    got = {}
    for r in retrieval.dense_top(vectors, queries, 5, block).orderBy("qid", "rk").collect():
        got.setdefault(r["qid"], []).append(r["idx"])
    assert got == {i: sorted(range(60), key=lambda j: (-score[i, j], j))[:5] for i in range(20)}
    assert retrieval.dense_top(vectors, queries.limit(0), 5).count() == 0 == retrieval.dense_top(vectors.limit(0), queries, 5).count()


@pytest.mark.parametrize("width", [1, 7, 2048])
def test_interval_joins(spark, width):
    rnd = random.Random(width)
    spans = lambda n: [(rnd.choice("ab"), k, lo := rnd.randint(0, 90), lo + rnd.randint(0, 12)) for k in range(n)]
    a, b = spans(70) + [("a", 99, None, 3)], spans(70) + [("b", 99, 4, None)]
    left, right = spark.createDataFrame(a, "doc string, i long, lo long, hi long"), spark.createDataFrame(b, "doc string, j long, s long, e long")
    whole = [(x, y) for x in a[:70] for y in b[:70] if x[0] == y[0]]
    held = sorted((r["i"], r["j"]) for r in intervals.holding(left, right, ["doc"], width=width).collect())
    assert held == sorted((x[1], y[1]) for x, y in whole if y[2] <= x[2] and x[3] <= y[3])
    shared = sorted((r["i"], r["j"]) for r in intervals.overlapping(left, right, ["doc"], width=width).collect())
    assert shared == sorted((x[1], y[1]) for x, y in whole if max(x[2], y[2]) < min(x[3], y[3]))


def test_one_document_of_many_chunks_and_quotes(spark):
    n = 100_000
    chunks = spark.range(n).selectExpr("1L as doc_id", "id as chunk_id", "id * 70 as start_index", "repeat('x', 100) as text")
    quotes = spark.range(n).selectExpr("id as eval_id", "1L as doc_id", "id * 70 + 75 as lo", "id * 70 + 95 as hi")
    got = evaluation.relevant_chunks(quotes, chunks).groupBy().agg(F.count("*"), F.count_distinct("eval_id"), F.max(F.abs(F.col("chunk_id") - F.col("eval_id")))).first()
    assert tuple(got) == (2 * n - 1, n, 1)
    pages = spark.range(n // 10).selectExpr("1L as doc_id", "id as page_num", "id * 700 as start", "id * 700 + 690 as end")
    assert evaluation.page_overlaps(pages, chunks).count() == 11 * (n // 10) - 1


def test_chunks_and_anchors_of_ten_million_characters(spark):
    text = "a quick word, é " * 640_000
    rows = spark.createDataFrame([(1, text.strip())], "doc_id long, text string")
    made = chunking.token_chunks(rows, 16, 2)
    assert made.filter(F.substring(F.lit("x"), 1, 1) == "x").count() == -(-(4 * 640_000 - 16) // 14) + 1
    own = made.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "start_index", "text"))).alias("c")).join(rows, "doc_id")
    found = own.select(F.zip_with(chunking.reanchor(F.col("text"), F.col("c.text")), F.col("c.start_index"), lambda x, y: x - y).alias("d"))
    assert found.select(F.array_max("d").alias("most"), F.size("d").alias("n")).first().n == made.count()


def test_anchors_of_chunks_out_of_order(spark):
    row = spark.createDataFrame([("abc abd abc", ["ab", "abc", "abc", "abd", "no", "", "ab"])], "t string, c array<string>")
    got = row.select(chunking.reanchor(F.col("t"), F.col("c")).alias("s")).first().s
    want, at = [], -1
    for part in row.first().c:
        here = "abc abd abc".find(part, at + 1)
        here = here if here >= 0 else "abc abd abc".find(part)
        at = here if here >= 0 else at
        want.append(here)
    assert got == want


def test_token_chunks_against_slices_of_words(spark):
    rnd = random.Random(9)
    docs = [(k, " ".join("x" * rnd.randint(1, 4) for _ in range(n))) for k, n in enumerate((1, 2, 7, 8, 9, 20, 61))] + [(90, "")]
    got = [tuple(r) for r in chunking.token_chunks(spark.createDataFrame(docs, "doc_id long, text string"), 8, 3).collect()]
    want = []
    for doc, text in docs:
        w = text.split()
        for k, first in enumerate(range(0, max(len(w) - 8, 0) + 5, 5) if w else ()):
            own = w[first : first + 8]
            want.append((doc, k, sum(len(x) + 1 for x in w[:first]), len(own), " ".join(own)))
    assert sorted(got) == sorted(want)
