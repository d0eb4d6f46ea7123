"""Scores in blocks, postings and pages in one pass, against plain forms."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import retrieval
from millrace.streaming.incremental import save_to
from tests.test_search import frames, full_scores, texts  # noqa: F401


def fused(docs, asked, k):
    """The k best by reciprocal ranks over whole lists."""
    pairs = {(q, i): (c, b) for q, i, c, b in full_scores(docs, asked)}
    for q in range(len(asked)):
        own = [(*pairs.get((q, i), (0.0, 0.0)), i) for i in range(len(docs))]
        places = [{x[2]: n for n, x in enumerate(sorted(own, key=lambda x: (-x[m], x[2])), 1)} for m in (0, 1)]
        best = sorted((-round(1 / (60 + places[0][i]) + 1 / (60 + places[1][i]), 12), i) for i in range(len(docs)))[:k]
        yield from ((q, i, places[0][i], places[1][i], n) for n, (_, i) in enumerate(best, 1))


@pytest.mark.parametrize("postings, asked_block", [(1 << 20, 4096), (256, 4096), (512, 5)])
def test_fused_ranks_of_blocks(spark, texts, monkeypatch, postings, asked_block):  # noqa: F811
    monkeypatch.setattr(retrieval, "POSTINGS", postings)
    monkeypatch.setattr(retrieval, "ASKED", asked_block)
    made = retrieval.hybrid(*frames(spark, *texts), save=save_to(spark)).collect()
    got = sorted((r["qid"], r["idx"], r["dense_rank"], r["sparse_rank"], r["rk"]) for r in made)
    assert got == sorted(fused(*texts, 5))


def test_fused_ranks_write_no_table_of_pairs(spark, texts):  # noqa: F811
    save, most = save_to(spark), []

    def counted(df):
        kept = save(df)
        if {"qid", "idx"} <= set(kept.columns):
            most.append(kept.count())
        return kept

    retrieval.hybrid(*frames(spark, *texts), save=counted).count()
    assert max(most) <= 5 * len(texts[1]) < sum(1 for _ in full_scores(*texts)) / 20


def test_cosine_first_of_blocks(spark, texts, monkeypatch):  # noqa: F811
    monkeypatch.setattr(retrieval, "POSTINGS", 64)
    full = {}
    for q, i, cos, _ in full_scores(*texts):
        full.setdefault(q, []).append((-cos, i))
    got = {}
    for r in retrieval.lexical_top(*frames(spark, *texts), 5, save_to(spark), "cosine").orderBy("qid", "rk").collect():
        got.setdefault(r["qid"], []).append(r["idx"])
    assert got == {q: [i for _, i in sorted(rows)[:5]] for q, rows in full.items()}


def test_places_of_equal_scores_in_a_block():
    import pyarrow as pa

    n = 50
    docs = pa.table({"idx": pa.array(range(n)), "tok": pa.array([0] * n), "cosine": pa.array([float(i % 3) for i in range(n)])})
    asked = [7, 8, 9, 48, 49]
    both = pa.table({"qid": ["a"] * 6 + ["b"], "tok": pa.array([0, *[None] * 5, 0]), "w_cosine": pa.array([1.0, *[None] * 5, 2.0]), "idx": pa.array([None, *asked, None]), "cosine": pa.array([None, *[float(i % 3) for i in asked], None])})
    made = retrieval._block_places(both, docs, ("cosine",))
    order = sorted(range(n), key=lambda i: (-(i % 3), i))
    assert dict(zip(made["idx"].to_pylist(), made["at_cosine"].to_pylist())) == {i: order.index(i) for i in asked}


def test_postings_of_one_pass(spark, monkeypatch):
    texts = ["The the a", "", None, "\u212a9 x\u0130y \u00c4b", "...", "a b c d e f g a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    made = retrieval.postings(rows, "id", "text").collect()
    want = []
    for i, text in enumerate(texts):
        counts = Counter(re.findall("[a-z0-9]+", (text or "").lower()))
        want += [(i, t, n, sum(counts.values()), math.sqrt(sum(x * x for x in counts.values()))) for t, n in counts.items()]
    assert sorted(tuple(r) for r in made if r["tok"] is not None) == sorted(want)
    assert [(sum(r["tf"] for r in rest), sum(r["size"] for r in rest)) for rest in [[r for r in made if r["tok"] is None]]] == [(sum(w[2] for w in want), len(texts))]
    spread = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("tok"))
    assert sorted((r["id"], r["tok"]) for r in spread.collect()) == sorted(w[:2] for w in want)


def test_normalized_is_normalize_once(spark):
    points = [chr(c) for c in [*range(1, 0x3100), 0xFEFF, 0xFFFD, 0x1F600] if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(i, f"{c}a{c}{c} b{c}") for i, c in enumerate(points)] + [(-1, None), (-2, " \t ")], "id int, text string")
    made = T.normalized(rows)
    pairs = made.withColumnRenamed("text", "made").join(rows.select("id", T.normalize(F.col("text")).alias("want")), "id")
    assert made.columns == rows.columns and pairs.filter("not (made <=> want)").count() == 0 and pairs.count() == len(points) + 2


def test_pages_are_not_normalized_again_by_a_filter(spark, tmp_path):
    from millrace.plans.fixtures import normal_pages

    spark.createDataFrame([(2, " a  b \n\nc"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = normal_pages(spark, str(tmp_path)).filter("text <> ''")
    assert [tuple(r) for r in pages.orderBy("page_num").collect()] == [(2, 1, "a b"), (2, 3, "c")]
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp_replace" not in plan


@pytest.fixture
def odd_documents(spark, tmp_path):
    """Repeated and null ids, no text, no page with text, code points beyond 16 bits, white space of all kinds, a long text."""
    long = "\n".join(" ".join(f"w{(i * j) % 97}\U0001f600" for j in range(40)) for i in range(60))
    rows = [(1, "aaaaaaaa aaa\n\nbb\u00a0\u2003bb  bbbbbb"), (1, "aaaaaaaa aaa\n\nbb bb bbbbbb"), (1, "cc"), (2, None), (3, ""), (4, " \t\n\u3000"), (None, "xxxxxxxx"), (5, long), (8, "abcabcabcabcabc"), (7, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = {}
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n") if text is not None else [], 1):
            if doc is not None and line.split() and (doc * 31 + n) % 17:
                pages.setdefault(doc, []).append((n, " ".join(line.split())))
    return str(tmp_path), {doc: sorted(own) for doc, own in pages.items()}


def test_evidence_and_chunks_of_odd_documents(spark, odd_documents):
    from millrace.operators import chunking, evaluation
    from millrace.plans.fixtures import normal_pages
    from millrace.queries import CATALOG

    path, pages = odd_documents
    found, held = [], set()
    for doc, own in pages.items():
        spans, at = [], 0
        for n, text in own:
            spans.append((n, text, at))
            at += len(text) + 1
        here = []
        for n, text in own:
            place = (doc + n) % max(1, len(text) - 5)
            quote = text[place : place + 6]
            here += [(doc * 100000 + n, doc, n, s + k, s + k + 6) for m, other, s in spans if m == n and len(quote) == 6 for k in range(len(other)) if other.startswith(quote, k)]
        found += here
        words, chunks, k = " ".join(text for _, text in own).split(" "), [], 0
        while k == 0 or k * 115 + 13 < len(words):
            start = len(" ".join(words[: k * 115])) + (k > 0)
            chunks.append((k, start, start + len(" ".join(words[k * 115 : k * 115 + 128]))))
            k += 1
        held |= {(e, doc, c) for e, _, _, lo, hi in here for c, s, t in chunks if s <= lo and hi <= t}
    run = lambda name: [tuple(r) for r in CATALOG[name](spark, path).collect()]
    assert sorted(run("q22_evidence_offsets")) == sorted(found) and len(found) > 60
    assert sorted(run("q26_relevant_chunks")) == sorted(held) and max(c for _, _, c in held) > 10
    assert sorted(run("q28_chunk_evidence_map")) == sorted((d, c, ",".join(str(e) for e, x, y in sorted(held) if (x, y) == (d, c))) for d, c in {h[1:] for h in held})
    ask = spark.createDataFrame([(e, d, n, q) for e, d, n, q in [("a", 8, 1, "abcabc"), ("b", 8, 1, ""), ("c", 8, 1, None), ("d", 8, 2, "abc"), ("e", 1, 1, "aa"), ("f", 99, 1, "a"), ("g", None, 1, "xxx")]], "eval_id string, doc_id long, page_num long, quote string")
    whole = normal_pages(spark, path)
    rows = whole.filter("text <> ''").groupBy("doc_id", "page_num").agg(F.array(F.struct("page_num", F.min("text").alias("text"))).alias("pages")).select("doc_id", "pages")
    single = chunking.unbound(chunking.bound(rows))
    plain = evaluation.evidence_spans(ask, chunking.page_spans(single)).select("eval_id", "doc_id", "page_num", "lo", "hi")
    made = evaluation.evidence_in(ask, chunking.bound(rows))
    assert made.columns == plain.columns and sorted(made.collect()) == sorted(plain.collect()) and made.filter("eval_id = 'a'").count() == 4


def test_texts_are_normalized_and_shuffled_once(spark, odd_documents):
    from millrace.queries import CATALOG

    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        for name, passes, exchanges in (("q22_evidence_offsets", 1, 1), ("q26_relevant_chunks", 2, 4), ("q27_page_chunk_overlap", 2, 3), ("q28_chunk_evidence_map", 2, 5)):
            plan = CATALOG[name](spark, odd_documents[0])._jdf.queryExecution().executedPlan().toString()
            assert (plan.count("MapInArrow"), plan.count("- Exchange ")) == (passes, exchanges), plan
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_spans_of_chunks_are_those_of_their_texts(spark, odd_documents):
    from millrace.operators import chunking
    from millrace.plans.fixtures import full_texts, normal_pages

    texts = full_texts(spark, odd_documents[0])
    plain = chunking.concat_pages(normal_pages(spark, odd_documents[0]))
    assert sorted((r.doc_id or 0, r.text) for r in texts.collect()) == sorted((r.doc_id or 0, r.text) for r in plain.collect())
    for size, overlap in ((128, 13), (3, 1), (1, 0)):
        chunks = chunking.token_chunks(texts, size, overlap).join(texts.withColumnRenamed("text", "whole"), "doc_id")
        assert chunks.filter("substring(whole, start_index + 1, length(text)) <> text or size(split(text, ' ')) <> n_tokens").count() == 0
        want = chunks.selectExpr("doc_id", "chunk_id", "start_index", "start_index + length(text) as end_index")
        assert sorted(chunking.token_spans(texts, size, overlap).filter("doc_id is not null").collect()) == sorted(want.collect())


def test_windows_of_tokens(spark):
    texts = ["a b c d a b c d", "x a B c", "", None, "a b", "b a", "a b c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    made = {}
    for r in retrieval.windows(rows, "id", "text", 3).collect():
        made.setdefault(r["id"], set()).add(r["head"])
    first = {r["id"]: r["head"] for r in retrieval.windows(rows, "id", "text", 3, only_first=True).collect()}
    assert [len(made[i]) for i in range(len(texts))] == [4, 2, 1, 1, 1, 1, 1]
    assert all(first[i] in made[i] for i in made) and len(first) == len(texts)
    assert made[6] == {first[0]} and made[0] & made[1] == made[6] and made[2] == made[3] and len({first[4], first[5], first[2], first[6]}) == 4


def test_blocks_have_tasks_of_their_own(spark, texts, monkeypatch):  # noqa: F811
    monkeypatch.setattr(retrieval, "POSTINGS", 64)
    corpus, queries = frames(spark, *texts)
    blocks = retrieval.BlockScores(retrieval.LexicalIndex(corpus, queries, save_to(spark)), queries, save_to(spark))
    assert blocks.parts > 16 and blocks.first(5).rdd.getNumPartitions() == blocks.parts * blocks.own
