"""The corpus pipeline against each stage done by brute force, and the contracts of the queries."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import quality
from millrace.llm.queries import LLM_ORACLES, LLM_QUERIES

from .test_operators import WORDS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        made = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert made.columns == docs.columns
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def similar_classes(texts, size=5, limit=0.8):
    """The first text of each one's class, linked where the sets of five words are similar enough."""
    sets = []
    for t in texts:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)})
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= limit * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_stages(stages):
    docs, good, mild, single, mixed, packed = stages
    kept = quality.judge_texts([r["text"] for r in docs])[-1]
    assert sorted(good) == sorted(r for r, k in zip(docs, kept) if k)
    assert 0 < len(mild) < len(good) and set(mild) <= set(good)
    ordered = sorted(mild, key=lambda r: r["doc_id"])
    roots = similar_classes([r["text"] for r in ordered])
    assert sorted(single) == [r for i, r in enumerate(ordered) if roots[i] == i]
    by = {r["doc_id"]: r for r in single}
    times = collections.Counter(r["doc_id"] for r in mixed)
    assert max(times.values()) <= 3 and all(by[r["doc_id"]]["text"].startswith(r["text"]) for r in mixed)
    words = lambda rows: sum(len(WORDS.findall(r["text"])) for r in rows)
    assert abs(words(mixed) - words(single)) <= 20
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == times


def test_run_equals_stages(spark, stages):
    made = corpus_pipeline.run(spark, SF).collect()
    cut = lambda rows: collections.Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert cut(made) == cut(stages[-1])


def test_queries_cover_all_operators():
    assert [n.split("_")[0] for n in LLM_QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(LLM_ORACLES) <= set(LLM_QUERIES)


def test_toxicity_stage_catches_labelled_documents(spark):
    """Over all labelled documents that reach the stage: toxic ones go, clean ones stay."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    good = corpus_pipeline.quality_stage(spark, docs, sf)
    left = {r["doc_id"] for r in corpus_pipeline.toxicity_stage(spark, good, sf).select("doc_id").collect()}
    named = good.join(labels, "doc_id").select("doc_id", "toxic").collect()
    toxic, clean = ([r["doc_id"] in left for r in named if r["toxic"] == k] for k in (1, 0))
    assert sum(toxic) <= 0.08 * len(toxic) and sum(clean) >= 0.99 * len(clean)


def test_edges_at_every_stage(spark):
    """Nulls in any column, an empty table, a long text, repeated rows and extra columns of clashing names."""
    words = " ".join(f"w{i * i % 9973}" for i in range(30_000))
    rows = [(1, "one two three four five six seven eight nine ten eleven", "en", "s1", 5), (1, "one two three four five six seven eight nine ten eleven", "en", "s1", 5)]
    rows += [(2, None, None, None, None), (None, words, "en", None, 3), (3, "", "", "", 0), (4, words + " end", "en", "s2", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {c: F.lit(7) for c in ("size", "key", "row", "range", "piece", "fp", "id", "__slot", "__gone", "__bits", "__word")}
    for docs in (spark.createDataFrame(rows, schema).withColumns(clash), spark.createDataFrame([], schema)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, docs, SF)
            if k + 1 < len(corpus_pipeline.STAGES):
                assert made.columns == docs.columns
                docs = spark.createDataFrame(made.collect(), made.schema)
        found = made.collect()
        assert not docs.columns == [] and {r["doc_id"] for r in found} <= {1, None, 4}
