"""A training corpus from documents in five stages: quality rules, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents. SQL has no form of the trained, linked and packed stages,
so ORACLE_SQL is None and tests hold each stage against brute force.

Defined results, at every stage: an empty table stays one; extra columns, whatever their names, travel along up to packing;
texts of any length are taken whole. A null or blank text fails the quality rules, so later stages see none; a null source is a
source of its own; a null doc_id is kept, never names a class of near-duplicates and is told from others by its text; of rows
repeated whole one stays after near-dedup if they have a doc_id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import mixing, packing, quality, simhash, toxicity
from millrace.llm.common import materialise, table, word_count
from millrace.llm.queries import tokenizer_file


def quality_stage(spark, docs, sf_dir):
    """Documents that fail the base rule or repeat themselves go."""
    return quality.accepted(docs)


def toxicity_stage(spark, docs, sf_dir):
    """Toxic documents go; the chain learns from the labels of documents that are still here."""
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark, docs, sf_dir):
    """Of each group of near-duplicates the document with the smallest doc_id stays. Links are SimHash fingerprints within 2 bits,
    found with BK-trees as in op10, and beyond their reach sets of five words that are at least 0.8 similar."""
    return simhash.one_of_each(docs, shingle=5, similarity=0.8, both=True)


def mixing_stage(spark, docs, sf_dir):
    """Documents in training order, repeated, cut or left out as their source's target asks."""
    return mixing.mixed_documents(docs, word_count(F.col("text")))


def packing_stage(spark, docs, sf_dir):
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), ranks_path=tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("SimHash near-dedup", near_duplicates_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{k}")
    return docs
