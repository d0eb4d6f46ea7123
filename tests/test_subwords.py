"""Chunks by a tokenizer's tokens: what is encoded, and that it is encoded as the tokenizer does."""

import random

import pytest

from millrace.operators import chunking, models

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH, RANKS = (public.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))


def test_words_are_encoded_once(spark, tmp_path):
    rnd = random.Random(3)
    words = ["the", "café", "don't", "x" * 40, "Ünïcode,", "12345"]
    texts = [(k, " ".join(rnd.choices(words, k=400))) for k in range(40)]
    log = str(tmp_path / "encoded")

    def load():
        encode = models.token_offsets(PATH)()

        def logged(own):
            with open(log, "a") as f:
                f.write(f"{sum(map(len, own))}\n")
            return encode(own)

        return logged

    rows = chunking.subword_chunks(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), load, 64, 7).collect()
    assert sum(map(int, open(log))) * 10 < sum(len(t) for _, t in texts)
    model = tokenizers.Tokenizer.from_file(PATH)
    assert all(r.n_tokens == len(model.encode(r.text, add_special_tokens=False).ids) for r in rows)


def test_ids_are_the_tokenizers():
    rnd = random.Random(5)
    plain = [chr(c) for c in range(0x2060) if c not in (10, 32) and models.PLAIN(chr(c))]
    signs = [*"  \n\t'", "'s", "'ll", "'LL", " ", " ", "　", "漢", "🎉", "<|endoftext|>", "́", "﻿"]
    texts = ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\nb", " \n a", "a b", *plain, *(f"a{c}b {c}{c} {c}1" for c in plain)]
    texts += ["".join(rnd.choices(plain + signs * 20, k=rnd.randint(1, 40))) for _ in range(3000)]
    texts += [" ".join("".join(rnd.choices(plain + list("aeinst'") * 99, k=rnd.randint(1, 9))) for _ in range(rnd.randint(1, 30))) for _ in range(1000)]
    model, encode = tokenizers.Tokenizer.from_file(PATH), models.token_ids(PATH, RANKS)()
    expected = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in encode(texts)] == expected
    assert [list(encode([t])[0]) for t in texts[:200]] == expected[:200] and encode([]) == []


def _mixed():
    rnd = random.Random(7)
    words = ["the", "café", "漢字", "don't", "<|endoftext|>", "x" * 90, "a", "Ünïcode,", "🎉", "“so”"]
    return [(k, " ".join(rnd.choices(words, k=n))) for k, n in enumerate((1, 2, 30, 900))] + [(8, ""), (9, None), (None, "a b")]


def test_both_encoders_cut_alike(spark):
    rows = spark.createDataFrame(_mixed(), "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    a, b = (sorted(map(tuple, chunking.subword_chunks(rows, load, 20, 6).collect()), key=key) for load in (models.token_ids(PATH, RANKS), models.token_offsets(PATH)))
    assert a == b and len(a) > 60


def test_audit_of_chunks(spark):
    rows = spark.createDataFrame(_mixed(), "doc_id long, text string")
    got = chunking.subword_audit(rows, models.token_ids(PATH, RANKS), 20, 6).collect()
    assert {(r.doc_id, r.words) for r in got} == {(doc, len(text.split(" "))) for doc, text in _mixed() if text}
    assert all(r.whole and r.fitting and r.overlapping for r in got)


def test_audit_tells_wrong_counts(spark):
    """A tokenizer with tokens across words, which chunks are not for."""

    def load():
        return lambda texts: [range(len(t) ** 2 // 10) for t in texts]

    rows = spark.createDataFrame([(1, "a bcd e fgh i")], "doc_id long, text string")
    got = chunking.subword_audit(rows, load, 15, 1).first()
    assert (got.words, got.whole, got.fitting, got.overlapping) == (5, False, False, True)


def test_chunks_are_not_shuffled(spark):
    from __spark_entry__ import queries

    plan = queries()["q109_subword_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
