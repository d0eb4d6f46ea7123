"""Word BPE, alignment of two tokenizers and the divergence audit: against the libraries and brute force, and on edge cases."""

import collections
import hashlib
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import alignment, bpe, divergence
from millrace.llm.queries import LLM_ORACLES, LLM_QUERIES, tokenizer_file
from tests.llm.test_operators import SCHEMA, corpus


@pytest.fixture(scope="module")
def rows():
    made = corpus(60)
    odd = ["<|startoftext|>one<|endoftext|> two", "a▁b", "don't WON'T it's 42² ΣΑΣ", "x" * 3000 + " " + "abé" * 400, "tail ", "\x00 a\x00", "é é"]
    return made + [(900 + i, t, None if i % 2 else "fr", f"s{i % 3}", 0, 7, "k", "r") for i, t in enumerate(odd)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    pool = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")] + list(" \t\n\r\x1c\x1f\x85  'rsΣςİı▁ßﬁ") * 40
    return ["".join(rnd.choices(pool, k=rnd.randint(1, 40))) for _ in range(n)]


# Word BPE


@pytest.fixture(scope="module")
def words():
    return tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(words):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(words)


def test_bpe_equals_the_library(words, library, rows):
    model = bpe.WordBpe(words)
    for text in [r[1] or "" for r in rows] + odd_texts(4000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert model.encode(text) == ids, text
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False), text


def test_rank_array_and_heap_merge_alike(words):
    model, rnd = bpe.WordBpe(words), random.Random(3)
    made = [bytes(rnd.choices([*b"abcdeionstr", 0xC3, 0xA9, 0x2E], k=n)) for n in (*range(1, bpe.SHORT + 1), *range(1, 30), 200, 700) for _ in range(6)]
    for word, ids in zip(made, model.merged(made)):
        assert ids == model._by_heap(word)


def test_bpe_digests(docs, rows, empty, words, library):
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    def wanted(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))

    got = collections.Counter(tuple(r) for r in bpe.digests(docs, words).collect())
    assert got == collections.Counter((r[0], *wanted(r[1])) for r in rows)
    assert bpe.digests(empty, words).count() == 0


def test_bpe_round_trip(docs, empty, words, library):
    ids = bpe.encode_texts(docs, words, keep=("doc_id", "text"))
    for r in bpe.decode_ids(ids, words, keep=("text", "ids")).collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
    assert bpe.decode_ids(bpe.encode_texts(empty, words), words).count() == 0


def test_bpe_forgets_and_learns_again(words, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    memory, fresh = bpe.PartMemory(words), bpe.PartMemory(words)
    texts = ["one two three four", "five two", "x" * 100, "one " + "x" * 100, None]
    assert [x for t in texts for x in memory.encoded([t])] == list(fresh.encoded(texts))


# Alignment


@pytest.fixture(scope="module")
def files():
    return tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizers_(files):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(files[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=files[1])
    of = {s: i for i, s in enumerate(bpe.byte_symbols())}

    def both(text):
        """(id, bytes) of A's and of B's tokens by the contract."""
        if not text:
            return [], []
        own_a = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        own_b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
        raw = (" " + text).encode()
        return (own_a, own_b) if b"".join(x for _, x in own_a) == raw == b"".join(x for _, x in own_b) else ([], [])

    return both


def groups_of(own_a, own_b):
    """Groups, and links as all pairs of tokens that end at one byte, by comparing all ends."""
    ends = []
    for own in (own_a, own_b):
        at, out = 0, []
        for _, x in own:
            at += len(x)
            out.append(at)
        ends.append(out)
    found = [(own_a[i][0], own_b[j][0]) for i, x in enumerate(ends[0]) for j, y in enumerate(ends[1]) if x == y]
    groups, at = [], (0, 0)
    for cut in sorted({*ends[0]} & {*ends[1]}):
        stop = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append("|".join(",".join(str(i) for i, _ in own[lo:hi]) for own, lo, hi in zip((own_a, own_b), at, stop)))
        at = stop
    return groups, found


def test_parts_have_the_ids_of_whole_texts(files, tokenizers_):
    both = alignment.TwoTokenizers(*files)
    texts = ["", " ", "\n", "\n\n", "a\nb", " lead", "a  b   c ", "a \n b", "<s> </s> <unk> <0x0A> <|endoftext|>", "▁", "a▁b", *odd_texts(3000, 5)]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for text, *made in zip(part, *both.encode(part)):
            assert [np.frombuffer(x, "<u4").tolist() for x in made] == [[i for i, _ in own] for own in tokenizers_(text)], text


def test_overlaps_and_cuts():
    rnd = random.Random(2)
    for _ in range(200):
        total = rnd.randint(1, 30)
        lengths = [np.diff([0, *sorted(rnd.sample(range(1, total), rnd.randint(0, total - 1))), total]) for _ in range(2)]
        spans = [list(zip(np.cumsum(x) - x, np.cumsum(x))) for x in lengths]
        shared = [(i, j, min(b, d) - max(a, c)) for i, (a, b) in enumerate(spans[0]) for j, (c, d) in enumerate(spans[1]) if min(b, d) > max(a, c)]
        assert list(zip(*(x.tolist() for x in alignment.overlaps(*lengths)))) == shared
        assert list(zip(*(x.tolist() for x in alignment.cuts(*lengths)))) == [(i, j) for i, (_, b) in enumerate(spans[0]) for j, (_, d) in enumerate(spans[1]) if b == d]
    assert [len(x) for x in alignment.overlaps(np.zeros(0, int), np.zeros(0, int))] == [0, 0, 0]


def wanted_alignment(rows, both):
    made = [(r[0], *both(r[1])) for r in rows]
    found = [(doc, a, b, *groups_of(a, b)) for doc, a, b in made]
    count = collections.Counter(x for f in found for x in f[4])
    highest = collections.Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    for doc, a, b, groups, linked in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield doc, len(a), len(b), len(groups), len(linked), sum(count[x] == highest[x[1]] for x in linked), sum(count[x] for x in linked), digest


@pytest.mark.parametrize("size", [1 << 23, 2000])
def test_alignment_by_brute_force(docs, rows, files, tokenizers_, monkeypatch, size):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
    got = collections.Counter(tuple(r) for r in alignment.align(docs, *files).collect())
    assert got == collections.Counter(wanted_alignment(rows, tokenizers_))


def test_alignment_of_nothing(spark, empty, files):
    assert alignment.align(empty, *files).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (3, "▁"), (None, None)], "doc_id long, text string")
    assert sorted((tuple(r) for r in alignment.align(none, *files).collect()), key=str) == sorted([(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3, None)], key=str)


def test_alignment_query(spark, tmp_path, rows, tokenizers_):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = LLM_QUERIES["op11_alignment"](spark, str(tmp_path))
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(wanted_alignment(rows, tokenizers_))


# Divergence


def audit_by_hand(rows, least=3, ranks=200):
    find = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+").findall
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        own = [t.translate(lower) for t in find(text or "")]
        n.update((lang, source, t) for t in own)
        docs.update((lang, t) for t in set(own))
    out = []
    for lang, sources in groups.items():
        kept = [t for (g, t), k in docs.items() if g == lang and k >= least]
        size = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        of = lambda count, whole: 1 + 1_000_000_000 * (count + 1) // (whole + len(kept))  # noqa: B023, E731
        share = {s: {t: of(n[lang, s, t], size[s]) for t in kept} for s in sources}
        every = {t: of(sum(n[lang, s, t] for s in sources), sum(size.values())) for t in kept}
        excess = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pair = [(o, sum(excess(share[s][t], share[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, excess(share[s][t], every[t])) for t in kept if n[lang, s, t] and share[s][t] > every[t]]
            for part, items, most in (("pair", pair, None), ("term", term, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items[:most], 1)]
    return collections.Counter(out)


def test_divergence_by_brute_force(docs, rows, empty):
    assert collections.Counter(tuple(r) for r in divergence.audit(docs).collect()) == audit_by_hand(rows)
    assert collections.Counter(tuple(r) for r in divergence.audit(docs, least_docs=1, ranks=4).collect()) == audit_by_hand(rows, 1, 4)
    assert divergence.audit(empty).count() == 0


def test_divergence_of_small_blocks_and_hot_groups(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 300)
    monkeypatch.setattr(divergence, "SALTS", 3)
    rnd = random.Random(4)
    hot = [(5000 + i, " ".join(rnd.choices(["the", "The", "été", "á", "x-y", "z9z"], k=30)), "en", "s0" if i % 3 else "", 0, 7, "k", "r") for i in range(200)]
    hot += [(6000, "never kept", "de", "only", 0, 7, "k", "r"), (6001, "", "de", "second", 0, 7, "k", "r"), (6002, "alone", "it", None, 0, 7, "k", "r")]
    made = divergence.audit(spark.createDataFrame(rows + hot, SCHEMA).repartition(4))
    assert collections.Counter(tuple(r) for r in made.collect()) == audit_by_hand(rows + hot)


def test_shares_of_counts_beyond_longs(spark):
    n, size, terms = 40_000_000_000, 9_000_000_000_000, 3_000_000
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(size), F.lit(terms)).alias("p")).first()["p"]
    assert got == 1 + 1_000_000_000 * (n + 1) // (size + terms)


def test_divergence_oracle(spark, tmp_path, rows):
    import duckdb

    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    made = LLM_QUERIES["op13_divergence"](spark, str(tmp_path))
    assert collections.Counter(con.sql(LLM_ORACLES["op13_divergence"]).select("lang, source, part, item, value, rank").fetchall()) == collections.Counter(tuple(r) for r in made.collect())
