"""Alignment of two tokenizers' tokens by byte-owner arrays, and how often their ids are linked in the corpus.

The tokens of A and of B tile the same bytes. np.repeat of the token numbers over their lengths gives each byte its owner in
A and in B: consecutive different owner pairs are the overlaps, and where both owners change at once is a cut. Cuts part the
tokens into groups; the last tokens of a group end together and are linked (as tokens tile the text, a group has one link).

Links are counted in two steps without a row per link. A block of texts has a dictionary of its id pairs; its documents hold
numbers into it. Dictionaries, not documents, are shuffled by pair to be summed, and come back to their blocks with the
corpus-wide counts, where a task looks up its documents' links. A frequent pair has one row a block.

A encodes a space and the text by a byte-level BPE file of `tokenizers`, B the text by a `sentencepiece` BPE model, which puts
the space there itself. Both are asked only for parts that a task doesn't remember: A's rule and B's pieces allow no token
across the parts' borders (checked when the model is loaded), so that parts have the same tokens as whole texts.

Defined results: texts that are null, empty or not given back byte by byte by either tokenizer have no tokens, zeros and an
empty digest; special tokens' strings are plain text; equal counts are all the highest; repeated rows count each; an empty
table gives an empty result; texts of any length are encoded whole; other columns, whatever their names, stay out.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import byte_symbols
from millrace.llm.common import blocks, materialise, no_collection
from millrace.llm.packing import WordTokens

#: Parts that a task remembers, and their longest length; bytes of text that share a dictionary of pairs.
REMEMBERED, LONGEST, BLOCK_BYTES = 300_000, 48, 8 << 20
#: An id pair is one number: A's id times this, plus B's.
PAIR = 1 << 31
MARK = "▁"


class ByteTokens(WordTokens):
    """A: ids and bytes of parts by a byte-level BPE; special tokens' strings are plain text."""

    def __init__(self, path: str, ranks_path: str | None = None):
        super().__init__(path, ranks_path)
        self.model.encode_special_tokens = True
        of = {s: b for b, s in enumerate(byte_symbols())}
        own = self.model.get_vocab()
        self.bytes: list[bytes] = [b""] * (max(own.values()) + 1)
        for token, i in own.items():
            self.bytes[i] = bytes(of[ch] for ch in token) if all(ch in of for ch in token) else token.encode()

    def cut_text(self, text: str) -> list[str]:
        """A space and the text in parts between which no token of A or of B reaches (see WordTokens)."""
        if " ".join(text.split()) != text.replace("\n", " ") or "\0" in text:
            return self.cut.split(" " + text)
        return (" " + text).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def parts(self, parts: list[str]) -> dict[str, bytes]:
        return self._encode(parts)


class PieceTokens:
    """B: ids and bytes of parts by a sentencepiece model. A part begins with a space, a line feed, or behind a line feed."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if not model.is_byte(i) and (MARK in piece.lstrip(MARK) or "\n" in piece):
                raise ValueError(f"{path} has pieces across words")
            self.bytes.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else piece.replace(MARK, " ").encode())
        one = model.encode("\n")
        self.feed = len(model.encode("\n\n")) - len(one)  # how many ids a line feed has
        self.space = one[: -self.feed]  # those of the space put before it

    def parts(self, parts: list[str]) -> dict[str, bytes]:
        # The model puts a space before what it is given: one that a part has is left out, one that it hasn't is taken off again.
        asked = [p[1:] if p[:1] == " " else p if p[:1] == "\n" else "\n" + p for p in parts]
        off = [0 if p[:1] == " " else len(self.space) + (p[:1] != "\n") * self.feed for p in parts]
        made = {p: np.array(ids[k:], "<u4").tobytes() for p, k, ids in zip(parts, off, self.model.encode(asked, num_threads=1))}
        if " " in made:  # the model puts no space before nothing
            made[" "] = np.array(self.space, "<u4").tobytes()
        return made


@lru_cache(maxsize=2)
def _models(a_path: str, ranks_path: str | None, b_path: str):
    """Both tokenizers, once for each worker."""
    return ByteTokens(a_path, ranks_path), PieceTokens(b_path)


class TwoTokenizers:
    """Ids of whole texts by both tokenizers, through a memory of parts."""

    def __init__(self, a_path: str, b_path: str, ranks_path: str | None = None):
        self.a, self.b = _models(a_path, ranks_path, b_path)
        self.lengths = [np.array([len(x) for x in m.bytes], np.int32) for m in (self.a, self.b)]
        self.known_a, self.known_b, self.lossy = {}, {}, set()

    def _learn(self, new: list[str]) -> None:
        a, b = self.a.parts(new), self.b.parts(new)
        for p in new:
            raw = p.encode()
            if any(b"".join(map(m.bytes.__getitem__, np.frombuffer(own[p], "<u4").tolist())) != raw for m, own in ((self.a, a), (self.b, b))):
                self.lossy.add(p)
        self.known_a.update(a)
        self.known_b.update(b)

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """A's and B's ids of each text as little-endian bytes; none of a text that either doesn't give back."""
        parts = [self.a.cut_text(t) if t else [] for t in texts]
        if len(self.known_a) > REMEMBERED:
            self.known_a, self.known_b, self.lossy = {}, {}, set()
        new = list(set().union(*parts).difference(self.known_a, ("",)))
        self._learn(new)
        self.known_a[""] = self.known_b[""] = b""
        a, b = ([b"".join(map(known.__getitem__, own)) for own in parts] for known in (self.known_a, self.known_b))
        if self.lossy:
            for k, own in enumerate(parts):
                if not self.lossy.isdisjoint(own) and not self._gives_back(texts[k], a[k], b[k]):
                    a[k] = b[k] = b""
        for p in new:
            if len(p) > LONGEST:
                del self.known_a[p], self.known_b[p]
                self.lossy.discard(p)
        return a, b

    def _gives_back(self, text: str, a: bytes, b: bytes) -> bool:
        raw = (" " + text).encode()
        return all(b"".join(map(m.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())) == raw for m, ids in ((self.a, a), (self.b, b)))


def owners(lengths: np.ndarray) -> np.ndarray:
    """The number of the token that owns each byte."""
    return np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)


def overlaps(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, bytes shared) of every overlap, in order."""
    a, b = owners(a_lengths), owners(b_lengths)
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return a[new], b[new], np.diff(np.r_[new, len(a)])


def cuts(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last A token and the last B token of every group: both owners change behind them, or the text ends."""
    a, b = owners(a_lengths), owners(b_lengths)
    both = np.flatnonzero(np.r_[(a[1:] != a[:-1]) & (b[1:] != b[:-1]), True]) if len(a) else np.zeros(0, np.int64)
    return a[both], b[both]


def links(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (A token, B token) pairs whose byte ranges end together, each once: those at the cuts."""
    return cuts(a_lengths, b_lengths)


class Printer:
    """Groups as text, `a1,a2|b1;a3|b2,b3`: a string for each id with the sign behind it."""

    def __init__(self, n_a: int, n_b: int):
        self.base = 2 * n_a
        self.strings = [b"%d%s" % (i, s) for i in range(n_a) for s in (b",", b"|")] + [b"%d%s" % (i, s) for i in range(n_b) for s in (b",", b";")]

    def texts(self, a_ids, b_ids, a_last, b_last, stops):
        """Groups of a block in one line, parted behind the tokens `stops` (A's and B's counted together)."""
        a_sizes, b_sizes = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        first = np.cumsum(a_sizes + b_sizes) - a_sizes - b_sizes
        codes = np.empty(len(a_ids) + len(b_ids), np.int64)
        for ids, sizes, last, base, before in ((a_ids, a_sizes, a_last, 0, 0), (b_ids, b_sizes, b_last, self.base, a_sizes)):
            own = 2 * ids.astype(np.int64) + base
            own[last] += 1
            codes[np.arange(len(ids)) + np.repeat(first + before - (last - sizes + 1), sizes)] = own
        codes, start = list(map(self.strings.__getitem__, codes.tolist())), 0
        for stop in stops.tolist():
            yield b"".join(codes[start:stop])[:-1]
            start = stop


@lru_cache(maxsize=1)
def _printer(n_a: int, n_b: int) -> Printer:
    return Printer(n_a, n_b)


class BlockLinks:
    """Aligned documents of a block, and its dictionary of linked id pairs."""

    def __init__(self, both: TwoTokenizers):
        self.both, self.docs, self.codes, self.counts, self.size = both, [], [], [], 0
        self.printer = _printer(len(both.a.bytes), len(both.b.bytes))

    def add(self, ids: list, texts: list[str | None]) -> None:
        a_raw, b_raw = self.both.encode(texts)
        n_a, n_b = (np.array([len(x) // 4 for x in raw], np.int64) for raw in (a_raw, b_raw))
        a_ids, b_ids = (np.frombuffer(b"".join(raw), "<u4") for raw in (a_raw, b_raw))
        # Texts end with both their tokens, so those of a slice are aligned at once.
        a_last, b_last = links(self.both.lengths[0][a_ids], self.both.lengths[1][b_ids])
        group_ends = np.searchsorted(a_last, np.cumsum(n_a) - 1, "right")
        group_ends[n_a.cumsum() == 0] = 0
        n_groups = np.diff(group_ends, prepend=0)
        prints = [hashlib.sha256(x).hexdigest() if x else "" for x in self.printer.texts(a_ids, b_ids, a_last, b_last, np.cumsum(n_a + n_b))]
        self.docs.append((ids, n_a, n_b, n_groups, prints))
        self.codes.append(a_ids[a_last].astype(np.int64) * PAIR + b_ids[b_last])
        self.counts.append(n_groups)
        self.size += sum(len(t) for t in texts if t)

    def batch(self, block: int) -> pa.RecordBatch:
        pairs, number = np.unique(np.concatenate(self.codes), return_inverse=True)
        n_links = np.concatenate(self.counts)
        doc = np.repeat(np.arange(len(n_links)), n_links)
        # Different pairs of a document, with how often each is linked there.
        held, times = np.unique((doc << 32) | number, return_counts=True)
        ends = np.r_[0, np.cumsum(np.bincount(held >> 32, minlength=len(n_links)))].astype(np.int32)
        of = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, kind))
        first = np.r_[True, np.zeros(len(n_links) - 1, bool)]
        totals = np.bincount(number, minlength=len(pairs))
        dictionary = [pa.array([x.tolist() if f else None for f in first], pa.list_(pa.int64())) for x in (pairs, totals)]
        columns = [pa.array(np.concatenate([d[k] for d in self.docs])) for k in (1, 2, 3)]
        ids = pa.array([i for d in self.docs for i in d[0]], pa.int64())
        prints = pa.array([x for d in self.docs for x in d[4]], pa.string())
        own = [of((held & 0xFFFFFFFF).astype(np.int32), pa.int32()), of(times.astype(np.int32), pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n_links), block, np.int64)), ids, *columns, prints, *own, *dictionary], names=list(ALIGNED))


ALIGNED = {"block": "long", "doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "groups_sha256": "string", "numbers": "array<int>", "times": "array<int>", "pairs": "array<long>", "totals": "array<long>"}


def aligned(docs: DataFrame, a_path: str, b_path: str, ranks_path: str | None = None, text="text", doc_id="doc_id") -> DataFrame:
    """A row per document: figures, the digest of its groups, and its links as numbers into the dictionary of its block, which
    the block's first row holds (pairs, and how often the block links each)."""

    def run(batches):
        from pyspark import TaskContext

        both, block = TwoTokenizers(a_path, b_path, ranks_path), TaskContext.get().partitionId() << 32
        held = BlockLinks(both)
        for part in blocks(batches, "text"):
            with no_collection():
                held.add(part.column(0).to_pylist(), part.column(1).to_pylist())
            if held.size >= BLOCK_BYTES:
                yield held.batch(block)
                block, held = block + 1, BlockLinks(both)
        if held.docs:
            yield held.batch(block)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in ALIGNED.items()))


def pair_counts(entries: DataFrame) -> DataFrame:
    """pair, count, best: links of each id pair over all blocks, and whether no other A id is linked to its B id more often."""
    counts = entries.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(PAIR - 1)))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _resolved(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """n_links, n_best and count_sum of a block's documents from its dictionary's counts."""
    at = np.asarray(counts["number"])
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at], best[at] = np.asarray(counts["count"]), np.asarray(counts["best"]).astype(np.int64)
    docs = docs.combine_chunks()
    sizes = np.asarray(pa.compute.list_value_length(docs["numbers"]))
    number, times = (np.asarray(pa.compute.list_flatten(docs[c])).astype(np.int64) for c in ("numbers", "times"))
    ends = np.r_[0, np.cumsum(sizes)]
    sums = [np.r_[0, np.cumsum(x)] for x in (times, times * best[number], times * count[number])] if len(number) else [np.zeros(1, np.int64)] * 3
    made = [pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums]
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    return pa.table([*(docs[c] for c in names), *made], names=[*names, "n_links", "n_best", "count_sum"])


def align(docs: DataFrame, a_path: str, b_path: str, ranks_path: str | None = None, **columns) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    made = materialise(aligned(docs, a_path, b_path, ranks_path, **columns), "aligned")
    entries = made.filter(F.size("pairs") > 0).select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("number", "e"))
    entries = entries.select("block", "number", F.col("e.pairs").alias("pair"), F.col("e.totals").alias("n"))
    back = entries.join(pair_counts(entries), "pair").select(F.col("block").alias("of"), "number", "count", "best")
    own = made.select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "numbers", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long"
    out = own.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_resolved, schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
