"""Byte-pair encoding with word ends, and decoding, by a contiguous rank array.

A text is cut at ASCII white space; no rule of such a tokenizer reaches across it, so a part's tokens are the same in any
text. A part is cut at special tokens, normalised and pre-tokenised into words. A short word holds its parts and the rank of
every adjacent pair side by side: the least rank is found by a scan, the boundary between its parts is deleted (what is
behind moves up), and the ranks of the two neighbouring pairs are refreshed, until no pair has a rank. Words of about one length
do so together, a row each of two NumPy arrays. The scan is quadratic, so words of more than `SHORT` symbols take the
same merges from a heap. Plain Latin parts are normalised and pre-tokenised here, all others by the tokenizer's own normaliser
and pre-tokeniser, whose Unicode tables decide. A task remembers the ids of words and parts, up to a bound.

Defined results: a null, empty or blank text has no tokens, an empty list of ids and an empty decoded text; equal ranks merge
from the left; special tokens in a text are tokens, as in the library's default; repeated rows are encoded alike; an empty
table gives an empty result; texts and words of any length are encoded whole; other columns, whatever their names, stay out.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import blocks, no_collection

#: Words of more symbols take their merges from a heap.
SHORT = 64
#: Distinct parts that a task remembers, and their longest length in bytes.
REMEMBERED, LONGEST = 500_000, 64
NO_RANK = (1 << 31) - 1


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from U+0100 on, in order."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a tokenizer file: byte-level BPE with an end-of-word suffix and no decoder of its own."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path} isn't plain byte-pair encoding")
        if made.get("decoder") or made.get("post_processor"):
            raise ValueError(f"{path} has a decoder or post-processor of its own")
        self.path, self.vocab, self.end = path, model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.bytes_of = {s: b for b, s in enumerate(self.symbols)}
        # Pairs of ids as one sorted number each, their ranks, and the id that a rank's merge makes.
        keys = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([*self.ranks.values()], np.int32)[order]
        self.makes = np.array([self.vocab[a + b] for a, b in self.ranks], np.int32)
        self.byte_ids, self.end_ids = (np.array([self.vocab[s + e] for s in self.symbols], np.int32) for e in ("", self.end))
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        split = made["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(split["pattern"]["Regex"] + "|\n").findall  # a line feed parts words of many parts
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # Latin letters that are composed, whose lower case is one letter, and signs: nothing here is combined or white space.
        self.plain = regex.compile("[!-~¡-¬®-ÿĀ-įĲ-ſ]*").fullmatch
        self._library = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _pre_tokens(self, part: str) -> list[bytes]:
        """Words of a part without special tokens, by the library."""
        own, of = self.library, self.bytes_of
        return [bytes(of[ch] for ch in w) for w, _ in own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(part))]

    def pre_tokens(self, parts: list[str]) -> list[list[bytes | int]]:
        """The words of parts without ASCII white space; an id stands for a special token."""
        out: list = [None] * len(parts)
        plain = [k for k, p in enumerate(parts) if self.plain(p) and not (self.marks and self.marks.search(p))]
        own: list = []
        at = iter(plain)
        for w in self.words("\n".join([parts[k] for k in plain]).lower() + "\n") if plain else ():
            if w == "\n":
                out[next(at)], own = own, []
            else:
                own.append(w.encode())
        for k, p in enumerate(parts):
            if out[k] is None:
                pieces = self.marks.split(p) if self.marks else [p]
                out[k] = [w for x in pieces if x for w in ([self.special[x]] if x in self.special else self._pre_tokens(x))]
        return out

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; NO_RANK of those that don't merge, and of ids below nought."""
        codes = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, codes), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == codes) & (right >= 0), self.pair_ranks[at], NO_RANK)

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words."""
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        long = np.flatnonzero(sizes > SHORT).tolist()
        for k in long:
            out[k] = self._by_heap(words[k])
        low = 0
        for width in (4, 8, 16, 32, SHORT):
            own = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if len(own):
                for k, ids in zip(own.tolist(), self._by_ranks([words[k] for k in own.tolist()], sizes[own], width)):
                    out[k] = ids
        return out

    def _by_ranks(self, words: list[bytes], sizes: np.ndarray, width: int) -> list[list[int]]:
        """The ids of words of at most `width` symbols: rows of parts and of the ranks of adjacent pairs, -1 and NO_RANK behind."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes) - 1
        symbols = self.byte_ids[raw]
        symbols[ends] = self.end_ids[raw[ends]]
        parts = np.full((len(words), width + 1), -1, np.int32)
        parts[np.arange(width + 1) < sizes[:, None]] = symbols
        ranks = self.ranks_of(parts[:, :-1], parts[:, 1:])
        done, rows, column = parts.copy(), np.arange(len(words)), np.arange(width + 1)
        while len(rows):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), at]
            live = least < NO_RANK
            if not live.all():
                done[rows[~live]] = parts[~live]
                rows, parts, ranks, at, least = rows[live], parts[live], ranks[live], at[live], least[live]
            # Delete the boundary behind part `at`: what is behind moves up.
            each = np.arange(len(rows))
            parts[each, at] = self.makes[least]
            moved = np.minimum(column + (column > at[:, None]), width)
            parts = np.take_along_axis(parts, moved, 1)
            parts[:, width] = -1
            ranks = np.take_along_axis(ranks, np.minimum(moved[:, :width], width - 1), 1)
            ranks[:, width - 1] = NO_RANK
            # Refresh the pairs before and behind the new part.
            ranks[each, at] = self.ranks_of(parts[each, at], parts[each, at + 1])
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.ranks_of(parts[some, at[some] - 1], parts[some, at[some]])
        lengths = (done >= 0).sum(1)
        flat, stops = done[done >= 0].tolist(), np.cumsum(lengths).tolist()
        return [flat[stop - n : stop] for stop, n in zip(stops, lengths.tolist())]

    def _by_heap(self, word: bytes) -> list[int]:
        """The same merges, least rank and then leftmost first, for a long word: parts are a linked list."""
        rank, parts, n = self.ranks.get, [self.symbols[b] for b in word], len(word)
        parts[-1] += self.end
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]), NO_RANK)) < NO_RANK]
        heapify(heap)
        while heap:
            _, i, j, a, b = heappop(heap)
            if parts[i] != a or after[i] != j or parts[j] != b:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank((parts[x], parts[y]), NO_RANK)) < NO_RANK:
                    heappush(heap, (r, x, y, parts[x], parts[y]))
        return [self.vocab[p] for p in parts if p is not None]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        words = [w for own in self.pre_tokens([p.decode() for p in (text or "").encode().split()]) for w in own]
        made = iter(self.merged([w for w in words if not isinstance(w, int)]))
        return [i for w in words for i in ([w] if isinstance(w, int) else next(made))]

    def decode(self, ids) -> str:
        """The text of ids: their tokens, special ones too, with a space between them."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """A tokenizer, once for each worker."""
    return WordBpe(path)


class PartMemory:
    """Encoded and decoded texts through a memory of words and of parts: each has its ids, and its tokens, with a space behind
    every one."""

    def __init__(self, path: str):
        self.model, self.words, self.ids, self.tokens = tokenizer(path), {}, {}, {}
        names = self.model.names
        self.number = [b"%d " % i for i in range(max(names) + 1)]
        self.name = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]

    def _learn(self, parts: list[bytes]) -> None:
        own = self.model.pre_tokens([p.decode() for p in parts])
        new = [w for w in set().union(*own).difference(self.words) if not isinstance(w, int)]
        self.words.update(zip(new, self.model.merged(new)))
        words, number, name = self.words, self.number.__getitem__, self.name.__getitem__
        for p, w in zip(parts, own):
            if len(w) == 1 and not isinstance(w[0], int):
                ids = words[w[0]]
            else:
                ids = [i for x in w for i in ([x] if isinstance(x, int) else words[x])]
            self.ids[p] = b"".join(map(number, ids))
            self.tokens[p] = b"".join(map(name, ids))
        for w in new:
            if len(w) > LONGEST:
                del words[w]

    def encoded(self, texts: list[str | None]):
        """(ids, tokens) of each text as bytes, spaces between."""
        parts = [(t or "").encode().split() for t in texts]
        with no_collection():
            if len(self.ids) > REMEMBERED:
                self.words.clear()
                self.ids.clear()
                self.tokens.clear()
            new = list(set().union(*parts).difference(self.ids))
            if new:
                self._learn(new)
            for own in parts:
                yield b"".join(map(self.ids.__getitem__, own))[:-1], b"".join(map(self.tokens.__getitem__, own))[:-1]
            for p in new:
                if len(p) > LONGEST:
                    del self.ids[p], self.tokens[p]


def encode_texts(docs: DataFrame, path: str, text="text", keep=("doc_id",)) -> DataFrame:
    """The columns `keep` of each row with its token ids (array<int>)."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        memory = PartMemory(path)
        for part in blocks(batches, text):
            at = part.schema.get_field_index
            found = [list(map(int, ids.split())) for ids, _ in memory.encoded(part.column(at(text)).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(at(c)) for c in keep] + [pa.array(found, pa.list_(pa.int32()))], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, path: str, ids="ids", keep=("doc_id",)) -> DataFrame:
    """The columns `keep` of each row with the text its ids stand for; a null list gives an empty text."""
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())])

    def run(batches):
        model = tokenizer(path)
        for batch in batches:
            at = batch.schema.get_field_index
            found = [model.decode(x or ()) for x in batch.column(at(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(at(c)) for c in keep] + [pa.array(found, pa.string())], names=schema.names)

    return rows.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, text="text", keep=("doc_id",)) -> DataFrame:
    """The columns `keep` of each row with n_tokens, ids_sha256 and decoded_sha256: hashes of the decimal ids joined by a space,
    and of the decoded text in UTF-8. Ids and decoded texts stay in the task that made them."""
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([docs.schema[c] for c in keep] + made)

    def run(batches):
        memory, sha = PartMemory(path), hashlib.sha256
        for part in blocks(batches, text):
            at, counts, ids_sha, text_sha = part.schema.get_field_index, [], [], []
            for ids, decoded in memory.encoded(part.column(at(text)).to_pylist()):
                counts.append(ids.count(b" ") + 1 if ids else 0)
                ids_sha.append(sha(ids).hexdigest())
                text_sha.append(sha(decoded).hexdigest())
            found = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(at(c)) for c in keep] + found, names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
