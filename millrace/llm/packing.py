"""Best-fit packing of token sequences, improved by swap-based local search.

Documents become token ids plus an end mark; only longer ones than a sequence are cut, the first piece taking the
remainder. Pieces of equal length are interchangeable, so the packing is solved on the histogram of lengths (at most
`capacity` numbers, whatever the corpus): classes of equal bins, each a pattern of lengths and how many bins have it.
Best fit by falling length fills the classes; local search then moves one document, exchanges one for one, or two for
one (either way) between underfull bins wherever that raises the sum of squared fills, until bins empty or no move helps.
Pieces take their places by their rank among pieces of their length, a prefix sum over the parts that hold them.

Defined results: a null text is the end mark alone; repeated rows are pieces of their own, and so are those of a null doc_id;
an empty table packs nothing; texts of any length are encoded whole; other columns, whatever their names, stay out.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import blocks, materialise, no_collection

CAPACITY, END = 1024, 2
#: Distinct words of at most so many characters whose ids a task remembers.
REMEMBERED, LONGEST_WORD = 300_000, 48


class WordTokens:
    """Token ids of whole texts as little-endian bytes, through a memory of words.

    Byte-level BPE pre-tokenises so that in a text whose white space is single spaces and line feeds, a space goes with
    the word behind it and a line feed stands alone: the text has the ids of these parts. Other texts are cut only before
    spaces behind other characters than white space, and texts with marks of special tokens are encoded whole.
    New words of plain Latin letters, digits and signs are encoded together by the faster encoder of the same vocabulary
    (`ranks_path`), a line feed between them telling their ids apart; all others by `tokenizers`.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        self.path, self._model, self.known = path, None, {}
        self.special = _special_tokens(path)
        self.ranks = _ranks(ranks_path) if ranks_path else None
        self.cut = re.compile(r"(?<=\S)(?= )")
        self.plain = re.compile(" ?[!-~\u00a1-\u024f]+")

    @property
    def model(self):
        if self._model is None:
            from tokenizers import Tokenizer

            self._model = Tokenizer.from_file(self.path)
        return self._model

    def _encode(self, parts: list[str]) -> dict[str, bytes]:
        plain = [p for p in parts if self.ranks is not None and self.plain.fullmatch(p)]
        made = {}
        if plain:
            ids = np.array(self.ranks.encode_ordinary("\n".join(plain) + "\n"), "<u4")
            raw, ends = ids.tobytes(), np.flatnonzero(ids == self.feed).tolist()
            if len(ends) != len(plain):
                raise ValueError("a word holds the id of the line feed")
            at = 0
            for p, e in zip(plain, ends):
                made[p] = raw[4 * at : 4 * e]
                at = e + 1
        rest = [p for p in parts if p not in made]
        if rest:
            made.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(rest, self.model.encode_batch(rest, add_special_tokens=False)))
        return made

    @property
    def feed(self) -> int:
        return self.ranks.encode_ordinary("\n")[0]

    def _parts(self, text: str) -> list[str] | None:
        if any(s in text for s in self.special):
            return None
        if " ".join(text.split()) != text.replace("\n", " ") or "\0" in text:  # other white space, or runs of it
            return self.cut.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def ids(self, texts: list[str]) -> list[bytes]:
        parts = [self._parts(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        self.known[""] = b""
        own = [p for p in parts if p is not None]
        made = self._encode(list(set().union(*own).difference(self.known)))
        self.known.update(made)
        known = self.known.__getitem__
        out = [np.array(self.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if p is None else b"".join(map(known, p)) for t, p in zip(texts, parts)]
        for w in made:
            if len(w) > LONGEST_WORD:
                del self.known[w]
        return out


@lru_cache(maxsize=4)
def _special_tokens(path: str) -> tuple[str, ...]:
    """Texts of the added tokens that a tokenizer's file names."""
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", ()))


_loaded: dict = {}


def _ranks(path: str):
    """The encoder of a vocabulary of ranks, once for each worker."""
    if path not in _loaded:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, text="text", doc_id="doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and its part's number and rank among the part's pieces of its length."""

    def run(batches):
        from pyspark import TaskContext

        model, part, seen = WordTokens(tokenizer_path, ranks_path), TaskContext.get().partitionId(), Counter()
        tail = np.array([end], "<u4").tobytes()
        for block in blocks(batches, text, 1 << 20):
            with no_collection():  # strings, numbers and tuples of them make no cycles
                rows = []
                ids = model.ids([t or "" for t in block.column(1).to_pylist()])
                for doc, own in zip(block.column(0).to_pylist(), ids):
                    own += tail
                    n = len(own) // 4
                    first = n % capacity or capacity
                    for k, start in enumerate([0, *range(first, n, capacity)]):
                        stop = first if k == 0 else start + capacity
                        size = stop - start
                        rows.append((doc, k, start, size, zlib.crc32(own[4 * start : 4 * stop]), part, seen[size]))
                        seen[size] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(text))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Best fit by falling length over a histogram: pattern (falling lengths) -> bins."""
    spaces: list[int] = []  # of the open classes, rising
    by_space: dict[int, Counter] = {}

    def put(pattern, room, n):
        if n:
            if room not in by_space:
                by_space[room] = Counter()
                insort(spaces, room)
            by_space[room][pattern] += n

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(spaces, size)
            if at < len(spaces):
                room = spaces[at]
                pattern, n = by_space[room].popitem()
                if not by_space[room]:
                    del by_space[room]
                    spaces.pop(at)
                fit = room // size
                whole = min(n, left // fit)
                put(pattern + (size,) * fit, room - fit * size, whole)
                n, left = n - whole, left - whole * fit
                if n and left:  # fewer than fit are left for the next bin
                    put(pattern + (size,) * left, room - left * size, 1)
                    n, left = n - 1, 0
                put(pattern, room, n)
            else:
                fit = capacity // size
                put((size,) * fit, capacity - fit * size, left // fit)
                put((size,) * (left % fit), capacity - left % fit * size, 1 if left % fit else 0)
                left = 0
    return Counter({p: n for c in by_space.values() for p, n in c.items()})


@lru_cache(maxsize=1 << 16)
def _parts(pattern: tuple) -> tuple:
    """Rising sums of one, of two, and of one or two lengths of a bin, and the lengths that make a sum."""
    ones = {x: (x,) for x in pattern}
    twos = {x + y: (x, y) for i, x in enumerate(pattern) for y in pattern[i + 1 :]}
    return sorted(ones), sorted(twos), sorted({*ones, *twos}), ones, twos


def _gain(giver: tuple, taker: tuple, capacity: int):
    """The move between two bins, the taker at least as full, that raises their squared fills most: (what the giver gives, what it gets), or None.

    The rise, 2 d (d + fill - give), grows with what the taker gains, d; so the largest d that has room is best."""
    ones, twos, _, one, two = _parts(giver)
    backs, _, all_backs, back_one, back_two = _parts(taker)
    room, best, found = capacity - sum(taker), 0, None
    for outs, made, back in ((ones, one, all_backs), (twos, two, backs)):
        for x in outs:
            if x <= room:
                got = 0
            else:
                at = bisect_left(back, x - room)
                if at == len(back) or (got := back[at]) >= x:
                    continue
            if x - got > best:
                best, found = x - got, (made[x], (back_one.get(got) or back_two[got]) if got else ())
    return found


def _moved(pattern: tuple, out: tuple, back: tuple) -> tuple:
    c = Counter(pattern)
    c.subtract(out)
    c.update(back)
    return tuple(sorted(c.elements(), reverse=True))


def local_search(bins: Counter, capacity: int = CAPACITY) -> Counter:
    """Move and exchange documents between classes of underfull bins, the emptiest giving, while squared fill rises.

    Ends when no move helps or as few bins are open as their words need. A class is tried with all others once; after a
    move only the classes it made are tried anew.
    """
    full = Counter({p: n for p, n in bins.items() if n and sum(p) == capacity})
    open_ = {p: n for p, n in bins.items() if n and p and sum(p) < capacity}
    words, count = sum(sum(p) * n for p, n in open_.items()), sum(open_.values())
    order = sorted((sum(p), p) for p in open_)  # the open classes, rising
    heap, tried = list(order), set()
    while heap and -(-words // capacity) < count:
        _, own = heappop(heap)
        for fill, other in reversed(order.copy()):
            if own not in open_:
                break
            for giver, taker in ((own, other), (other, own)):
                if sum(taker) < sum(giver) or (giver, taker) in tried:
                    continue
                if giver not in open_ or taker not in open_ or (giver == taker and open_[giver] < 2):
                    continue
                move = _gain(giver, taker, capacity)
                if move is None:
                    tried.add((giver, taker))
                    continue
                n = open_[giver] // 2 if giver == taker else min(open_[giver], open_[taker])
                for old, new in ((giver, _moved(giver, *move)), (taker, _moved(taker, *move[::-1]))):
                    open_[old] -= n
                    if not open_[old]:
                        del open_[old]
                        del order[bisect_left(order, (sum(old), old))]
                    if not new:
                        count -= n
                    elif sum(new) == capacity:
                        full[new] += n
                        words, count = words - capacity * n, count - n
                    else:
                        if new not in open_:
                            insort(order, (sum(new), new))
                            heappush(heap, (sum(new), new))
                        elif giver == taker or open_[new] == 1:
                            heappush(heap, (sum(new), new))  # two of a class are a pair that one was not
                        open_[new] = open_.get(new, 0) + n
    return full + Counter(open_)


def slots(bins: Counter) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset): where pieces of a length go by rank."""
    out, given, base = [], Counter(), 0
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for size in pattern:
            out.append((size, given[size], given[size] + n, base, offset))
            given[size] += n
            offset += size
        base += n
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = materialise(pieces(docs, tokenizer_path, capacity=capacity, **options), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places: dict[int, list] = {}
    for size, *rest in slots(local_search(best_fit(histogram, capacity), capacity)):
        places.setdefault(size, []).append(rest)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))

    def run(batches):
        table = {k: np.array(sorted(v), np.int64) for k, v in places.items()}
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for k in np.unique(size).tolist():
                own = np.flatnonzero(size == k)
                t = table[k]
                at = np.searchsorted(t[:, 0], rank[own], "right") - 1
                sequence[own], offset[own] = t[at, 2] + rank[own] - t[at, 0], t[at, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
