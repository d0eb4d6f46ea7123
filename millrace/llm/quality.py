"""Quality rules over in-document repetition, found with word-level suffix arrays.

A block of texts becomes one array of word codes; prefix doubling sorts all suffixes (comparisons never cross a text's
end) and its rank arrays give the longest common prefix of neighbours. A suffix's deepest LCP interval is the greater of
its two neighbour values; the intervals' maximal repeats are merged into covered spans. A text passes if repeats of
`min_words` or more cover at most `max_covered` percent of its words and no repeat is longer than `max_repeat` words.

Defined results: a null text has no words and fails the base rule; repeated rows are judged alike; an empty table gives
an empty result; texts of any length are taken whole, one at a time if long; other columns, whatever their names, pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import blocks

#: Repeats of 10 words and more may cover 15 % of the words, less than the base rule lets any 5-word windows cover: long
#: repeats are lines or passages said again, short ones may be idiom. (Published rules for 10-word repeats allow 10 %.)
MIN_WORDS, MAX_COVERED, MAX_REPEAT = 10, 15, 100
WINDOW, MAX_WINDOWED, LEAST_WORDS = 5, 20, 10
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"

FIELDS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("n_covered_words", T.LongType()), ("longest_repeat", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]


def suffix_ranks(first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Rank arrays of prefix doubling: the k-th ranks suffixes by their first 2^k words; the last ranks are all different.

    first: an integer for each word, different for words of different texts. end: the place after the text's last word.
    """
    _, inverse, count = np.unique(first, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[inverse].astype(np.int32)
    levels, step, n = [rank], 1, len(first)
    active = np.flatnonzero(count[inverse] > 1)
    while len(active):
        nxt = active + step
        second = np.where(nxt < end[active], rank[np.minimum(nxt, n - 1)], -1).astype(np.int64)
        key = rank[active].astype(np.int64) * (n + 1) + second + 1
        by = np.argsort(key)
        key, base = key[by], rank[active[by]]
        place = np.arange(len(by))
        new_group = np.r_[True, base[1:] != base[:-1]]
        new_part = np.r_[True, key[1:] != key[:-1]]
        group_at = np.maximum.accumulate(np.where(new_group, place, 0))
        part_at = np.maximum.accumulate(np.where(new_part, place, 0))
        rank = rank.copy()
        rank[active[by]] = base + (part_at - group_at)
        alone = new_part & np.r_[new_part[1:], True]
        active, step = active[by[~alone]], step * 2
        levels.append(rank)
    return levels


def repeat_lengths(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word the length of the longest repeat that starts there: its deepest LCP interval."""
    n = len(first)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    levels = suffix_ranks(first, end)
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1]] = np.arange(n)
    same = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]])
    one, two = suffixes[same], suffixes[same + 1]
    a, b, lcp = one.copy(), two.copy(), np.zeros(len(same), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < end[one]) & (b < end[two])
        equal = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        grown = equal.astype(np.int64) << k
        a, b, lcp = a + grown, b + grown, lcp + grown
    np.maximum.at(longest, one, lcp)
    np.maximum.at(longest, two, lcp)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words the union of repeats of at least `least` words covers."""
    at = np.flatnonzero(longest >= least)
    change = np.zeros(len(longest) + 1, np.int64)
    change[at] += 1
    np.subtract.at(change, at + longest[at], 1)
    return np.cumsum(change[:-1]) > 0


def repeats(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: words in repeated windows, words covered by long repeats, the longest repeat."""
    counts = np.array([len(w) for w in words], np.int64)
    n, texts = int(counts.sum()), len(words)
    if not n:
        return (np.zeros(texts, np.int64),) * 3
    codes = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
    doc = np.repeat(np.arange(texts), counts)
    first = doc * len(codes.dictionary) + codes.indices.to_numpy().astype(np.int64)
    longest = repeat_lengths(first, np.cumsum(counts)[doc])
    sums = [np.bincount(doc, covered(longest, k), texts).astype(np.int64) for k in (WINDOW, MIN_WORDS)]
    most = np.zeros(texts, np.int64)
    np.maximum.at(most, doc, longest)
    return sums[0], sums[1], most


def judge_texts(texts: list[str | None], max_covered=MAX_COVERED, max_repeat=MAX_REPEAT) -> list[np.ndarray]:
    """The columns of FIELDS for some texts."""
    texts = [t or "" for t in texts]
    words = [t.encode().split() for t in texts]  # bytes split at exactly \x20 and \x09-\x0D
    windowed, long_ones, most = repeats(words)
    n_words = np.array([len(w) for w in words], np.int64)
    word_chars = np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], np.int64)
    n_symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
    dup = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(BLANKS)]
        dup.append(len(lines) - len(set(lines)))
    failed = (n_words < LEAST_WORDS) | (100 * windowed > MAX_WINDOWED * n_words)
    kept = ~failed & (100 * long_ones <= max_covered * n_words) & (most <= max_repeat)
    return [n_words, word_chars, n_symbols, np.array(dup, np.int64), windowed, long_ones, most, failed, kept]


def assess(docs: DataFrame, text="text", keep=("doc_id",), **limits) -> DataFrame:
    """The columns `keep` of each row with its FIELDS."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t in FIELDS])

    def run(batches):
        for part in blocks(batches, text):
            found = judge_texts(part.column(part.schema.get_field_index(text)).to_pylist(), **limits)
            own = [part.column(part.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(own + [pa.array(x) for x in found], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def accepted(docs: DataFrame, text="text", **limits) -> DataFrame:
    """The rows whose text is kept, with all their columns."""
    at = docs.columns.index(text)

    def run(batches):
        for part in blocks(batches, text):
            kept = judge_texts(part.column(at).to_pylist(), **limits)[-1]
            yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
