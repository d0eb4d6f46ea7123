"""Token counts by a unigram model, with dynamic programming shared along a trie of distinct pre-tokens.

Scores come from a public vocabulary, since tokenizers aren't trained here: a piece's score there is its merge rank, so as a
unigram model its log-probability is taken from Zipf's law, -ln(rank + 2.7). A block's distinct pre-tokens (words behind the word mark) are put in a trie;
a walk computes each node's best forward score and its number of tokens once, from nodes above it on the same path, so a
shared prefix is never scored twice. Counts stand at the terminals. A character in no piece costs its UTF-8 bytes.

Defined results: a null or blank text has no tokens; equal scores go to fewer tokens; repeated rows are counted alike; an empty
table gives an empty result; texts and words of any length are counted whole; other columns, whatever their names, stay out.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import blocks, no_collection

MARK = "▁"
#: Pre-tokens of more bytes stay out of the trie.
TRIE_BYTES = 2048
#: Distinct pre-tokens whose counts a task remembers from block to block, and their longest length.
REMEMBERED, LONGEST = 500_000, 48
ZIPF = 2.7


class UnigramVocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores = {}
        n = model.get_piece_size()
        for i in range(n):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.scores[model.id_to_piece(i)] = -math.log(len(self.scores) + ZIPF)
        self.longest = max(map(len, self.scores))
        self.trie: dict = {}  # children by character; a node is [children, score of the piece that ends here]
        for piece, score in self.scores.items():
            at = self.trie
            for ch in piece:
                node = at.get(ch)
                if node is None:
                    node = at[ch] = [{}, None]
                at = node[0]
            node[1] = score
        self.byte = -math.log(n + ZIPF) - 1.0  # below every piece


class Trie:
    """Distinct pre-tokens; a node is [children by character, whether a pre-token ends here]."""

    def __init__(self):
        self.root = [{}, False]
        self.nodes = 0

    def add(self, word: str) -> None:
        node = self.root
        for ch in word:
            child = node[0].get(ch)
            if child is None:
                child = node[0][ch] = [{}, False]
                self.nodes += 1
            node = child
        node[1] = True

    def token_counts(self, vocabulary: UnigramVocabulary) -> dict[str, int]:
        """Tokens of the best segmentation at each terminal. best[d] is that of the path's first d characters, begun[d] has
        the pieces that may go on there: where they start and their place in the vocabulary's trie."""
        byte, pieces, found = vocabulary.byte, vocabulary.trie, {}
        path, best, begun = [], [(0.0, 0)], [[]]
        stack = [(1, ch, child) for ch, child in self.root[0].items()]
        if self.root[1]:
            found[""] = 0
        while stack:
            depth, ch, node = stack.pop()
            del path[depth - 1 :], best[depth:], begun[depth:]
            path.append(ch)
            cost = len(ch.encode())
            score, n = best[depth - 1]
            top, least, on = score + cost * byte, n + cost, []
            for start, at in (*begun[depth - 1], (depth - 1, pieces)):
                piece = at.get(ch)
                if piece is None:
                    continue
                longer, own = piece
                if longer:
                    on.append((start, longer))
                if own is not None:
                    score, n = best[start]
                    score += own
                    if score > top or (score == top and n + 1 < least):
                        top, least = score, n + 1
            best.append((top, least))
            begun.append(on)
            if node[1]:
                found["".join(path)] = least
            stack += [(depth + 1, c, child) for c, child in node[0].items()]
        return found


def long_count(word: str, vocabulary: UnigramVocabulary) -> int:
    """The same recurrence for one very long pre-token, without a trie: only the last `longest` scores are held."""
    best = [(0.0, 0)]
    for d, ch in enumerate(word, 1):
        cost = len(ch.encode())
        top = (best[-1][0] + cost * vocabulary.byte, -(best[-1][1] + cost))
        for size in range(1, min(len(best), vocabulary.longest) + 1):
            own = vocabulary.scores.get(word[d - size : d])
            if own is not None:
                top = max(top, (best[-size][0] + own, -(best[-size][1] + 1)))
        best = [*best[-vocabulary.longest :], (top[0], -top[1])]
    return best[-1][1]


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> UnigramVocabulary:
    """A vocabulary, once for each worker."""
    return UnigramVocabulary(path)


class TokenCounter:
    """Token counts of texts, block by block, remembering pre-tokens seen before."""

    def __init__(self, path: str):
        self.vocabulary, self.known = _vocabulary(path), {}

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        words = [(t or "").encode().split() for t in texts]
        n_words = np.array([len(w) for w in words], np.int64)
        tokens = np.zeros(len(texts), np.int64)
        if not n_words.sum():
            return n_words, tokens
        codes = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
        distinct = codes.dictionary.to_pylist()
        with no_collection():
            trie = Trie()
            for w in distinct:
                if w not in self.known and len(w) <= TRIE_BYTES:
                    trie.add(MARK + w.decode())
            new = trie.token_counts(self.vocabulary)
            del trie
        known = self.known
        each = [known[w] if w in known else new[MARK + w.decode()] if len(w) <= TRIE_BYTES else long_count(MARK + w.decode(), self.vocabulary) for w in distinct]
        each = np.array(each, np.int64)
        if len(known) > REMEMBERED:
            known.clear()
        known.update((w, int(n)) for w, n in zip(distinct, each) if len(w) <= LONGEST)
        doc = np.repeat(np.arange(len(texts)), n_words)
        tokens += np.bincount(doc, each[codes.indices.to_numpy()], len(texts)).astype(np.int64)
        return n_words, tokens


def count_tokens(docs: DataFrame, vocabulary_path: str, text="text", keep=("doc_id",)) -> DataFrame:
    """The columns `keep` of each row with n_words and n_tokens."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens")])

    def run(batches):
        counter = TokenCounter(vocabulary_path)
        for part in blocks(batches, text):
            at = part.schema.get_field_index
            found = counter.counts(part.column(at(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(at(c)) for c in keep] + [pa.array(x) for x in found], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
