"""Interfaces of models that run in Python: tokenizers and encoders, loaded once for each worker."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a byte-level tokenizer takes for words, in lines whose white space is single spaces before other characters (its usual
#: pattern then needs no look ahead).
LINES = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\n"
#: Characters that both encoders of a vocabulary take alike: printable Latin, and signs. Line feeds part texts.
PLAIN = re.compile("[\n -~\u00a1-\u024f\u2010-\u2027\u2030-\u205e]*").fullmatch


def count_tokens(text: Column, load) -> Column:
    """Tokens of each text, special ones included; 0 for an empty or null text. load() gives a function from texts to lists of ids."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            some = texts.fillna("")
            yield pd.Series([len(ids) if t else 0 for t, ids in zip(some, encode(some.tolist()))], dtype="int64")

    return run(text)


def embed(text: Column, load) -> Column:
    """Vectors of unit length (of zeros where the model's is zero); a null text is empty. load() gives a function from texts to rows of numbers."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            rows = np.asarray(encode(texts.fillna("").tolist()), dtype=float).reshape(len(texts), -1)
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            yield pd.Series(list((rows / np.where(norm > 0, norm, 1)).astype("float32")))

    return run(text)


def token_offsets(path: str):
    """A loader, for executors, of a tokenizer file: texts to the character offsets of their tokens, without special ones."""

    def load():
        encode = open_()
        return lambda texts: [e.offsets for e in encode(texts, add_special_tokens=False)]

    open_ = _encoder(path, "encode_batch")
    return load


def token_encodings(path: str):
    """A loader, for executors, of a tokenizer file: texts to encodings as long as they have tokens, without special ones."""

    def load():
        encode = open_()
        return lambda texts: encode(texts, add_special_tokens=False)

    open_ = _encoder(path, "encode_batch_fast")
    return load


def token_ids(path: str, ranks_path: str):
    """A loader, for executors, of a byte-level tokenizer file and the ranks of its vocabulary: texts to their ids, without special
    ones. Plain texts are encoded by the faster encoder of the ranks, many together: a line feed between them is a token of its own."""

    def load():
        whole, (ranked, feed), special = open_(), _ranked(ranks_path), _special_tokens(path)

        def together(texts):
            """A line of each text, if they can be encoded so: plain ones without empty lines or spaces that meet others or a line's end."""
            lines = "\n".join(texts) + "\n"
            odd = len(texts) != lines.count("\n") or lines[0] == "\n" or any(s in lines for s in ("\n\n", "  ", " \n", *special))
            return None if odd or not PLAIN(lines) else lines

        def encode(texts):
            if not texts:
                return []
            if not (lines := together(texts)):
                if len(texts) == 1:
                    return [e.ids for e in whole(texts, add_special_tokens=False)]
                apart = [together([t]) is not None for t in texts]
                made = [iter(encode([t for t, p in zip(texts, apart) if p])), iter(whole([t for t, p in zip(texts, apart) if not p], add_special_tokens=False))]
                return [next(made[0]) if p else next(made[1]).ids for p in apart]
            ids = ranked.encode_to_numpy(lines)
            stops = np.flatnonzero(ids == feed).tolist()
            if len(stops) != len(texts):
                raise ValueError("a text holds the token of the line feed")
            return [ids[a:b] for a, b in zip([0, *[x + 1 for x in stops]], stops)]

        return encode

    open_ = _encoder(path, "encode_batch_fast")
    return load


def _encoder(path: str, method: str):
    def open_():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own would take the others' turns
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        return getattr(model, method)

    return open_


@lru_cache(maxsize=4)
def _special_tokens(path: str) -> tuple[str, ...]:
    """Marks of the special tokens in the file of a byte-level tokenizer, which must have the usual pattern and change no text."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    own = made.get("pre_tokenizer") or {}
    if own.get("type") != "ByteLevel" or not own.get("use_regex", True) or own.get("add_prefix_space") or made.get("normalizer"):
        raise ValueError(f"{path} isn't a plain byte-level tokenizer")
    return tuple(t["content"] for t in made.get("added_tokens", ()))


@lru_cache(maxsize=4)
def _ranked(path: str):
    """The encoder of a vocabulary of ranks, once for each worker, and the id of its line feed."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=LINES, mergeable_ranks=ranks, special_tokens={}), ranks[b"\n"]
