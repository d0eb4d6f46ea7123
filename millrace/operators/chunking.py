"""Page spans, chunk policies, chunks with exact offsets, length audits, samples by size.

`token_chunks` counts one word as one token, with two special tokens a chunk: whole words of the normalized text, `size` words
long, `size - overlap` apart. `subword_chunks` packs whole words by the tokens of a model's tokenizer.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType
from pyspark.sql.window import Window

from millrace.operators.ordering import row_numbers

# Label, size, overlap, unit.
POLICIES = (("tokens-128", 128, 13, "tokens"), ("tokens-256", 256, 26, "tokens"), ("tokens-384", 384, 38, "tokens"), ("tokens-480", 480, 48, "tokens"), ("tokens-512", 512, 51, "tokens"), ("characters-2500", 2500, 100, "characters"))
SPECIAL = 2
#: Characters of the texts whose chunks leave a task together.
CUT_CHARACTERS = 1 << 20
#: Words whose own tokens a task remembers.
KNOWN_WORDS = 3 << 17


def concat_pages(pages: DataFrame) -> DataFrame:
    """doc_id and its non-empty pages' text in page order, joined by one space."""
    own = pages.filter("text <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "text"))).alias("p"))
    return own.select("doc_id", F.array_join(F.col("p.text"), " ").alias("text"))


def bound(parts: DataFrame) -> DataFrame:
    """doc_id, pages (array of page_num and text, in page order): a document's non-empty pages in one row, from rows that hold
    some of them each. Rows are dealt by doc_id, so that what is grouped, ordered or joined by it later does not move a text again."""
    own = parts.groupBy("doc_id").agg(F.collect_list("pages").alias("p"))
    return own.filter(F.exists("p", lambda x: F.size(x) > 0)).select("doc_id", F.sort_array(F.flatten("p")).alias("pages"))


def joined_pages(documents: DataFrame) -> DataFrame:
    """As `concat_pages`, of bound pages."""
    return documents.select("doc_id", F.array_join(F.col("pages.text"), " ").alias("text"))


def unbound(documents: DataFrame) -> DataFrame:
    """doc_id, page_num, text of bound pages, of which a document has some (so that no filter has to build them to see that)."""
    return documents.select("doc_id", F.explode_outer("pages").alias("p")).select("doc_id", "p.page_num", "p.text")


def page_spans(pages: DataFrame) -> DataFrame:
    """start and end of each non-empty page in its document's joined text."""
    order = Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("text").cast("long")
    start = F.sum(size + 1).over(order) - (size + 1)
    return pages.filter("text <> ''").select("doc_id", "page_num", "text", start.alias("start")).withColumn("end", F.col("start") + F.length("text"))


def first_of_each(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_id, text_digest of the first chunk of each text in corpus order; an option, pages' chunks aren't deduplicated else."""
    own = chunks.select(F.sha2("text", 256).alias("text_digest"), F.struct("doc_id", "chunk_id").alias("at"))
    return own.groupBy("text_digest").agg(F.min("at").alias("at")).select("at.doc_id", "at.chunk_id", "text_digest")


def single_spaced_words(text: Column) -> Column:
    """Number of words, as a long, of a text whose words are parted by single spaces; 0 if it is empty."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def _cut_texts(texts: DataFrame, cut, names: tuple[str, ...], text: bool = True) -> DataFrame:
    """doc_id, chunk_id, the columns `names` (numbers) and, if asked for, text: cut(text) yields a chunk's numbers and text, in one
    pass of a text."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), *[pa.int64() for _ in names], *[pa.string()] * text]
    columns = ["doc_id", "chunk_id", *names, *["text"] * text]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=columns)

    def run(batches):
        for batch in batches:
            rows, held = [], 0  # short texts' chunks leave together
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                rows += [(doc, k, *chunk) for k, chunk in enumerate(cut(text))]
                held += len(text)
                if held > CUT_CHARACTERS:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return texts.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(columns, kinds)))


def _token_windows(text: str, size: int, overlap: int):
    """start, end and words of each window; the spaces of a text are found together."""
    import numpy as np

    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
    n = len(spaces) + 1
    for first in range(0, max(1, n - overlap), size - overlap):
        stop = min(n, first + size)
        yield int(spaces[first - 1]) + 1 if first else 0, int(spaces[stop - 1]) if stop < n else len(text), stop - first


def token_chunks(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk_id, start_index, n_tokens, text: windows over the words of texts normalized to single spaces. A text's words
    are found once, and chunks are slices of it, so time follows the text and its chunks."""
    return _cut_texts(texts, lambda text: ((start, n, text[start:end]) for start, end, n in _token_windows(text, size, overlap)), ("start_index", "n_tokens"))


def token_spans(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk_id, start_index, end_index of `token_chunks`, without their texts."""
    return _cut_texts(texts, lambda text: (w[:2] for w in _token_windows(text, size, overlap)), ("start_index", "end_index"), text=False)


def _once(load):
    """What load() gives, loaded when it is first called."""
    held = []

    def call(texts):
        if not held:
            held.append(load())
        return held[0](texts)

    return call


def _subword_cut(encode, size: int, overlap: int):
    """A function from a text to start, tokens and text of its chunks, as `subword_chunks` says."""
    from bisect import bisect_right
    from itertools import accumulate

    alone, behind = {}, {}

    def learn(words):
        n = list(map(len, encode(["a", *words, *["a " + w for w in words]])))
        alone.update(zip(words, n[1:]))
        behind.update((w, both - n[0]) for w, both in zip(words, n[len(words) + 1 :]))

    def cut(text):
        words = text.split(" ")
        if len(alone) > KNOWN_WORDS:
            alone.clear()
            behind.clear()
        if new := set(words).difference(alone):
            learn(list(new))
        before = [0, *accumulate(map(behind.__getitem__, words))]
        sizes = [0, *accumulate(map(len, words))]
        tokens = lambda first, stop: alone[words[first]] + before[stop] - before[first + 1]
        first, stop = 0, 0
        while stop < len(words):
            stop = max(stop, first + 1)
            stop = max(stop, bisect_right(before, size - alone[words[first]] + before[first + 1], stop) - 1)
            start = sizes[first] + first  # there is a space before each word but the first
            yield start, tokens(first, stop), text[start : sizes[stop] + stop - 1]
            back = stop
            while stop < len(words) and back - 1 > first and tokens(back - 1, stop) <= overlap and tokens(back - 1, stop + 1) <= size:
                back -= 1
            first = back

    return cut


def subword_chunks(texts: DataFrame, load, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk_id, start_index, n_tokens, text: whole words of texts normalized to single spaces, packed greedily into at most
    `size` tokens of a model's tokenizer (more only where a word alone has more); a chunk starts with the last words of the one
    before, of at most `overlap` tokens.

    load() gives, on an executor, a function from texts to encodings (ids or offsets) as long as they have tokens, of a tokenizer
    that has no token across words and takes a space with the word behind it, whatever stands before. So a task encodes a word once
    for all its texts (while it remembers it): alone, as the first word of a chunk is, and behind another word."""
    return _cut_texts(texts, _subword_cut(_once(load), size, overlap), ("start_index", "n_tokens"))


def subword_audit(texts: DataFrame, load, size: int, overlap: int) -> DataFrame:
    """doc_id, words, whole, fitting, overlapping of each non-empty text: how many words its `subword_chunks` reach; whether every
    chunk stands at its start and has as many tokens as its text, encoded anew and as a whole; whether they fit, or are one word;
    whether the first begins with the text and each other behind the beginning of the one before, but not behind its end.
    Texts are held against their chunks in the task that cuts them, about a million characters together."""
    import pyarrow as pa

    encode = _once(load)
    cut = _subword_cut(encode, size, overlap)

    def facts(text, chunks, counted):
        whole = fitting = overlapping = True
        here, before, first, stop = 0, -1, 0, 0
        for start, n, part in chunks:
            first = first + text.count(" ", here, start) if start >= here else text.count(" ", 0, start)
            own, words = next(counted), part.count(" ") + 1
            whole = whole and own == n and text.startswith(part, start)
            fitting = fitting and (own <= size or words == 1)
            overlapping = overlapping and before < first <= stop
            here, before, stop = start, first, first + words
        return stop, whole, fitting, overlapping

    def made(docs, own, chunks):
        counted = map(len, encode([part for parts in chunks for _, _, part in parts]))
        columns = [docs, *zip(*(facts(text, parts, counted) for text, parts in zip(own, chunks)))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.bool_()] * 3)], names=["doc_id", "words", "whole", "fitting", "overlapping"])

    def run(batches):
        for batch in batches:
            docs, own, chunks, held = [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not (text := text.as_py()):
                    continue
                docs.append(doc)
                own.append(text)
                chunks.append(list(cut(text)))
                held += len(text)
                if held > CUT_CHARACTERS:
                    yield made(docs, own, chunks)
                    docs, own, chunks, held = [], [], [], 0
            if docs:
                yield made(docs, own, chunks)

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, words long, whole boolean, fitting boolean, overlapping boolean")


def character_chunks(texts: DataFrame, size: int = 2500, overlap: int = 100) -> DataFrame:
    """doc_id, chunk_id, start_index, text: greedy packing of whole words into at most `size` characters, each chunk
    starting with the last words of the one before, of at most `overlap` characters. One text at a time, in order."""

    def cut(text):
        words, at = [], 0
        for w in text.split(" "):
            words.append((at, at + len(w)))
            at += len(w) + 1
        first = 0
        while first < len(words):
            stop = first + 1
            while stop < len(words) and words[stop][1] - words[first][0] <= size:
                stop += 1
            yield words[first][0], text[words[first][0] : words[stop - 1][1]]
            if stop == len(words):
                return
            back = stop
            while back - 1 > first and words[stop - 1][1] - words[back - 1][0] <= overlap and words[stop][1] - words[back - 1][0] <= size:
                back -= 1
            first = back

    return _cut_texts(texts, cut, ("start_index",))


@F.pandas_udf(ArrayType(IntegerType()))
def _anchored(texts: pd.Series, chunks: pd.Series) -> pd.Series:
    def starts(text, parts):
        at, found = -1, []
        for part in parts:
            here = text.find(part, at + 1)
            if here < 0:
                here = text.find(part, 0, at + len(part))  # nothing was found behind
            at = here if here >= 0 else at
            found.append(here)
        return found

    return pd.Series([None if t is None or c is None else starts(t, c) for t, c in zip(texts, chunks)])


def reanchor(text: Column, chunks: Column) -> Column:
    """Where each chunk (array<string>, in order) starts: found after the start before it, else at its first occurrence, else -1.
    A text is searched onwards, so that time follows its length where chunks are in order."""
    return _anchored(text, chunks)


@F.pandas_udf(ArrayType(LongType()))
def _words_before(texts: pd.Series, starts: pd.Series) -> pd.Series:
    def counts(text, at):
        found, n, here = [], 0, 0
        for start in at:
            n = n + text.count(" ", here, start) if start >= here else text.count(" ", 0, start)
            here = start
            found.append(n)
        return found

    return pd.Series([None if t is None or s is None else counts(t, s) for t, s in zip(texts, starts)])


def words_before(text: Column, starts: Column) -> Column:
    """How many spaces stand before each start (array); in one pass of the text where starts rise."""
    return _words_before(text, starts)


@F.pandas_udf(BooleanType())
def _stand(texts: pd.Series, starts: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or s is None or p is None else all(t.startswith(part, at) for at, part in zip(s, p)) for t, s, p in zip(texts, starts, parts)], dtype="object")


def stand(text: Column, starts: Column, parts: Column) -> Column:
    """Whether each part (array) stands in the text at its start (array)."""
    return _stand(text, starts, parts)


def nearest_rank(values: Column, p: float) -> Column:
    """sorted[round_half_even((n - 1) p)] of a sorted array; 0 if it is empty."""
    return F.coalesce(F.get(values, F.bround((F.size(values) - 1) * F.lit(p)).cast("int")), F.lit(0)).cast("long")


def middle(values: Column) -> Column:
    n = F.size(values)
    a, b = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
    return F.coalesce((a + b) / 2.0, F.lit(0.0))


def _sorted_lengths(chunks: DataFrame, name: str) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("n_tokens") + SPECIAL)).alias(name))


def chunk_audit(pages: DataFrame, chunks: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row per document: extracted tokens, length figures of its chunks and of the baseline's, flags. chunks, baseline: doc_id, n_tokens (of words)."""
    n_words = single_spaced_words(F.col("text"))
    own = pages.select("doc_id", F.when(n_words > 0, n_words + SPECIAL).otherwise(0).alias("n"))
    own = own.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.col("n") == 0).alias("empty_pages"), F.sum("n").alias("extracted_tokens"))
    rows = own.join(_sorted_lengths(chunks, "v"), "doc_id", "left").join(_sorted_lengths(baseline, "b"), "doc_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.expr("cast(array() as array<bigint>)")) for c in ("v", "b")})
    most = F.coalesce(F.get("b", F.size("b") - 1), F.lit(0))
    small, large = F.size(F.filter("v", lambda x: x < 32)), F.size(F.filter("v", lambda x: x > 512))
    n = F.size("v")
    rules = [
        (F.col("empty_pages") == F.col("pages"), "no_extracted_text"),
        ((F.col("empty_pages") > 0) & (F.col("empty_pages") < F.col("pages")), "empty_pages"),
        (F.col("extracted_tokens") < 128, "very_short_document"),
        (most > 512, "baseline_over_embedding_limit"),
        (large > 0, "chunks_over_embedding_limit"),
        ((n > 0) & (small >= n * 0.2), "many_tiny_chunks"),
        ((n >= 10) & (nearest_rank(F.col("v"), 0.1) < 64), "short_chunk_tail"),
    ]
    return rows.select(
        "doc_id", "pages", "empty_pages", "extracted_tokens",
        F.size("b").cast("long").alias("baseline_segments"), middle(F.col("b")).alias("baseline_median"), nearest_rank(F.col("b"), 0.9).alias("baseline_p90"), most.alias("baseline_max"),
        n.cast("long").alias("chunks"), middle(F.col("v")).alias("chunk_median"),
        nearest_rank(F.col("v"), 0.1).alias("chunk_p10"), nearest_rank(F.col("v"), 0.9).alias("chunk_p90"),
        F.coalesce(F.get("v", F.lit(0)), F.lit(0)).alias("chunk_min"), F.coalesce(F.get("v", n - 1), F.lit(0)).alias("chunk_max"),
        small.cast("long").alias("chunks_lt_32"), large.cast("long").alias("chunks_gt_512"),
        F.concat_ws(";", *[F.when(test, name) for test, name in rules]).alias("flags"),
    )


def worst(audit: DataFrame, n: int = 12) -> DataFrame:
    """The flagged documents that need a look first."""
    flagged = audit.filter("flags <> ''")
    return flagged.orderBy(F.contains("flags", F.lit("no_extracted_text")).desc(), F.col("chunks_gt_512").desc(), F.col("baseline_max").desc(), F.col("chunks_lt_32").desc(), "doc_id").limit(n)


def histogram(values: DataFrame, column: str, least: int = 5, most: int = 30) -> DataFrame:
    """bin, lo, hi, n: equal bins from the least to the largest value, as many as the root of their number; the last is closed."""
    facts = values.agg(F.count(column).alias("n"), F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    if not facts["n"]:
        return values.sparkSession.createDataFrame([], "bin long, n long")
    bins = min(most, max(least, int(-(-(facts["n"] ** 0.5) // 1))))
    width = (facts["hi"] - facts["lo"]) / bins
    at = F.least(F.floor((F.col(column) - facts["lo"]) / width), F.lit(bins - 1)) if width else F.lit(0).cast("long")
    return values.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def size_bands(files: DataFrame, order: Column, save, bands: int = 10) -> DataFrame:
    """rn and band (deciles of the files by size, then name): band b holds rows [b N // 10, (b + 1) N // 10)."""
    ranked = row_numbers(files, "size", order, save=save)
    return ranked.withColumn("band", (F.ceil(bands * F.col("rn") / F.col("total")) - 1).cast("long"))


def stratified_sample(banded: DataFrame, n: int, draw: Column, bands: int = 10) -> DataFrame:
    """n // bands files of each band (the first n % bands one more) by the order of `draw`; the smallest and the largest always if n >= bands."""
    share = F.lit(n // bands) + (F.col("band") < n % bands).cast("int")
    ends = (F.col("rn") == 1) | (F.col("rn") == F.col("total")) if n >= bands else F.lit(False)
    by = Window.partitionBy("band").orderBy(ends.desc(), draw)
    return banded.withColumn("turn", F.row_number().over(by)).filter(F.col("turn") <= share)
