"""Toxicity by a classifier chain: categories one after another, each linear model given the earlier probabilities.

Categories are label columns in chain order: first whether a document is of good quality, then whether it is toxic.

Features are hashed lower-case words and the beginnings of longer words (stems tell more of languages that compound),
1 + ln count, of unit length. Training, on the driver, uses a bounded sample: of toxic and of other documents at most
`SAMPLE_PER_CLASS` each, those with the least hashes of their doc_id, each with its `SAMPLE_FEATURES` strongest features.
A category's model is fitted to the features and to the earlier categories' out-of-fold probabilities (each sample row is
scored by models fitted without its fold); when scoring, models fitted to all sample rows pass theirs on. Out-of-fold
probabilities of the last category also place its cut, where recall less `COST` times the flagged share of the others is
greatest; the last model's intercept is shifted so that the cut is a probability of one half.

Defined results: a null or blank text has no features and gets the intercepts' probabilities; texts of any length are
scored whole; a label that is null isn't fitted, a row without the last label or without a document is ignored;
conflicting labels of a document count as given; without both kinds of the last label nothing is toxic; repeated rows
score alike; an empty table gives an empty result; other columns, whatever their names, are only passed on.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import blocks, materialise

CATEGORIES = ("quality", "toxic")
SAMPLE_PER_CLASS, SAMPLE_FEATURES, FOLDS, BITS = 2000, 4096, 3, 18
#: Lengths in bytes of the word beginnings that are features, too.
BEGINNINGS = (4, 6)
#: How many times worse a clean document flagged is than a toxic one missed, as shares.
COST = 20.0
#: Features seen in fewer sample documents are no evidence.
LEAST_DOCS = 4

#: Bytes that part words: all ASCII but letters and digits; upper case becomes lower.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def word_slot(word: bytes) -> int:
    return zlib.crc32(word) & ((1 << BITS) - 1)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: row number, slot and value of each feature, by row."""
    words = [(t or "").encode().translate(_PARTS).split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    if not counts.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    codes = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
    distinct, n = codes.dictionary.to_pylist(), len(codes.dictionary)
    key, times = np.unique(np.repeat(np.arange(len(texts)) * n, counts) + codes.indices.to_numpy(), return_counts=True)
    row, word = key // n, key % n
    parts, weights = [], []
    for size in (None, *BEGINNINGS):
        slot = np.array([word_slot(w if size is None else b"^" + w[:size]) if size is None or len(w) > size else -1 for w in distinct], np.int64)[word]
        parts.append(((row << BITS) + slot)[slot >= 0])
        weights.append(times[slot >= 0])
    key, place = np.unique(np.concatenate(parts), return_inverse=True)
    row, value = key >> BITS, 1 + np.log(np.bincount(place, np.concatenate(weights)))
    norm = np.sqrt(np.bincount(row, value * value, len(texts)))
    return row, key & ((1 << BITS) - 1), value / norm[row]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class LinearModel:
    """Logistic regression on sparse words and a few dense columns; classes weigh alike.

    Words are scaled by their naive-Bayes log-count ratios, so that words alike in both classes hardly count, and fitted
    by accelerated gradient descent whose step is that of the largest curvature.
    """

    def __init__(self, dense: int):
        self.words, self.dense, self.bias = np.zeros(1 << BITS), np.zeros(dense), 0.0

    def scores(self, row, slot, value, dense) -> np.ndarray:
        return np.bincount(row, value * self.words[slot], len(dense)) + dense @ self.dense + self.bias

    def fit(self, row, slot, value, dense, y, use, rounds: int = 80, decay: float = 1e-3):
        """use: weights of the rows (0: not in the fold)."""
        n, weight = len(y), use * np.where(y, 0.5 / max(1, (use * y).sum()), 0.5 / max(1, (use * ~y).sum()))
        used = use[row] > 0
        row, slot, value = row[used], slot[used], value[used]
        seen, place = np.unique(slot, return_inverse=True)
        keep = (np.bincount(place, minlength=len(seen)) >= LEAST_DOCS)[place]
        row, place, value = row[keep], place[keep], value[keep]
        has = np.bincount(place, y[row], len(seen)), np.bincount(place, ~y[row], len(seen))
        ratio = np.log((has[0] + 1) / ((use * y).sum() + 2)) - np.log((has[1] + 1) / ((use * ~y).sum() + 2))
        value = value * ratio[place]
        extra = np.c_[dense, np.ones(n)]
        m, k = len(seen), extra.shape[1]
        by = np.argsort(place, kind="stable")
        by_place, by_row, by_value = place[by], row[by], value[by]
        heads, tops = (np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64) for x in (row, by_place))

        def sums(x, at, into, size):
            out = np.zeros(size)
            if len(at):
                out[into[at]] = np.add.reduceat(x, at)
            return out

        def forward(v):
            return sums(value * v[:m][place], heads, row, n) + extra @ v[m:]

        def back(e):
            return np.r_[sums(by_value * e[by_row], tops, by_place, m), extra.T @ e]

        v, top = np.ones(m + k), 1.0
        for _ in range(8):
            v = back(weight * forward(v / np.linalg.norm(v)))
            top = np.linalg.norm(v)
        step, w, z = 1 / (0.3 * top + decay), np.zeros(m + k), np.zeros(m + k)
        for t in range(rounds):
            g = back(weight * (_sigmoid(forward(z)) - y)) + decay * z * (np.arange(m + k) < m)
            w, old = z - step * g, w
            z = w + t / (t + 3) * (w - old)
        self.words[seen] = w[:m] * ratio
        self.dense, self.bias = w[m:-1], w[-1]
        return self


class Chain:
    """Models of the categories in order."""

    def __init__(self, models: list[LinearModel], names=CATEGORIES):
        self.models, self.names = models, names

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        row, slot, value = features(texts)
        p = np.zeros((len(texts), 0))
        for m in self.models:
            p = np.c_[p, _sigmoid(m.scores(row, slot, value, p))]
        return p


def best_cut(scores: np.ndarray, y: np.ndarray, cost: float = COST) -> float:
    """The middle of the gap between two scores where recall less cost times the flagged share of the others is greatest."""
    by = np.argsort(-scores, kind="stable")
    at, hit = scores[by], y[by]
    gain = np.r_[0.0, np.cumsum(hit / max(1, y.sum()) - cost * ~hit / max(1, (~y).sum()))]
    edge = np.r_[at[0] + 1, at, at[-1] - 1]  # cut k lies between edges k and k + 1: the first k scores are over it
    gap = edge[:-1] - edge[1:]
    free = np.flatnonzero(gap > 0)
    best = free[gain[free] >= gain[free].max() - 1e-12]
    k = best[np.argmax(gap[best])]
    return float((edge[k] + edge[k + 1]) / 2)


def fit_chain(row, slot, value, labels: np.ndarray, fold: np.ndarray, names=CATEGORIES) -> Chain:
    """labels: rows x categories in chain order, 0, 1 or nan where unknown. fold: each row's fold number."""
    held = np.zeros((len(labels), 0))
    models, scores = [], None
    for k in range(labels.shape[1]):
        known, y = ~np.isnan(labels[:, k]), labels[:, k] > 0
        models.append(LinearModel(k).fit(row, slot, value, held, y, known.astype(float)))
        scores = np.zeros(len(y))
        for f in range(FOLDS):
            own = LinearModel(k).fit(row, slot, value, held, y, (known & (fold != f)).astype(float))
            scores = np.where(fold == f, own.scores(row, slot, value, held), scores)
        held = np.c_[held, _sigmoid(scores)]
    known = ~np.isnan(labels[:, -1])
    models[-1].bias -= best_cut(scores[known], labels[known, -1] > 0)
    return Chain(models, names)


def training_rows(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", names=CATEGORIES, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The sample: doc_id, the labels y0, y1 ... and the features (slot, value arrays) of its documents."""
    known = [F.when(F.col(n).isNotNull(), (F.col(n) > 0).cast("double")).alias(f"y{k}") for k, n in enumerate(names)]
    ys, last = [f"y{k}" for k in range(len(names))], f"y{len(names) - 1}"
    named = labels.select(F.col(doc_id).alias("id"), *known).filter(f"id is not null and {last} is not null").distinct()
    named = named.join(docs.select(F.col(doc_id).alias("id")).distinct(), "id", "left_semi").withColumn("turn", F.xxhash64("id"))
    named = materialise(named, "labelled")
    picked = None
    for y, n in named.groupBy(last).count().collect():  # two rows
        # Of uniform hashes the lower 2 * per_class / n hold twice the sample; so no task sends more than its part of that.
        some = named.filter(F.col(last) == y)
        some = some.filter(F.col("turn") < int(-(2**63) + 2**64 * 2 * per_class / n)) if n > 4 * per_class else some
        some = some.orderBy("turn", "id", *ys).limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        picked = named
    # At most 2 * per_class small rows: a proven bound for the broadcast.
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked.drop("turn")), "id")
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType)] + [T.StructField(y, T.DoubleType()) for y in ys])
    schema = schema.add("slot", T.ArrayType(T.IntegerType())).add("value", T.ArrayType(T.FloatType()))

    def run(batches):
        for part in blocks(batches, "text"):
            row, slot, value = features(part.column(1).to_pylist())
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            strongest = [a + np.sort(np.argsort(-value[a:b], kind="stable")[:SAMPLE_FEATURES]) for a, b in zip(cuts, cuts[1:])]
            lists = [[x[s] for s in strongest] for x in (slot.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(lists[0], pa.list_(pa.int32())), pa.array(lists[1], pa.list_(pa.float32()))], names=schema.names)

    return texts.select("id", "text", *ys).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, names=CATEGORIES, **options) -> Chain | None:
    """The chain of the label columns `names`; None without labelled documents of both kinds of the last."""
    ys = [f"y{k}" for k in range(len(names))]
    sample = training_rows(docs, labels, names=names, **options).toArrow()
    sample = sample.sort_by([("id", "ascending"), *((y, "ascending") for y in reversed(ys))])
    y = np.array([sample[c].to_numpy() for c in ys], float).T
    if not len(y) or (y[:, -1] > 0).all() or not (y[:, -1] > 0).any():
        return None
    size = np.diff(sample["slot"].combine_chunks().offsets.to_numpy())
    slot = sample["slot"].combine_chunks().flatten().to_numpy().astype(np.int64)
    value = sample["value"].combine_chunks().flatten().to_numpy().astype(float)
    fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in sample["id"].to_pylist()])
    return fit_chain(np.repeat(np.arange(len(size)), size), slot, value, y, fold, names)


def score(docs: DataFrame, chain: Chain | None, text="text", keep=("doc_id",), names=CATEGORIES) -> DataFrame:
    """The columns `keep` with a probability p_... for each category and is_toxic: that of the last is at least one half."""
    made = [f"p_{c}" for c in names]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in made] + [T.StructField("is_toxic", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for part in blocks(batches, text):
            at = part.schema.get_field_index
            texts = part.column(at(text)).to_pylist()
            p = shared.value.probabilities(texts) if shared.value else np.zeros((len(texts), len(made)))
            yield pa.RecordBatch.from_arrays([part.column(at(c)) for c in keep] + [pa.array(p[:, k]) for k in range(len(made))] + [pa.array(p[:, -1] >= 0.5)], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def accepted(docs: DataFrame, chain: Chain | None, text="text") -> DataFrame:
    """The rows that aren't toxic, with all their columns."""
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for part in blocks(batches, text):
            p = shared.value.probabilities(part.column(at).to_pylist())[:, -1] if shared.value else np.zeros(part.num_rows)
            yield part.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)
