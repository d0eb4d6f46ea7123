"""Near-duplicates by the similarity of word shingles: sets of hashed shingles, MinHash bands, confirmed links.

A text's set holds the hashes of its runs of `shingle` words (a shorter text is one shingle). Equal sets are one node. Sets
that agree in one of 20 bands of 5 minima are candidates: at similarity s a pair is met with 1 - (1 - s^5)^20, 99.96 % at
0.8. A link is a candidate pair whose Jaccard similarity, of whole sets of 32-bit hashes, reaches the limit.

Candidates of a bucket. Copies of one text may share a bucket by the thousand and still be unlike one another, so pairs are
not emitted. First, what is found cheaply is joined into classes: a round deals each bucket into slices of bounded size, sorts
them by the nodes' keys in two other bands, which puts the likest side by side, and compares each node with the two before it.
Then every candidate pair of different classes is decided: in each bucket of several classes the nodes outside its largest
class are asked of all its nodes, in blocks of bounded rows and bytes, and a block gives links that join classes only. So no
candidate's link is lost, and buckets that are of one class by then, as groups of like copies are, cost nothing more. Buckets
of the same nodes are decided once. A bucket of n nodes, o of them outside the largest class, moves n * o / 1024 rows beyond
its own: many different copies that are not like one another are dear, not left out.

Defined results: a null or blank text has the empty set (0), which is like itself only; texts of any length are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.common import blocks, materialise, release, told_apart

SEED, BANDS, ROWS, BEFORE = 42, 20, 5, 2
#: The bands, counted from the bucket's own, that sort a bucket in each round.
ROUNDS = ((1, 2), (3, 5))
#: Nodes of a round's slice; nodes asked and nodes of a block, and bytes of the sets of either.
SLICE, ASKED, BLOCK, BLOCK_BYTES = 4096, 1024, 2048, 4 << 20


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The different hashes of a text's word shingles, rising."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()  # as in simhash
    if len(w) < shingle:
        own = [xxh64_intdigest(b" ".join(w), SEED)] if w else []
    else:
        own = [xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(w[i:] for i in range(shingle)))]
    return np.unique(np.array(own, np.uint64))


def bands(own: np.ndarray) -> list[int]:
    """A key for each band of minima."""
    from xxhash import xxh64_intdigest

    if not len(own):
        return []
    rnd = np.random.default_rng(SEED)
    by = rnd.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rnd.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(own), 4096):  # bounds the memory
        least = np.minimum(least, (own[at : at + 4096, None] * by + plus).min(axis=0))
    return [xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))]


def sketches(docs: DataFrame, text: str, keep: tuple, shingle: int, whole: bool = True, sign=None) -> DataFrame:
    """The columns `keep` with fp, the digest of the set as a signed long, if `whole` the set and its bands, and if `sign` is given
    (texts to unsigned numbers) its number as a signed long, `sim`."""
    more = [T.StructField("own", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))] if whole else []
    more += [T.StructField("sim", T.LongType())] if sign else []
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType()), *more])

    def run(batches):
        from xxhash import xxh64_intdigest

        for part in blocks(batches, text):
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            own = [shingle_set(t, shingle) for t in texts]
            fp = np.array([xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in own], np.uint64).view(np.int64)
            made = [pa.array(fp)]
            if whole:
                keys = [np.array(bands(s), np.uint64).view(np.int64) for s in own]
                small = [np.unique(s.astype(np.uint32)).tobytes() for s in own]
                made += [pa.array(small, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            if sign:
                made.append(pa.array(sign(texts).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + made, names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (fp, own) are as similar as asked."""
    a, b = (sets.select(F.col("fp").alias(c), F.col("own").alias(f"own_{c}")) for c in "ab")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both / (len(x) + len(y) - both) >= similarity)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "own_a", "own_b").mapInArrow(run, "a long, b long")


def joining(asked: list, nodes: list, similarity: float) -> list[tuple[int, int]]:
    """Links (fp, fp) of asked nodes with nodes, each (fp, class, set), that join what links between them join."""
    fps = [x[0] for x in asked + nodes]
    label = np.unique(np.array([x[1] for x in asked + nodes], np.int64), return_inverse=True)[1]
    sizes = np.array([len(x[2]) for x in nodes], np.int64)
    word, at = np.unique(np.concatenate([x[2] for x in nodes]), return_inverse=True)
    holders = np.repeat(np.arange(len(nodes)), sizes)[np.argsort(at, kind="stable")]  # by hash: the nodes that hold it
    ends = np.cumsum(np.bincount(at, minlength=len(word)))
    out = []
    for i, (fp, _, own) in enumerate(asked):
        hit = np.searchsorted(word, own)
        hit = hit[(hit < len(word)) & (word[np.minimum(hit, len(word) - 1)] == own)]
        both = np.zeros(len(nodes), np.int64)
        for part in np.array_split(hit, len(hit) // 1024 + 1):  # bounds the memory
            first = np.where(part > 0, ends[part - 1], 0)
            many = ends[part] - first
            where = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
            both += np.bincount(holders[where], minlength=len(nodes))
        like = len(asked) + np.flatnonzero(both / (len(own) + sizes - both) >= similarity)
        for other, j in zip(*np.unique(label[like], return_index=True)):
            if other != label[i]:
                out.append((fp, fps[like[j]]))
                label[label == other] = label[i]
    return out


def remaining(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the classes of members (key, fp, class) of a bucket as all links within it do."""
    spark = members.sparkSession
    same = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.sum(F.xxhash64("fp", F.lit(1)).cast("decimal(38,0)")).alias("y"))
    members = members.select("key", "fp", "class").join(same.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key").join(sets.select("fp", "bytes"), "fp")
    classes = members.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    of_key = classes.groupBy("key").agg(F.max(F.struct("n", "bytes", "class")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    parts = lambda n, rows, size: F.greatest(F.ceil(n / F.lit(rows)), F.ceil(size / F.lit(BLOCK_BYTES)), F.lit(1))
    of_key = of_key.select(
        "key", F.col("top.class").alias("top"), parts(F.col("n"), BLOCK, F.col("bytes")).alias("blocks"),
        parts(F.col("n") - F.col("top.n"), ASKED, F.col("bytes") - F.col("top.bytes")).alias("turns"),
    )
    rows = members.join(of_key, "key").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks")).withColumn("turn", F.pmod(F.xxhash64("fp", F.lit(2)), "turns"))
    nodes = rows.select("key", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("asked"), "fp", "class")
    asked = rows.filter("class <> top").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "turn", F.lit(True).alias("asked"), "fp", "class")
    units = nodes.unionByName(asked).join(sets.select("fp", "own"), "fp").select("key", "block", "turn", "asked", "fp", "class", "own")
    units = units.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "block", "turn").sortWithinPartitions("key", "block", "turn")

    def run(batches):
        def decided():
            found = joining(*unit, similarity) if all(unit) else []
            return [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])] if found else []

        held, unit = None, ([], [])  # nodes asked, nodes
        for batch in batches:
            for key, block, turn, asks, fp, group, own in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, block, turn) != held:
                    yield from decided()
                    held, unit = (key, block, turn), ([], [])
                unit[0 if asks else 1].append((fp, group, np.frombuffer(own, np.uint32)))
        yield from decided()
        release()

    return units.mapInArrow(run, "a long, b long")


def links(prints: DataFrame, distinct: DataFrame, similarity: float, rows_of, components, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between nodes, whose classes are those of the links of all candidates and of the `known` links, if any.

    distinct: fp, least, bands; rows_of(prints, fps): the rows of prints with these fp, perhaps more; components(edges): (node, root).
    """
    keyed = distinct.select("fp", "bands", F.posexplode("bands").alias("band", "key"))
    near = [F.get("bands", F.pmod(F.col("band") + k, F.lit(BANDS))).alias(f"near{k}") for k in sorted({k for r in ROUNDS for k in r})]
    keyed = keyed.select("key", "fp", *near)
    again = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    shared = told_apart(keyed, "key", again.select(F.col("key").alias("__gone")))[1]
    members = materialise(shared.join(again, "key").withColumn("class", F.col("fp")), "members")
    met = members.select("fp").distinct()
    sets = materialise(rows_of(prints, met).groupBy("fp").agg(F.first("own").alias("own")).join(met, "fp").withColumn("bytes", F.length("own")), "sets")
    found = known
    for turn, order in enumerate(ROUNDS):
        piece = F.pmod(F.xxhash64("fp", F.lit(turn)), F.ceil(F.col("n") / F.lit(SLICE)))
        by = Window.partitionBy("key", piece).orderBy(*[f"near{k}" for k in order], "fp")
        pairs = members.withColumn("others", F.array(*[F.lag(F.struct(F.col("fp").alias("other"), F.col("class").alias("led")), k + 1).over(by) for k in range(BEFORE)]))
        pairs = pairs.select("fp", "class", F.inline("others")).filter("led <> class")
        good = confirmed(pairs.select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")).distinct(), sets, similarity)
        found = materialise(good if found is None else found.unionByName(good), "links")
        # The classes so far, as links of nodes to their roots, are all that the next round and the caller need.
        roots = materialise(components(found), "roots")
        found = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        # Buckets of up to three nodes are a slice whose pairs are all compared.
        members = members.filter(F.col("n") > BEFORE + 1).drop("class").join(roots, F.col("fp") == F.col("node"), "left")
        members = members.withColumn("class", F.coalesce("root", "fp")).drop("node", "root")
        several = members.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("key")
        members = materialise(members.join(several, "key"), "several")
    return found.unionByName(materialise(remaining(members, sets, similarity), "remaining"))
