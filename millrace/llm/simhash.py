"""SimHash near-duplicates: fingerprints, links at few differing bits found with BK-trees, connected components.

Links. Different fingerprints that differ in at most 2 of 64 bits agree in at least 2 of 4 blocks of 16 bits, so each of
the 6 pairs of blocks (32 bits) names a shard and linked fingerprints share a shard. A shard of over `shard_limit`
fingerprints is split the same way by the other 32 bits (4 blocks of 8), which leaves 16 free bits: at most 65,536
different fingerprints. A shard's BK-tree (children keyed by their distance to the parent) is built in one task and asked
by the shard's own fingerprints, following only edges within the radius; a search within a shard yields links that span
what it links, so that no more than a shard's size of them leave it.

Components. Large-star and small-star rounds over the links, each written to the shared folder, until nothing changes.

Defined results: a null or blank text has fingerprint 0; equal fingerprints link; repeated rows share a component; null
doc_ids never name a component unless it has no other; an empty table gives an empty result; texts of any length are taken
whole, a block of its own each if long; other columns, whatever their names, travel inside a struct and come back as they were.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import shingles
from millrace.llm.common import blocks, discarding, materialise, told_apart

RADIUS, SHINGLE, SEED, SHARD_LIMIT = 2, 3, 42, 512


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """SimHash of each text's word shingles as unsigned 64-bit integers."""
    from xxhash import xxh64_intdigest

    hashes, counts = [], []
    for t in texts:
        w = (t or "").encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D split
        if len(w) < SHINGLE:
            own = [xxh64_intdigest(b" ".join(w), SEED)] if w else []
        else:
            own = [xxh64_intdigest(b" ".join(x), SEED) for x in zip(w, w[1:], w[2:])]
        hashes += own
        counts.append(len(own))
    n, out = np.array(counts, np.int64), np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    h = np.array(hashes, np.uint64)
    starts = (np.cumsum(n) - n)[some]
    for at in range(0, 64, 8):  # a byte at a time bounds the memory
        byte = ((h >> np.uint64(at)) & np.uint64(255)).astype(np.uint8)
        bits = np.unpackbits(byte[:, None], axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        most = (2 * ones > n[some][:, None]).astype(np.uint8)
        out[some] |= np.packbits(most, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(at)
    return out


def fingerprint(docs: DataFrame, text="text", keep=("doc_id",)) -> DataFrame:
    """The columns `keep` with fp, the fingerprint as a signed long."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])

    def run(batches):
        for part in blocks(batches, text):
            found = fingerprints(part.column(part.schema.get_field_index(text)).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + [pa.array(found)], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


class BKTree:
    """Integers under Hamming distance; a node is [value, children by distance]."""

    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            own, children = stack.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                found.append(own)
            for k, child in children.items():
                if d - radius <= k <= d + radius:
                    stack.append(child)
        return found


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (value, least value of its class) that join what is linked within the radius among some different values."""
    tree, parent = BKTree(), {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for v in values:
        parent[v] = v
        for u in tree.within(v, radius):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, root(v)) for v in values if root(v) != v]


def _shards(column, width: int, shift: int):
    """The 6 shard keys of 4 blocks of `width` bits from bit `shift` up: pair number, then both blocks."""
    mask = (1 << width) - 1
    block = [F.shiftrightunsigned(column, shift + width * i).bitwiseAND(F.lit(mask)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return [F.lit(k).cast("long") * F.lit(1 << (2 * width)) + block[i] * F.lit(1 << width) + block[j] for k, (i, j) in enumerate(pairs)]


def _rest(fp, pair):
    """The 32 bits outside a pair of 16-bit blocks, as a long."""
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(65535)) for i in range(4)]
    out = F.lit(0).cast("long")
    for k, (i, j) in enumerate((i, j) for i in range(4) for j in range(i + 1, 4)):
        a, b = (x for x in range(4) if x not in (i, j))
        out = F.when(pair == k, block[a] * F.lit(65536) + block[b]).otherwise(out)
    return out


def links(distinct: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (a, b), a > b, between different fingerprints: their classes are those of all links."""
    if radius > 2:
        raise ValueError("two of four blocks agree only up to radius 2")
    keyed = distinct.select("fp", F.posexplode(F.array(*_shards(F.col("fp"), 16, 0))).alias("pair", "key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = keyed.join(sizes, "key")  # shards of one fingerprint end here
    small = keyed.filter(F.col("n") <= shard_limit).select("key", F.lit(-1).cast("long").alias("sub"), "fp")
    large = keyed.filter(F.col("n") > shard_limit).withColumn("rest", _rest(F.col("fp"), F.col("pair")))
    large = large.select("key", F.explode(F.array(*_shards(F.col("rest"), 8, 0))).alias("sub"), "fp")
    shards = small.unionByName(large).repartition("key", "sub").sortWithinPartitions("key", "sub")

    def run(batches):
        held, members = None, []
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
            fps = batch.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            out = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if hi == lo:
                    continue
                if (own := (key[0, lo], key[1, lo])) != held:
                    out += spanning_links(members, radius) if len(members) > 1 else []
                    held, members = own, []
                members += fps[lo:hi].tolist()
            if out:
                yield _pairs(out)
        if len(members) > 1 and (out := spanning_links(members, radius)):
            yield _pairs(out)

    found = shards.mapInArrow(run, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _pairs(out):
    both = np.array(out, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node reachable. Hot nodes' rows meet in AQE's skew joins."""
    stars = materialise(edges.select("a", "b"), "links")
    last = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        stars = materialise(small.select("e.a", "e.b").filter("a <> b").distinct(), "small-star")
        # Equal counts and sums of both ends: the stars of this round are those of the last.
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now


def _classes(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, root and component_id (the smallest doc_id of the class) of every fp of distinct (fp, least)."""
    roots = components(edges)
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialise(classes.join(linked, "root").select("fp", "root", "component_id"), "classes")


def _by_bits(docs, text, doc_id, radius, shard_limit):
    """Rows (doc_id, fp) and classes (fp, root, component_id) of SimHash fingerprints within the radius."""
    prints = materialise(fingerprint(docs, text, (doc_id,)).select(F.col(doc_id).alias("doc_id"), "fp"), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return prints, _classes(distinct, links(distinct.select("fp"), radius, shard_limit))


def _links_of_bits(prints, radius, shard_limit):
    """Links (a, b) of the nodes fp of (fp, sim) whose SimHash fingerprints sim are equal or within the radius; of the nodes of one
    fingerprint the least stands for it."""
    signed = materialise(prints.select("fp", "sim").distinct(), "signed")
    named = materialise(signed.groupBy("sim").agg(F.min("fp").alias("node")), "signs")
    same = signed.join(named, "sim").select(F.col("fp").alias("x"), F.col("node").alias("y"))
    near = links(named.select(F.col("sim").alias("fp")), radius, shard_limit)
    for c, n in (("a", "x"), ("b", "y")):
        near = near.join(named.select(F.col("sim").alias(c), F.col("node").alias(n)), c)
    every = same.unionByName(near.select("x", "y")).filter("x <> y")
    return materialise(every.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links-of-bits")


def _by_similarity(docs, text, doc_id, shingle, similarity, radius, shard_limit):
    """Rows (doc_id, fp) and classes (fp, root, component_id) of sets of word shingles at least so similar and, with a radius, of
    SimHash fingerprints within it too, found with BK-trees."""
    sign = None if radius is None else fingerprints
    prints = materialise(shingles.sketches(docs, text, (doc_id,), shingle, sign=sign).withColumnRenamed(doc_id, "doc_id"), "sketches")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands")), "distinct")
    rows_of = lambda rows, fps: told_apart(rows, "fp", fps.select(F.col("fp").alias("__gone")))[1]
    edges = shingles.links(prints, distinct, similarity, rows_of, components, None if radius is None else _links_of_bits(prints, radius, shard_limit))
    return prints.select("doc_id", "fp"), _classes(distinct.select("fp", "least"), edges)


def near_duplicates(docs: DataFrame, text="text", doc_id="doc_id", radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of the class) of every row."""
    with discarding(docs.sparkSession) as kept:
        prints, classes = _by_bits(docs, text, doc_id, radius, shard_limit)
        kept += [prints, classes]
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def without_ids(docs: DataFrame, doc_id: str, gone: DataFrame) -> DataFrame:
    """The rows of docs whose id isn't in gone's `__gone`; a null id stays.

    A broadcast bitmap of bounded size tells most rows that stay at once, so their texts aren't shuffled; only rows whose
    slot is marked (those that go, and others of the same slot) meet the exact join. A full bitmap leaves all to the join.
    """
    sure, rest = told_apart(docs, doc_id, gone)
    rest = rest.select(F.struct("*").alias("row")).join(gone, F.col("row").getField(doc_id) == F.col("__gone"), "left_anti")
    return sure.unionByName(rest.select("row.*"))


def one_of_each(docs: DataFrame, text="text", doc_id="doc_id", radius: int = RADIUS, shard_limit: int = SHARD_LIMIT, shingle: int = SHINGLE, similarity: float | None = None, both: bool = False) -> DataFrame:
    """The document that names its class stays, once; rows without a doc_id have no name to stay by and stay.

    Classes are those of SimHash fingerprints within the radius or, with a similarity, of sets of `shingle` words at least so
    similar; with `both`, those of the links of either kind together.
    """
    if similarity is None and shingle != SHINGLE:
        raise ValueError("another shingle size needs a similarity")
    with discarding(docs.sparkSession) as kept:
        if similarity is None:
            prints, classes = _by_bits(docs, text, doc_id, radius, shard_limit)
        else:
            prints, classes = _by_similarity(docs, text, doc_id, shingle, similarity, radius if both else None, shard_limit)
        found = prints.join(classes, "fp").filter("doc_id is not null")
        named = F.bool_or(F.col("doc_id") == F.col("component_id"))
        ids = materialise(found.groupBy("doc_id").agg(named.alias("named"), F.count("*").alias("times")), "named")
        kept += [ids, classes]
    again = ids.filter("named and times > 1").select(F.col("doc_id").alias("__gone"))
    gone = ids.filter("not named").select(F.col("doc_id").alias("__gone"))
    if not again.limit(1).count():
        return without_ids(docs, doc_id, gone)
    # Of an id's rows those of a class it names stay, one for each class: the least by text, then by the other columns.
    rows = told_apart(docs, doc_id, again)[1]
    rows = rows.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text")).join(again, F.col("id") == F.col("__gone"), "left_semi")
    columns = ("row", "id", "text")
    rows = fingerprint(rows, "text", columns) if similarity is None else shingles.sketches(rows, "text", columns, shingle, whole=False)
    rows = rows.join(classes, "fp").filter(F.col("id") == F.col("component_id"))
    rows = rows.groupBy("id", "root").agg(F.min(F.struct("text", "row")).alias("least")).select("least.row.*")
    return without_ids(docs, doc_id, gone.unionByName(again)).unionByName(rows)
