"""Shards of near equal bytes by sampled splitters, in DataFrame functions only.

Records are ordered by the hash of their text, so equal texts are neighbours. Size-weighted draws (the smallest
-ln(u) / size, u from a hash) give a sample of keys whose quantiles cut the key space into fine ranges of about equal
bytes; a key drawn more than once across quantiles gets a range of its own. Overfull ranges are subdivided: those of several
keys by splitters drawn from their own records, of which alone sums are taken anew, until none is left, those of one hot text by
record. Splitters are one literal that is parsed once. Consecutive ranges make a shard; what a shard then has over its share moves, a range at a time, to
the emptiest shards. Only counts of ranges come to the driver, at most a few times `ranges`.

Defined results: a null text has no bytes and the checksum of none; repeated rows are separate records; an empty table
gives an empty result; texts of any length are one record; other columns, whatever their names, stay out.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import materialise
from millrace.llm.fingerprints import count_not_below, longs, range_of, with_searched

SHARDS, OVERHEAD, RANGES, DRAWS = 24, 8, 3072, 4
#: A range of one text is overfull at so many times the mean range.
OVERFULL = 2.0


def light_records(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, size, text_crc32, key and a number of its own for each record, written once: texts are read only here."""
    raw = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(F.coalesce(text, F.lit(""))) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"))
    return materialise(rows.withColumn("record", F.monotonically_increasing_id()), "records")


def splitters(rows: DataFrame, ranges: int, total: int) -> list[int]:
    """Rising first keys of the ranges after the first, from size-weighted draws; total: bytes of the rows."""
    u = (F.shiftrightunsigned(F.xxhash64("record", "key"), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    draws = ranges * DRAWS
    # About 2 * draws records have turns below this, so that no task sends more than its part of them to the last.
    drawn = rows.select("key", (-F.log(u) / F.col("size")).alias("turn")).filter(F.col("turn") <= 2.0 * draws / max(1, total))
    keys = sorted(r["key"] for r in drawn.orderBy("turn").limit(draws).select("key").collect())
    cuts = keys[DRAWS // 2 :: DRAWS] if len(keys) > ranges else keys
    hot = {a for a, b in zip(cuts, cuts[1:]) if a == b}
    return sorted({*cuts, *(k + 1 for k in hot if k < (1 << 63) - 1)})


def ranges_of(rows: DataFrame, ranges: int = RANGES) -> tuple[DataFrame, list, float]:
    """The rows with their range, the ranges' (range, bytes, hi, lo), and the bytes of a range that is just full."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    cuts = splitters(rows, ranges, total)
    fine = max(1.0, total / ranges)
    inside, sums = rows, []
    while True:
        held = _with_range(inside, cuts).groupBy("range").agg(F.sum("size").alias("bytes"), F.max("key").alias("hi"), F.min("key").alias("lo")).collect()
        over = [r for r in held if r["hi"] > r["lo"] and r["bytes"] > OVERFULL * fine]
        sums += [r for r in held if r not in over]
        if not over:
            break
        many = sum(r["bytes"] for r in over)
        at, own = F.col("key"), sorted((r["lo"], r["hi"]) for r in over)
        lows, highs = longs([lo for lo, _ in own]), longs([hi for _, hi in own])
        # The last overfull range that begins at or before a key is the only one that may hold it.
        last = count_not_below(F.transform(lows, F.bitwise_not), F.bitwise_not(at), len(own)) - 1
        inside = materialise(inside.filter((last >= 0) & (F.get(highs, last) >= at)), "overfull")
        # The middle key parts even a range whose draws are all one key; keys are integers, so halving ends.
        more = {*splitters(inside, math.ceil(many / fine), many), *((r["lo"] + r["hi"]) // 2 + 1 for r in over)}
        cuts = sorted({*cuts, *more})
    sums = [Row(range=bisect_right(cuts, r["lo"]) if len(cuts) > 1 else 0, bytes=r["bytes"], hi=r["hi"], lo=r["lo"]) for r in sums]
    return _with_range(rows, cuts), sums, fine


def _with_range(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """The rows with how many of the rising cuts are <= their key."""
    # range_of takes falling cuts: negate the order with bitwise not.
    return with_searched(rows, "range", range_of(F.bitwise_not(F.col("key")), [~k for k in cuts]) + 1 if len(cuts) > 1 else F.lit(0))


def place(sizes: list[tuple[int, int, int]], shards: int = SHARDS) -> dict[tuple[int, int], int]:
    """(range, part, bytes), in order, to shards: by the middle of their bytes, then from overfull to empty shards."""
    total = sum(x[2] for x in sizes)
    held: list[dict] = [{} for _ in range(shards)]
    before = 0
    for k, part, size in sorted(sizes):
        held[min(shards - 1, shards * (2 * before + size) // (2 * total))][k, part] = size
        before += size
    load = [sum(h.values()) for h in held]
    for _ in range(4 * len(sizes)):
        most, least = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[most] - load[least]
        if gap * 1000 <= total / shards:
            break
        # Move a range, or swap one for a smaller, so that what changes hands is nearest to half the gap.
        small = sorted((size, key) for key, size in held[least].items())
        ways = []
        for key, size in held[most].items():
            at = bisect_left(small, (size - gap / 2,))
            ways += [(abs(2 * (size - s) - gap), key, back) for s, back in [(0, None), *small[max(0, at - 1) : at + 1]] if 0 < size - s < gap]
        if not ways:
            break
        _, key, back = min(ways, key=lambda w: (w[0], w[1], w[2] or (-1, -1)))
        held[least][key] = held[most].pop(key)
        if back is not None:
            held[most][back] = held[least].pop(back)
        load[most], load[least] = sum(held[most].values()), sum(held[least].values())
    return {key: i for i, h in enumerate(held) for key in h}


def shard_by_bytes(docs: DataFrame, doc_id="doc_id", text="text", shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every record."""
    rows = light_records(docs, doc_id, text)
    rows, sums, fine = ranges_of(rows, ranges)
    hot = {r["range"]: min(ranges, math.ceil(r["bytes"] / fine)) for r in sums if r["hi"] == r["lo"] and r["bytes"] > OVERFULL * fine}
    rows = rows.withColumn("part", _lookup(F.col("range"), hot, lambda n: F.pmod(F.xxhash64("record"), n).cast("int"), F.lit(0)))
    if hot:
        sums = rows.groupBy("range", "part").agg(F.sum("size").alias("bytes")).collect()
    placed = place([(r["range"], r["part"] if hot else 0, r["bytes"]) for r in sums], shards) if sums else {}
    # A slot is its range's base within the shard plus its place in the range: no task holds a whole shard.
    spark = docs.sparkSession
    plan = spark.createDataFrame([(k, p, s) for (k, p), s in placed.items()], "range int, part int, shard int")
    counts = rows.groupBy("range", "part").agg(F.count("*").alias("n")).join(F.broadcast(plan), ["range", "part"])
    earlier = Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("range", "part", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("range", "part").orderBy("key", "doc_id", "record")
    out = rows.withColumn("at", F.row_number().over(within) - 1).join(bases, ["range", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("at")).alias("slot"))


def _lookup(column: Column, found: dict[int, int], use, otherwise: Column) -> Column:
    if not found:
        return otherwise
    n = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])[column]
    return F.when(n.isNotNull(), use(n)).otherwise(otherwise)
