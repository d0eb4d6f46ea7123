"""Joins of intervals by bins of positions: equal bins meet, so that neither a hot key nor its square is in one task.

Intervals are [lo, hi) of whole numbers within a key (a document). Bins of `width` positions part a key's line; an interval is
dealt to the bins that it touches, and a pair is kept in one of them only, so no pair has to be deduplicated afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a bin: about the length of the longer intervals.
WIDTH = 2048


def _bin(at: Column, width: int) -> Column:
    return F.floor(at / F.lit(width)).cast("long")


def holding(points: DataFrame, holders: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi", start: str = "s", end: str = "e", width: int = WIDTH) -> DataFrame:
    """Rows of points (by, lo, hi) with each holder (by, start, end) that holds [lo, hi) whole. A point meets holders in the bin
    of its start only. Nulls hold and are held by nothing."""
    dealt = holders.filter(F.col(start) <= F.col(end)).withColumn("__bin", F.explode(F.sequence(_bin(F.col(start), width), _bin(F.col(end), width))))
    met = points.withColumn("__bin", _bin(F.col(lo), width)).join(dealt, [*by, "__bin"])
    return met.filter((F.col(start) <= F.col(lo)) & (F.col(hi) <= F.col(end))).drop("__bin")


def overlapping(left: DataFrame, right: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi", start: str = "s", end: str = "e", width: int = WIDTH) -> DataFrame:
    """Pairs of rows whose intervals (by, lo, hi) and (by, start, end) share a position; each is kept in the bin of the later of
    the two starts. Empty intervals and nulls share none."""
    sides = []
    for rows, a, b in ((left, lo, hi), (right, start, end)):
        sides.append(rows.filter(F.col(a) < F.col(b)).withColumn("__bin", F.explode(F.sequence(_bin(F.col(a), width), _bin(F.col(b) - 1, width)))))
    met = sides[0].join(sides[1], [*by, "__bin"])
    shared = (F.col(lo) < F.col(end)) & (F.col(start) < F.col(hi))
    return met.filter(shared & (F.col("__bin") == _bin(F.greatest(lo, start), width))).drop("__bin")
