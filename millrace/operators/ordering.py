"""Places of rows in a total order, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def row_numbers(rows: DataFrame, *order, save, name: str = "rn") -> DataFrame:
    """The rows with their place (from 1) in the order, and `total`, their number.

    A range sort deals the rows; a row's place is its place in its part and the sizes of the parts before, of which there
    is one row each. `save` writes the sorted rows once, so that both are taken from the same parts.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = save(rows.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__at": at}))
    by = Window.partitionBy(F.lit(0)).orderBy("__part")
    before = F.coalesce(F.sum("__n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("__n").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = kept.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", before.alias("__before"), whole.alias("total"))
    return kept.join(F.broadcast(parts), "__part").select(*rows.columns, (F.col("__before") + F.col("__at") + 1).alias(name), "total")
