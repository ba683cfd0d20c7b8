"""Consecutive numbers in sort order without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from salesloom.session import stored


def number_within(df: DataFrame, groups: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Number the rows of each group from 1 in the given order.

    Rows are range-partitioned by group and order, so even one huge group is spread
    out. The sorted pieces are written once, which fixes their boundaries; only one row
    per piece and group goes through a window.
    """
    keys = [*groups, *order]
    pieces = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumns({"_piece": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    pieces = stored(pieces, "numbered")
    sizes = pieces.groupBy(*groups, "_piece").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*groups).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    numbered = pieces.join(sizes, [*groups, "_piece"])
    return numbered.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop(
        "_piece", "_at", "_first", "_before")
