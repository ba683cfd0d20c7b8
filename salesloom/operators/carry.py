"""Carrying values forward along ordered rows of a key, without putting a hot key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK = 4096


def first_since_reset(df: DataFrame, key: str, order: str, reset: Column, value: Column, name: str,
                      chunk: int = CHUNK) -> DataFrame:
    """Add the first non-null value since the last reset row (that row included).

    The order column numbers the rows of a key, so order div chunk cuts a key into
    pieces of bounded size. Each piece is scanned on its own; what a piece hands on is
    one row, and only those rows are scanned per key.
    """
    cut = df.withColumns({"_chunk": F.floor(F.col(order) / chunk), "_reset": F.coalesce(reset, F.lit(False)),
                          "_value": value})
    so_far = W.partitionBy(key, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn("_segment", F.count_if(F.col("_reset")).over(so_far))
    in_segment = W.partitionBy(key, "_chunk", "_segment").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    local = local.withColumn("_local", F.first("_value", ignorenulls=True).over(in_segment))

    # What each piece hands on: did it reset, and the first value after its last reset.
    hand_on = local.groupBy(key, "_chunk").agg(
        F.max("_reset").alias("_any_reset"),
        F.max_by("_local", F.col(order)).alias("_tail"))
    earlier = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)
    hand_on = hand_on.withColumn("_run", F.count_if(F.col("_any_reset")).over(earlier))
    in_run = W.partitionBy(key, "_run").orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)
    hand_on = hand_on.withColumn("_state", F.first("_tail", ignorenulls=True).over(in_run))
    incoming = hand_on.select(key, "_chunk", F.lag("_state").over(W.partitionBy(key).orderBy("_chunk"))
                              .alias("_incoming")).filter(F.col("_incoming").isNotNull())
    joined = local.join(incoming, [key, "_chunk"], "left")
    carried = F.when(F.col("_segment") == 0, F.coalesce("_incoming", "_local")).otherwise(F.col("_local"))
    return joined.withColumn(name, carried).drop("_chunk", "_reset", "_value", "_segment", "_local", "_incoming")
