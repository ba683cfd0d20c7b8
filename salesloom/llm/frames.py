"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
#: One key is hot when it holds this share of all rows or more, so there are at most this many hot keys.
HOT_KEYS = 1000


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words between ASCII white space, in order."""
    return F.array_remove(F.split(text, WORD_GAP), "")


def lookup_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per key, where a few keys may hold most rows.

    Keys with a thousandth of all rows or more, a thousand at most, are broadcast, so that their rows stay where they
    are; all other keys meet in a shuffle join. Null keys match each other.
    """
    hot = groups.filter(F.col(size) * HOT_KEYS >= F.lit(total))
    rest = [c for c in groups.columns if c != key]
    near = rows.join(F.broadcast(hot.withColumnRenamed(key, "_key").withColumn("_hot", F.lit(True))),
                     F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    found = near.filter("_hot").drop("_hot")
    cold = groups.filter(F.col(size) * HOT_KEYS < F.lit(total)).withColumnRenamed(key, "_key")
    other = near.filter("_hot IS NULL").drop("_hot", *rest).join(cold, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return found.unionByName(other)
