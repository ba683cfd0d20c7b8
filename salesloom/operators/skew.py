"""Left joins in which a few keys of the right side hold most of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot from this share of the right side's rows on, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
SALTS = 16


def left_join_split(left: DataFrame, right: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """left.join(right, key, "left") with hot keys of the right side dealt over many tasks.

    Hot keys are set aside. Rows of the left side with such a key are repeated once for each salt and meet that part of the
    right side; as the key is there, none of them stays alone. Hot keys that the left side lacks meet nothing and go. All
    other rows are joined as usual. A null key matches nothing.
    """
    counts = right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = right.agg(F.count(F.lit(1)).alias("_all"))
    hot = counts.crossJoin(F.broadcast(total)).filter(F.col("_n") * HOT_SHARE >= F.col("_all")).select(F.col(key).alias("_hot"))
    is_hot = lambda df: df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    left, right = is_hot(left), is_hot(right)
    cold = left.filter("_hot IS NULL").drop("_hot").join(right.filter("_hot IS NULL").drop("_hot"), key, "left")
    salted = left.filter("_hot IS NOT NULL").drop("_hot").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = right.filter("_hot IS NOT NULL").drop("_hot")
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64(*dealt.columns), F.lit(salts)).cast("int"))
    return cold.unionByName(salted.join(dealt, [key, "_salt"]).drop("_salt"))
