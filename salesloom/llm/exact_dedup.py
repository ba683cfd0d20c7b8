"""Exact deduplication against a persistent digest index.

The index is a table of one row per distinct text, bucketed and sorted by digest. A batch is reduced to one row per
digest before any shuffle, anti-joined with the index by sort-merge, and what is new is appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salesloom.llm.frames import WORD_GAP, lookup_hot
from salesloom.session import stored

BUCKETS = 64


def normalised(text: Column) -> Column:
    """Null is empty; runs of ASCII white space are one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WORD_GAP, " ")


class DigestIndex:
    """Distinct digests seen so far, each with the id that stays.

    A session that did not create the table opens it by the folder it lies in.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = BUCKETS, folder: str | None = None):
        self.spark, self.table, self.buckets = spark, table, buckets
        place = f" LOCATION '{folder}'" if folder else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS{place}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        (fresh.select("digest", "keep_id").repartition(self.buckets, "digest").write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Decide on every row of a batch and append its new texts to the index.

    Returns doc_id, keep_id, group_size, kept, digest. Of equal texts in a batch the smallest doc_id stays, unless an
    earlier batch holds the text: then its id stays and the whole group goes. group_size counts the rows of this batch.
    Null and empty texts are equal. A null doc_id is never the id that stays while another id has the text; if a text
    has no other, keep_id is null and its rows stay. Rows repeated with one doc_id are one document and share the
    decision. Columns besides doc_id and text are not read. An empty batch gives no rows and leaves the index alone.
    """
    digests = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                 F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")), "digests")
    groups = stored(digests.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("group_size")),
                    "digest-groups")
    known = groups.hint("merge").join(index.rows().hint("merge"), "digest")
    known = stored(known.select("digest", "keep_id", "group_size", F.lit(True).alias("_old")), "known-digests")
    fresh = groups.hint("merge").join(index.rows().hint("merge"), "digest", "left_anti")
    fresh = stored(fresh.select("digest", F.col("_first").alias("keep_id"), "group_size", F.lit(False).alias("_old")),
                   "fresh-digests")
    index.append(fresh)
    decided = lookup_hot(digests, known.unionByName(fresh), "digest", "group_size", digests.count())
    stays = ~F.col("_old") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return decided.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "digest")
