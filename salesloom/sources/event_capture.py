"""Captured event streams (event:/data: lines) to event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file, split of the file, order inside the split."""
    return spark.read.text(path).select(
        F.btrim("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def parse(lines: DataFrame) -> DataFrame:
    """Each data: line with the event named by the last event: line before it in the same file.

    The name is carried forward inside each file split (a bounded piece), and only
    the last name of every split is carried across splits. Comments and data that
    is not JSON are skipped.
    """
    body = lines.filter((F.col("line") != "") & ~F.col("line").startswith(":"))
    marked = body.withColumn("named", F.when(F.col("line").startswith("event:"),
                                             F.btrim(F.expr("substring(line, 7)"))))
    so_far = W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    inside = marked.withColumn("local", F.last("named", ignorenulls=True).over(so_far))
    ends = marked.groupBy("file", "block").agg(
        F.max_by("named", F.when(F.col("named").isNotNull(), F.col("at"))).alias("end_name"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("file", "block", F.last("end_name", ignorenulls=True).over(earlier).alias("carried"))
    data = inside.filter(F.col("line").startswith("data:")).join(carried, ["file", "block"])
    text = F.btrim(F.expr("substring(line, 6)"))
    return (data.select("file", "block", "at", F.coalesce("local", "carried").alias("event"), text.alias("data"))
            .filter(F.try_parse_json("data").isNotNull()))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parse(read_lines(spark, path))
