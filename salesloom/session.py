"""Session defaults and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Generated methods beyond 8000 bytes are never compiled by the JVM; plain operators beat them by far.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Session for tests and benches; on a cluster use the one the cluster gives."""
    builder = SparkSession.builder.master(master).appName("salesloom")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def compile_wide_plans(spark: SparkSession) -> None:
    """Lower the session's limit of generated methods to that of SETTINGS, unless it is lower already.

    Board queries are wide: the method generated for typing and judging a whole row is longer than what the JVM compiles.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(limit)) > int(SETTINGS[limit]):
        spark.conf.set(limit, SETTINGS[limit])


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode, where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="salesloom-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str, by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write the frame as a table in the shared folder and read that: lineage ends, and its size becomes known. `by`:
    columns that part it, so that a part of it has a known size too; codec: how it is compressed, if not as the session does."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/salesloom/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*(by or [])).parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
