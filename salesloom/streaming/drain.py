"""Run a stream over what is there now and give its output back as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from salesloom.session import shared_folder

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table_stream(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files: int = 1) -> DataFrame:
    """Parquet files as a stream, a bounded number of files per micro-batch."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files)
            .parquet(path))


def replayed(events: DataFrame, folder: str, closing: dict[str, int], ts: str = "ts", slices: int = 4,
             files: int = 100) -> tuple[DataFrame, str]:
    """A table as a stream in time order, and the watermark delay with which none of its rows is late.

    Slices of equal length are written one after the other, each by many tasks, and at last a row far in the future that
    moves the watermark past all others; closing: values of that row, whose other columns are null. Files of a slice come
    in any order, so the delay is the length of a slice.
    """
    at = F.col(ts).cast("timestamp")
    low, high = events.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    low, high = low or 0, high or 0
    place = F.floor((F.unix_micros(at) - low) * slices / (high - low + 1))
    for i in range(slices):
        events.filter(place == i).write.mode("append").parquet(folder)
    spark = events.sparkSession
    values = {ts: "2200-01-01", **closing}
    end = spark.range(1).select(*[F.lit(values.get(c)).cast(t).alias(c) for c, t in events.dtypes])
    end.write.mode("append").parquet(folder)
    return read_table_stream(spark, folder, events.schema, files=files), f"{(high - low) // slices // 1_000_000 + 1} seconds"


def _with_rocksdb(spark: SparkSession, start):
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return start()
    finally:
        spark.conf.set(STATE_STORE, before)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Append-mode output of everything available, from files in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/salesloom/{name}-{uuid.uuid4().hex}"
    query = _with_rocksdb(spark, lambda: stream.writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drain_updates(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Update-mode output: the last row written for each key."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/salesloom/{name}-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = (stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{base}/state")
             .outputMode("update").trigger(availableNow=True).start())
    query.awaitTermination()
    written = spark.read.parquet(f"{base}/out")
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("r"))
    return latest.select("r.*")
