"""Snapshots of the clean boards: written whole, read by the newest complete one."""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from salesloom import contracts as C
from salesloom.functions.scalars import moment, money

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
MANIFEST = "snapshot_id long, synced_at timestamp_ntz, deals_count long, work_orders_count long, checksum string"


def checksum(deals: DataFrame, orders: DataFrame) -> DataFrame:
    """Row counts, exact sums and the first 16 hex digits of their SHA-256."""
    text = lambda c: F.coalesce(F.sum(money(F.col(c))), F.lit(0).cast("decimal(28,2)")).cast("string")
    d = deals.agg(F.count(F.lit(1)).alias("deals_count"), text("deal_value").alias("_d"))
    w = orders.agg(F.count(F.lit(1)).alias("work_orders_count"), text("amount_excl_gst").alias("_w"))
    joined = F.concat(F.col("deals_count").cast("string"), F.col("_d"), F.col("work_orders_count").cast("string"),
                      F.col("_w"))
    return d.crossJoin(w).select("deals_count", "work_orders_count",
                                 F.substring(F.sha2(joined, 256), 1, 16).alias("checksum"))


def write(spark: SparkSession, folder: str, snapshot_id: int, deals: DataFrame, orders: DataFrame,
          ledger: DataFrame, synced_at: dt.datetime) -> None:
    """Write the boards under a new id, then its manifest row. Without that row the snapshot does not exist,
    so a load that fails half-way leaves the last good one in place. A complete snapshot is never overwritten."""
    try:
        taken = not manifest(spark, folder).filter(F.col("snapshot_id") == snapshot_id).isEmpty()
    except AnalysisException:
        taken = False
    if taken:
        raise FileExistsError(f"snapshot {snapshot_id} is complete in {folder}")
    part = f"snapshot_id={snapshot_id}"
    for name, frame in {"deals": deals, "work_orders": orders, "ledger": ledger}.items():
        frame.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}/{part}")
    stored = [spark.read.parquet(f"{folder}/{name}/{part}") for name in ("deals", "work_orders")]
    row = checksum(*stored).select(
        F.lit(snapshot_id).cast("long").alias("snapshot_id"), moment(synced_at).alias("synced_at"),
        "deals_count", "work_orders_count", "checksum")
    row.coalesce(1).write.mode("append").json(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def latest_id(spark: SparkSession, folder: str) -> int | None:
    """Id of the newest complete snapshot: one number from a table of one row per snapshot."""
    try:
        return manifest(spark, folder).agg(F.max("snapshot_id")).first()[0]
    except AnalysisException:
        return None


def read(spark: SparkSession, folder: str, name: str, snapshot_id: int | None = None) -> DataFrame:
    """One board of the newest complete snapshot; only its folder is listed and read."""
    wanted = latest_id(spark, folder) if snapshot_id is None else snapshot_id
    if wanted is None:
        raise FileNotFoundError(f"no complete snapshot in {folder}")
    return spark.read.parquet(f"{folder}/{name}/snapshot_id={wanted}")


def is_fresh(spark: SparkSession, folder: str, now: dt.datetime, ttl: int = C.SNAPSHOT_TTL_SECONDS) -> bool:
    newest = manifest(spark, folder).agg(F.max("synced_at")).first()[0] if latest_id(spark, folder) is not None else None
    return newest is not None and (now - newest).total_seconds() < ttl


def refresh(spark: SparkSession, folder: str, load, now: dt.datetime, force: bool = False) -> int:
    """Load and store a new snapshot unless the newest one is fresh. load() gives (deals, orders, ledger).

    If loading fails while an older snapshot exists, that one stays in use; its age shows it is stale.
    """
    last = latest_id(spark, folder)
    if last is not None and not force and is_fresh(spark, folder, now):
        return last
    new_id = (now.replace(tzinfo=now.tzinfo or dt.timezone.utc) - EPOCH) // dt.timedelta(microseconds=1)
    try:
        write(spark, folder, new_id, *load(), now)
    except Exception:
        if last is None:
            raise
        logging.getLogger(__name__).exception("load failed; snapshot %s stays in use", last)
        return last
    return new_id


def status(snapshots: DataFrame, now: dt.datetime, as_of: dt.date = C.DEFAULT_AS_OF, source: str = "snapshot",
           ttl: int = C.SNAPSHOT_TTL_SECONDS) -> DataFrame:
    """Counts, age, staleness, source label and badge of the newest snapshot, as one row."""
    newest = snapshots.agg(F.max_by(F.struct(*snapshots.columns), "snapshot_id").alias("s")).select("s.*")
    age = F.timestamp_diff("SECOND", F.col("synced_at"), moment(now))
    stale = age >= ttl
    label = F.when(stale, "stale_snapshot").otherwise(F.lit(source))
    badge = F.concat(F.when(stale, "Stale snapshot").otherwise(F.initcap(F.lit(source))), F.lit(" · synced "),
                     F.date_format("synced_at", "HH:mm"), F.lit(f" · as of {as_of}"))
    return newest.select("deals_count", "work_orders_count", "checksum", F.lit(True).alias("connected"),
                         age.alias("age_seconds"), stale.alias("is_stale"), label.alias("source"),
                         badge.alias("display_badge"), F.lit(ttl).alias("ttl_seconds"))
