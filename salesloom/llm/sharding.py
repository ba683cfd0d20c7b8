"""Shards of near equal bytes by sampled splitters.

Records are ordered by a hash of their text, so that equal texts lie together. A size-weighted sample of the order keys
gives quantile boundaries; records go to the range between two boundaries; a range that turns out overfull, because one
text holds many rows, is subdivided by a hash of the id. Bytes before each range are summed over ranges, bytes before a
record over its own range only, and a record's shard follows from the bytes before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from salesloom.session import stored

SHARDS = 16
#: Bytes that a range should hold, the least and the most number of ranges, and sampled keys for each range.
RANGE_BYTES = 32 << 20
RANGES = (64, 1 << 16)
SAMPLES = 64


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the order keys: a hash of the text and a hash of the id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_key"),
        F.xxhash64(F.lit(7), F.col("doc_id")).alias("_part"))


def splitters(keys: DataFrame, ranges: int, total: int) -> list[int]:
    """Quantile boundaries of a sample in which every byte has the same chance; at most ranges - 1 of them.

    A row is drawn by a hash of its id, so a rerun draws the same; a row larger than a whole step of the sample counts
    as often as steps fit into it.
    """
    step = max(1, total // (ranges * SAMPLES))
    chance = (F.xxhash64(F.lit(11), "doc_id", "_key").bitwiseAND(F.lit((1 << 30) - 1)) % F.lit(step))
    times = (F.col("size") + chance).cast("long")
    drawn = keys.withColumn("_times", F.floor(times / F.lit(step)).cast("int")).filter("_times > 0")
    drawn = drawn.select("_key", F.explode(F.array_repeat(F.lit(1), F.col("_times"))))
    cuts = [i / ranges for i in range(1, ranges)]
    got = drawn.agg(F.percentile_approx("_key", cuts, F.lit(max(10_000, 4 * ranges))).alias("cuts")).first()["cuts"]
    return sorted(set(got or []))


def ranged(keys: DataFrame, cuts: list[int]) -> DataFrame:
    """keys with _range: how many boundaries are not above the key.

    A table with a row for each cell of the leading key bits has the boundaries within that cell, so the lookup is an
    equality join with at most 4 cells for a boundary and compares a few numbers for a row.
    """
    spark = keys.sparkSession
    bits = max(4, (4 * len(cuts)).bit_length())
    cell = lambda key: F.shiftright(key, 64 - bits)
    inside: dict[int, list[int]] = {}
    for cut in cuts:
        inside.setdefault(cut >> (64 - bits), []).append(cut)
    rows, before = [], 0
    for c in range(-(1 << (bits - 1)), 1 << (bits - 1)):
        rows.append((c, before, inside.get(c, [])))
        before += len(inside.get(c, []))
    cells = spark.createDataFrame(rows, "_cell long, _before int, _cuts array<long>")
    placed = keys.withColumn("_cell", cell(F.col("_key"))).join(F.broadcast(cells), "_cell")
    above = F.size(F.filter("_cuts", lambda x: x <= F.col("_key")))
    return placed.withColumn("_range", F.col("_before") + above).drop("_cell", "_before", "_cuts")


def shard(docs: DataFrame, shards: int = SHARDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record's shard from 0 to shards - 1, by the law `bytes`: shard sizes differ by a record or so.

    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard (null: this law moves
    records when a shard is added). A null text counts as empty and has size 1. Equal texts share a shard unless a
    boundary falls among them. Repeated rows and null ids are records like others; among fully equal rows any order
    serves. Columns besides doc_id and text are not read. An empty table gives an empty one.
    """
    keys = stored(sized(docs), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    ranges = min(max(RANGES[0], total // range_bytes), RANGES[1])
    placed = ranged(keys, splitters(keys, ranges, total))
    target = max(1, 2 * total // ranges)
    # Ranges are few and fixed in number; the subdivision of each follows from its exact size.
    loads = placed.groupBy("_range").agg(F.sum("size").alias("_load"))
    pieces = loads.select("_range", F.ceil(F.col("_load") / F.lit(target)).cast("long").alias("_pieces"))
    placed = placed.join(F.broadcast(pieces), "_range")
    # Even slices of the id hash, in order.
    unit = (F.col("_part").bitwiseAND(F.lit((1 << 40) - 1)) * F.col("_pieces"))
    placed = placed.withColumn("_piece", F.when(F.col("_pieces") == 1, 0).otherwise(F.shiftright(unit, 40)).cast("int"))
    sums = placed.groupBy("_range", "_piece").agg(F.sum("size").alias("_bytes"))
    ahead = W.orderBy("_range", "_piece").rowsBetween(W.unboundedPreceding, -1)
    sums = stored(sums.select("_range", "_piece", F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_ahead")),
                  "shard-ranges")
    order = W.partitionBy("_range", "_piece").orderBy("_key", "_part", "doc_id", "size")
    inside = placed.withColumn("_within", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    inside = inside.join(F.broadcast(sums), ["_range", "_piece"])
    at = F.col("_ahead") + F.col("_within")
    number = F.floor(at.cast("decimal(20,0)") * shards / F.lit(max(1, total))).cast("int")
    return numbered(inside.withColumns({"_at": at, "shard": number}), order)


def numbered(rows: DataFrame, order) -> DataFrame:
    """Slots: rows before a range's part of a shard, plus the place within that part."""
    rows = rows.withColumn("_place", F.row_number().over(order))
    rows = stored(rows, "shard-rows")
    parts = rows.groupBy("shard", "_range", "_piece").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy("shard").orderBy("_range", "_piece").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("shard", "_range", "_piece", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_rows"))
    slot = F.col("_rows") + F.col("_place") - F.col("_first")
    return rows.join(F.broadcast(parts), ["shard", "_range", "_piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
