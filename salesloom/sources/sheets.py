"""Sheet exports as CSV, with or without a header in the first row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from salesloom import contracts as C

SCHEME = r"^[a-z0-9]+:/+"  # listings and file metadata write it with different numbers of slashes


#: Quotes are doubled inside quoted cells, and a quoted cell may hold line breaks.
QUOTING = {"multiLine": True, "escape": '"'}
CELL = r'(?s)(?:^|,)("(?:[^"]|"")*"|[^,]*)'
#: Column for the cells of a row beyond the width that was asked for.
SURPLUS = "_surplus"


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """Export whose first row is the header; all columns text."""
    return spark.read.option("header", True).option("multiLine", False).csv(path)


def cells_of(row: Column) -> Column:
    """Cells of one row of an export as it stands in the file, quotes taken off."""
    cell = lambda c: F.when(c.startswith('"'), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(F.regexp_extract_all(F.rtrim(row, F.lit("\r\n")), F.lit(CELL), F.lit(1)), cell)


def read_floating_header(spark: SparkSession, path: str, columns: int, surplus: str | None = None) -> DataFrame:
    """Export whose header sits in one of the first rows of its first file.

    Only the first five rows come to the driver, to find the header. Rows are numbered inside the first file alone, every
    other one is read as is. Quoted line breaks belong to their cell, so a file is one task: export big sheets as many
    files. `surplus` names a column for the cells of a row beyond `columns`, null where there are none.
    """
    names = [f"_c{i}" for i in range(columns)]
    raw = spark.read.schema(", ".join(f"{n} string" for n in [*names, "_row_text"])).options(
        columnNameOfCorruptRecord="_row_text", **QUOTING).csv(path)
    first_file = re.sub(SCHEME, "", sorted(raw.inputFiles())[0])
    kept = [*names]
    if surplus:
        # Spark hands the whole row over where its width is not the one asked for.
        cells = cells_of(F.col("_row_text"))
        raw = raw.withColumn(surplus, F.when(F.size(cells) > columns, F.slice(cells, columns + 1, F.size(cells))))
        kept.append(surplus)
    placed = raw.select(*kept, F.col("_metadata.file_path").alias("_file"),
                        F.col("_metadata.file_block_start").alias("_block"))
    in_head = (F.regexp_replace("_file", SCHEME, "") == first_file) & (F.col("_block") == 0)
    numbered = placed.filter(in_head).withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "_row", F.row_number().over(W.partitionBy("_file", "_block").orderBy("_at")) - 1)
    probe = numbered.filter(F.col("_row") < C.HEADER_PROBE_ROWS).orderBy("_row").select("_row", *names).collect()
    joined = {r["_row"]: " ".join(str(v).lower() for v in r[1:] if v is not None) for r in probe}
    at = next((i for i, text in sorted(joined.items()) if any(m in text for m in C.HEADER_MARKERS)),
              C.HEADER_DEFAULT_ROW)
    header = next((r for r in probe if r["_row"] == at), None)
    titles = [(v or n).strip() for n, v in zip(names, header[1:])] if header else names
    head = numbered.filter(F.col("_row") > at).select(*kept)
    rows = head.unionByName(placed.filter(~in_head).select(*kept))
    return rows.toDF(*titles, *kept[columns:])


def read_typed(spark: SparkSession, path: str, types: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns renamed and cast by a schema map {name: (type, source title)}; bad text is null."""
    sheet = read_plain(spark, path)
    return apply_schema_map(sheet, types)


def apply_schema_map(sheet: DataFrame, types: dict[str, tuple[str, str]]) -> DataFrame:
    return sheet.select([F.col(f"`{title}`").try_cast(kind).alias(name) for name, (kind, title) in types.items()])


# Declared types of the deals board.
DEALS_SCHEMA_MAP = {
    "deal_name": ("string", "Deal Name"),
    "owner_code": ("string", "Owner code"),
    "client_code": ("string", "Client Code"),
    "status": ("string", "Deal Status"),
    "deal_stage": ("string", "Deal Stage"),
    "sector": ("string", "Sector/service"),
    "deal_value": ("double", "Masked Deal value"),
    "closure_probability": ("string", "Closure Probability"),
    "close_date_actual": ("date", "Close Date (A)"),
    "tentative_close_date": ("date", "Tentative Close Date"),
    "created_date": ("date", "Created Date"),
}
