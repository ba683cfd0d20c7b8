"""Fiscal period phrases, for one argument and for a whole column of phrases."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from salesloom import contracts as C
from salesloom.functions.scalars import strip

# Phrases that mean "no period", and the relative ones.
EVERYTHING = ["all", "all time", "total"]
THIS_QUARTER = ["current quarter", "this quarter"]
LAST_QUARTER = ["last quarter", "previous quarter"]
THIS_YEAR = ["current fy", "this fy", "current year", "current fiscal year", "this fiscal year"]
LAST_YEAR = ["last fy", "previous fy", "last year", "last fiscal year", "previous fiscal year"]
YEAR_TO_DATE = ["ytd", "year to date"]
YEAR_PATTERN = r"fy\s*(\d{2,4})"
QUARTER_PATTERN = r"q([1-4])"
RANGE_PATTERN = r"^(\d{4}-\d{2}-\d{2}) to (\d{4}-\d{2}-\d{2})$"


@dataclass(frozen=True)
class Period:
    label: str
    fiscal_year: str | None = None
    fiscal_quarter: str | None = None
    start: dt.date | None = None
    end: dt.date | None = None


def _year_label(start_year: int) -> str:
    return f"FY{start_year % 100:02d}-{(start_year + 1) % 100:02d}"


def _fiscal_position(day: dt.date) -> tuple[int, int]:
    return (day.year, (day.month - 1) // 3) if day.month >= 4 else (day.year - 1, 4)


def resolve(text: str | None, as_of: dt.date = C.DEFAULT_AS_OF,
            start: dt.date | None = None, end: dt.date | None = None) -> Period:
    """Dates for a phrase. Relative words count from as_of, never from the clock."""
    phrase = (text or "").strip().lower()
    ranged = re.match(RANGE_PATTERN, phrase)
    if ranged:
        start, end = (dt.date.fromisoformat(g) for g in ranged.groups())
    if start and end and (ranged or not phrase):
        return Period(f"{start} to {end}", None, None, start, end)
    if not phrase or phrase in EVERYTHING:
        return Period("All Time")
    this_year, this_quarter = _fiscal_position(as_of)
    has = lambda words: any(w in phrase for w in words)
    digits = re.search(QUARTER_PATTERN, phrase)
    quarter = int(digits.group(1)) if digits else None
    year_match = re.search(YEAR_PATTERN, phrase)
    year = None
    if year_match:
        year = int(year_match.group(1)) + (2000 if len(year_match.group(1)) == 2 else 0)
    if has(THIS_QUARTER):
        year, quarter = this_year, this_quarter
    elif has(LAST_QUARTER):
        year, quarter = (this_year, this_quarter - 1) if this_quarter > 1 else (this_year - 1, 4)
    elif has(YEAR_TO_DATE):
        return Period(f"YTD {_year_label(this_year)}", _year_label(this_year), None, dt.date(this_year, 4, 1), as_of)
    elif has(THIS_YEAR):
        year = this_year
    elif has(LAST_YEAR):
        year = this_year - 1
    if year is None and quarter is None:
        return Period(text)
    year = this_year if year is None else year
    first, months = (4, 12) if quarter is None else (1 + 3 * quarter, 3)
    begin = dt.date(year + (first - 1) // 12, (first - 1) % 12 + 1, 1)
    after = first + months - 1
    last = dt.date(year + after // 12, after % 12 + 1, 1) - dt.timedelta(days=1)
    name = _year_label(year)
    return Period(name if quarter is None else f"{name} Q{quarter}", name,
                  None if quarter is None else f"Q{quarter}", begin, last)


def resolve_columns(df: DataFrame, column: str, as_of: dt.date = C.DEFAULT_AS_OF) -> DataFrame:
    """Add label, fiscal_year, fiscal_quarter, start_date, end_date for every phrase of a column.

    Done in small steps, so that shared pieces are computed once per row and every step stays inside generated code.
    """
    this_year, this_quarter = _fiscal_position(as_of)
    last_year, last_quarter = (this_year, this_quarter - 1) if this_quarter > 1 else (this_year - 1, 4)
    text, relative, year, quarter, start = (F.col(c) for c in ("_text", "_relative", "_year", "_quarter", "_start"))
    has = lambda words: text.rlike("|".join(re.escape(w) for w in words))
    blank_to_null = lambda c: F.nullif(c, F.lit(""))
    two = lambda c: F.lpad(F.pmod(c, F.lit(100)).cast("string"), 2, "0")

    df = df.withColumn("_text", F.lower(strip(F.coalesce(F.col(column), F.lit("")))))
    df = df.withColumns({
        "_nothing": (text == "") | text.isin(EVERYTHING),
        "_relative": F.when(has(THIS_QUARTER), "this_quarter").when(has(LAST_QUARTER), "last_quarter")
        .when(has(YEAR_TO_DATE), "ytd").when(has(THIS_YEAR), "this_year").when(has(LAST_YEAR), "last_year")
        .otherwise("none"),
        "_year_text": F.regexp_extract(text, YEAR_PATTERN, 1),
        "_written_quarter": blank_to_null(F.regexp_extract(text, QUARTER_PATTERN, 1)).cast("int"),
        "_range_start": blank_to_null(F.regexp_extract(text, RANGE_PATTERN, 1)).try_cast("date"),
        "_range_end": blank_to_null(F.regexp_extract(text, RANGE_PATTERN, 2)).try_cast("date"),
    })
    df = df.withColumn("_quarter", F.when(relative == "this_quarter", this_quarter)
                       .when(relative == "last_quarter", last_quarter)
                       .when(relative != "ytd", F.col("_written_quarter")))
    written_year = blank_to_null("_year_text").cast("int") + F.when(F.length("_year_text") == 2, 2000).otherwise(0)
    df = df.withColumn("_year", F.when(relative.isin("this_quarter", "this_year", "ytd"), this_year)
                       .when(relative == "last_quarter", last_year).when(relative == "last_year", this_year - 1)
                       .otherwise(F.coalesce(written_year, F.when(quarter.isNotNull(), this_year))))
    df = df.withColumns({
        "_found": ~F.col("_nothing") & F.col("_range_start").isNull() & year.isNotNull(),
        "_start": F.add_months(F.make_date(year, F.lit(4), F.lit(1)), (F.coalesce(quarter, F.lit(1)) - 1) * 3),
        "_name": F.concat(F.lit("FY"), two(year), F.lit("-"), two(year + 1)),
        "_quarter_name": F.concat(F.lit("Q"), quarter.cast("string")),
    })
    found, ranged = F.col("_found"), F.col("_range_start").isNotNull() & ~F.col("_nothing")
    end = F.when(relative == "ytd", F.lit(as_of)).otherwise(
        F.date_sub(F.add_months(start, F.when(quarter.isNull(), 12).otherwise(3)), 1))
    label = (F.when(ranged, text).when(F.col("_nothing"), "All Time")
             .when(found & (relative == "ytd"), F.concat(F.lit("YTD "), F.col("_name")))
             .when(found, F.concat_ws(" ", "_name", "_quarter_name")).otherwise(F.col(column)))
    steps = ["_text", "_nothing", "_relative", "_year_text", "_written_quarter", "_range_start", "_range_end",
             "_quarter", "_year", "_found", "_start", "_name", "_quarter_name"]
    return df.withColumns({
        "label": label,
        "fiscal_year": F.when(found, F.col("_name")),
        "fiscal_quarter": F.when(found, F.col("_quarter_name")),
        "start_date": F.when(found, start).when(ranged, F.col("_range_start")),
        "end_date": F.when(found, end).when(ranged, F.col("_range_end")),
    }).drop(*steps)
