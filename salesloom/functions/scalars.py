"""Scalar functions over columns. Every one is a built-in expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from salesloom import contracts as C

WHITESPACE = " \t\n\r\x0b\x0c"
MONEY = "decimal(18,2)"


def strip(col: Column) -> Column:
    """Drop white space at both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def clean_text(col: Column) -> Column:
    """Stripped text; blank becomes null."""
    return F.nullif(strip(col), F.lit(""))


def money(col: Column) -> Column:
    """Exact two-digit amount, so that sums do not depend on row order."""
    return col.cast(MONEY)


def money_sum(col: Column) -> Column:
    """Order-independent sum of an amount, 0 when there are no rows."""
    return F.coalesce(F.sum(money(col)).cast("double"), F.lit(0.0))


def money_sum_if(cond: Column, col: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, money(col))).cast("double"), F.lit(0.0))


def moment(value) -> Column:
    """A date and time as it stands, whatever the session's zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def percent(part: Column, base: Column, digits: int = 4) -> Column:
    """part / base * 100, and 0 unless the base is positive."""
    return F.round(F.when(base > 0, part / base * 100).otherwise(F.lit(0.0)), digits)


def fiscal_year(date: Column) -> Column:
    """April-March year of a date, such as FY25-26."""
    start = F.year(F.add_months(date, -3))
    two_digits = lambda year: F.lpad((year % 100).cast("string"), 2, "0")
    return F.when(date.isNotNull(), F.concat(F.lit("FY"), two_digits(start), F.lit("-"), two_digits(start + 1)))


def fiscal_quarter(date: Column) -> Column:
    """Quarter of the April-March year; January to March is Q4."""
    return F.when(date.isNotNull(), F.concat(F.lit("Q"), F.quarter(F.add_months(date, -3)).cast("string")))


def repair_sector(col: Column) -> Column:
    """Repair the spelling of a board's sector; unknown values pass through."""
    text = strip(col)
    spelling = F.create_map(*[F.lit(x) for pair in C.SECTOR_SPELLINGS.items() for x in pair])
    known = F.try_element_at(spelling, F.lower(text))
    return F.when(col.isNull() | (col == ""), F.lit(C.UNSPECIFIED_SECTOR)).otherwise(F.coalesce(known, text))


def canonical_sector(col: Column) -> Column:
    """One of the nine reporting sectors."""
    text = F.lower(strip(col))
    bucket = None
    for name, words in C.CANONICAL_SECTORS.items():
        if name != "Other":
            bucket = F.when(text.isin(words), name) if bucket is None else bucket.when(text.isin(words), name)
    return bucket.otherwise(F.lit("Other"))


def resolve_sector(col: Column) -> Column:
    """Reporting sector for a name or alias; anything else is returned unchanged."""
    text = F.lower(strip(col))
    found = None
    for name, words in C.CANONICAL_SECTORS.items():
        hit = text.isin([name.lower(), *words])
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found.otherwise(col)


def resolve_sector_name(name: str) -> str:
    """The same for one argument given by the caller."""
    wanted = name.strip().lower()
    return next((sector for sector, words in C.CANONICAL_SECTORS.items()
                 if wanted == sector.lower() or wanted in words), name)


def is_canonical_sector(col: Column) -> Column:
    return F.coalesce(col.isin(list(C.CANONICAL_SECTORS)), F.lit(False))


def is_energy_sector(col: Column) -> Column:
    return F.coalesce(col.isin(C.ENERGY_SECTORS), F.lit(False))


def probability_weight(col: Column) -> Column:
    """Closing probability as an exact decimal."""
    weight = lambda text: F.lit(text).cast("decimal(3,2)")
    chain = None
    for word, value in C.PROBABILITY_WEIGHTS.items():
        chain = F.when(col == word, weight(value)) if chain is None else chain.when(col == word, weight(value))
    return chain.otherwise(weight(C.DEFAULT_PROBABILITY_WEIGHT))


def _two_decimals(col: Column) -> Column:
    return F.round(col, 2).cast("decimal(28,2)")


def format_inr(col: Column) -> Column:
    """Rupees as crore, lakh or a grouped amount, sign first."""
    amount = F.abs(money(col))
    crore = F.concat(_two_decimals(amount * F.lit("0.0000001").cast("decimal(8,7)")).cast("string"), F.lit(" Cr"))
    lakh = F.concat(_two_decimals(amount * F.lit("0.00001").cast("decimal(6,5)")).cast("string"), F.lit(" L"))
    text = (F.when(amount >= 10_000_000, crore).when(amount >= 100_000, lakh)
            .otherwise(F.format_number(amount, 2)))
    sign = F.when(col < 0, "-").otherwise("")
    return F.when(col.isNull(), F.lit("₹0.00")).otherwise(F.concat(sign, F.lit("₹"), text))


def format_pct(col: Column) -> Column:
    return F.when(col.isNull(), F.lit("0.0%")).otherwise(F.format_string("%.1f%%", F.round(col.cast("double"), 1)))


def format_count(col: Column, noun: str = "") -> Column:
    number = F.format_number(F.rint(F.coalesce(col, F.lit(0)).cast("double")), 0)
    return F.concat_ws(" ", number, F.lit(noun)) if noun else number


def crore(col: Column) -> Column:
    """Amount in crore, two digits, for chart series."""
    return F.round(col / F.lit(1e7), 2)


def date_text(col: Column) -> Column:
    return F.coalesce(F.date_format(col, "yyyy-MM-dd"), F.lit("N/A"))


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any of the words is a substring of the (lower-cased) text."""
    hit = text.contains(words[0])
    for word in words[1:]:
        hit = hit | text.contains(word)
    return hit
