"""Row filters shared by the tools. Each returns a column, or None when nothing is asked for."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from salesloom import contracts as C
from salesloom.functions.scalars import resolve_sector_name, strip
from salesloom.functions.periods import Period


def sector_filter(sector: str | None, sector_group: str | None = None, column: str = "sector") -> Column | None:
    """Sector equality after alias resolution, with the energy group expanded."""
    if sector and sector.strip().lower() in C.ENERGY_GROUP_NAMES:
        sector, sector_group = None, "energy"
    if sector:
        return F.lower(F.col(column)) == resolve_sector_name(sector).lower()
    if sector_group and sector_group.strip().lower() in C.ENERGY_GROUP_NAMES:
        return F.col(column).isin(C.ENERGY_SECTORS)
    return None


def sector_contains(sector: str | None, column: str = "sector") -> Column | None:
    """Sector contains the given words, any case; the energy group is expanded."""
    if not sector:
        return None
    if sector.strip().lower() in C.ENERGY_GROUP_NAMES:
        return F.col(column).isin(C.ENERGY_SECTORS)
    return F.lower(F.col(column)).contains(resolve_sector_name(sector).lower())


def period_filter(period: Period, column: str) -> Column | None:
    """Both days of the period included, whatever the time of day."""
    if period.start is None:
        return None
    day_after = period.end + dt.timedelta(days=1)
    return ((F.col(column) >= F.lit(period.start).cast("timestamp_ntz"))
            & (F.col(column) < F.lit(day_after).cast("timestamp_ntz")))


def without_outliers() -> Column:
    return F.col("sector") != C.OUTLIER_SECTOR


def is_completed_unbilled() -> Column:
    return ((F.col("execution_status") == "Completed")
            & (F.coalesce(F.col("billed_excl_gst"), F.lit(0.0)) == 0)
            & (F.col("amount_excl_gst") > 0))


def is_delayed(as_of: dt.date) -> Column:
    return ((F.col("end_date") < F.lit(as_of).cast("timestamp_ntz"))
            & ~F.col("execution_status").isin(C.NOT_DELAYED_STATUSES))


def board_of_rule(code: Column) -> Column:
    number = F.try_to_number(F.substring(code, 3, 3), F.lit("999")).cast("int")
    return F.when(number <= C.LAST_DEALS_RULE, "deals").otherwise("work_orders")


def ledger_filter(board: str | None = None, code: str | None = None, severity: str | None = None) -> Column | None:
    parts = []
    if board and board.lower() != "all":
        parts.append(board_of_rule(F.col("code")) == board.lower())
    if code:
        parts.append(F.upper("code") == code.upper())
    if severity:
        parts.append(F.upper("severity") == severity.upper())
    return all_of(*parts)


def has_write_keyword(text: Column) -> Column:
    """Read-only guard: the whole word 'mutation', any case."""
    return F.coalesce(text.rlike(r"(?i)\bmutation\b"), F.lit(False))


def is_blank(col: Column) -> Column:
    return F.coalesce(strip(col), F.lit("")) == ""


def all_of(*conditions: Column | None) -> Column | None:
    """AND of the conditions that were asked for."""
    wanted = [c for c in conditions if c is not None]
    if not wanted:
        return None
    total = wanted[0]
    for c in wanted[1:]:
        total = total & c
    return total


def keep(df, *conditions: Column | None):
    cond = all_of(*conditions)
    return df if cond is None else df.filter(cond)
