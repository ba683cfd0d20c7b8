"""What a tool returns: named lazy frames, and facts in long form."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from salesloom.functions.scalars import format_count, format_inr, format_pct

FORMATS = {"INR": format_inr, "pct": format_pct, "count": format_count}


@dataclass
class ToolResult:
    tool: str
    facts: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    series: dict[str, DataFrame] = field(default_factory=dict)
    template: str = ""
    accounting: DataFrame | None = None
    arguments: dict = field(default_factory=dict)
    caveats: list[str] = field(default_factory=list)


def fact(number: int, metric: str, label, value: Column, unit: str, *, noun: str = "", display: Column | None = None,
         n: Column | None = None, n_missing: Column | None = None, caveats: Column | list[str] = (),
         must_mention: bool = False, role: str = "support", dimensions: dict[str, str] | None = None) -> Column:
    """One fact over the columns of a one-row frame."""
    if display is None:
        if unit == "text":
            display = value.cast("string")
        else:
            display = format_count(value, noun) if unit == "count" else FORMATS[unit](value)
    if not isinstance(caveats, Column):
        caveats = F.array(*[F.lit(c) for c in caveats]).cast("array<string>")
    pairs = [F.lit(x) for pair in (dimensions or {}).items() for x in pair]
    optional = lambda c: (F.lit(None) if c is None else c).cast("long")
    is_text = unit == "text"
    return F.struct(
        F.lit(f"F{number}").alias("id"),
        F.lit(metric).alias("metric"),
        (label if isinstance(label, Column) else F.lit(label)).alias("label"),
        (F.lit(None) if is_text else value).cast("double").alias("value_double"),
        (value if is_text else F.lit(None)).cast("string").alias("value_string"),
        F.lit(unit).alias("unit"),
        display.alias("display"),
        (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("dimensions"),
        optional(n).alias("n"),
        optional(n_missing).alias("n_missing"),
        caveats.alias("caveat_codes"),
        F.lit(must_mention).alias("must_mention"),
        F.lit(role).alias("role"),
    )


def as_facts(row: DataFrame, facts: list[Column]) -> DataFrame:
    """Facts, one per row, from a one-row frame."""
    return row.select(F.inline(F.array(*facts)))


def caveat_when(cond: Column, code: str) -> Column:
    return F.when(cond, F.array(F.lit(code))).otherwise(F.array().cast("array<string>"))


def accounting(df: DataFrame, used: Column | None, considered: Column | None = None) -> DataFrame:
    """Rows looked at and rows used, counted in one pass."""
    used = F.lit(True) if used is None else F.coalesce(used, F.lit(False))
    base = F.lit(True) if considered is None else F.coalesce(considered, F.lit(False))
    return df.agg(F.count_if(base).alias("considered"), F.count_if(base & used).alias("used"))
