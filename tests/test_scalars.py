import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesloom import contracts as C
from salesloom.functions import periods as PER
from salesloom.functions import predicates as P
from salesloom.functions import scalars as S
from salesloom.functions.answers import first_sentence
from salesloom.operators.executive import explain_metrics


def one(spark, value, kind, fn):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("value,want", [
    (None, "₹0.00"), (0.0, "₹0.00"), (99999.5, "₹99,999.50"), (100000.0, "₹1.00 L"), (12345678.9, "₹1.23 Cr"),
    (-25000000.0, "-₹2.50 Cr"), (-12.345, "-₹12.35"), (688152293.17, "₹68.82 Cr")])
def test_format_inr(spark, value, want):
    assert one(spark, value, "double", S.format_inr) == want


def test_other_formats(spark):
    assert one(spark, 77.31, "double", S.format_pct) == "77.3%"
    assert one(spark, None, "double", S.format_pct) == "0.0%"
    assert one(spark, 1234.5, "double", lambda c: S.format_count(c, "deals")) == "1,234 deals"
    assert one(spark, None, "double", S.format_count) == "0"
    assert one(spark, 12345678.0, "double", S.crore) == 1.23


@pytest.mark.parametrize("day,year,quarter", [
    ("2026-01-15", "FY25-26", "Q4"), ("2025-04-01", "FY25-26", "Q1"), ("2025-03-31", "FY24-25", "Q4"),
    ("1999-12-31", "FY99-00", "Q3"), ("2024-07-31", "FY24-25", "Q2"), (None, None, None)])
def test_fiscal(spark, day, year, quarter):
    cast = lambda fn: (lambda c: fn(c.cast("timestamp_ntz")))
    assert one(spark, day, "string", cast(S.fiscal_year)) == year
    assert one(spark, day, "string", cast(S.fiscal_quarter)) == quarter


@pytest.mark.parametrize("raw,repaired,bucket", [
    (" POWERLINES ", "Powerline", "Powerline"), (None, "Unspecified", "Other"), ("", "Unspecified", "Other"),
    ("solar", "solar", "Renewables"), ("Space", "Space", "Other"), ("gis", "GIS", "Other"), (" ", "", "Other")])
def test_sectors(spark, raw, repaired, bucket):
    assert one(spark, raw, "string", S.repair_sector) == repaired
    assert one(spark, raw, "string", S.canonical_sector) == bucket


def test_sector_alias_both_forms(spark):
    for alias in ("Coal", "grid", "RFP", "unknown thing", "Energy"):
        assert one(spark, alias, "string", S.resolve_sector) == S.resolve_sector_name(alias)


AS_OF = dt.date(2026, 1, 15)


@pytest.mark.parametrize("phrase,label,start,end", [
    ("Q1 FY25", "FY25-26 Q1", "2025-04-01", "2025-06-30"), ("FY24-25", "FY24-25", "2024-04-01", "2025-03-31"),
    ("this quarter", "FY25-26 Q4", "2026-01-01", "2026-03-31"), ("q2 this fy", "FY25-26 Q2", "2025-07-01", "2025-09-30"),
    ("previous quarter", "FY25-26 Q3", "2025-10-01", "2025-12-31"), ("last year", "FY24-25", "2024-04-01", "2025-03-31"),
    ("YTD", "YTD FY25-26", "2025-04-01", "2026-01-15"), ("total", "All Time", None, None), (None, "All Time", None, None),
    ("someday", "someday", None, None), ("fy 2024/2025 q4", "FY24-25 Q4", "2025-01-01", "2025-03-31"),
    ("2025-02-01 to 2025-02-10", "2025-02-01 to 2025-02-10", "2025-02-01", "2025-02-10")])
def test_periods_argument_and_column(spark, phrase, label, start, end):
    p = PER.resolve(phrase, AS_OF)
    text = lambda v: None if v is None else str(v)
    assert (p.label, text(p.start), text(p.end)) == (label, start, end)
    row = PER.resolve_columns(spark.createDataFrame([(phrase,)], "p string"), "p", AS_OF).first()
    assert (row["label"], text(row["start_date"]), text(row["end_date"])) == (label, start, end)
    assert (row["fiscal_year"], row["fiscal_quarter"]) == (p.fiscal_year, p.fiscal_quarter)


def test_explicit_bounds_and_previous_year_quarter():
    assert PER.resolve(None, AS_OF, dt.date(2025, 1, 1), dt.date(2025, 1, 31)).end == dt.date(2025, 1, 31)
    assert PER.resolve("last quarter", dt.date(2025, 5, 1)).label == "FY24-25 Q4"


def test_period_end_includes_the_whole_day(spark):
    df = spark.sql("SELECT timestamp_ntz'2025-06-30 23:59:59' t UNION ALL SELECT timestamp_ntz'2025-07-01 00:00:00'")
    assert df.filter(P.period_filter(PER.resolve("Q1 FY25", AS_OF), "t")).count() == 1


@pytest.mark.parametrize("text,want", [
    ("# Direct Answer\nOpen value is high. More.", "Open value is high."), ("## Answer: Two deals! Yes", "Two deals!"),
    ("**Answer:** Fine", "Fine"), ("", "N/A"), (None, "N/A"), ("no stop " * 30, ("no stop " * 30)[:120].strip()),
    ("### Overview\n\nText here? ok", "Text here?")])
def test_first_sentence(spark, text, want):
    assert one(spark, text, "string", first_sentence) == want


def test_write_guard(spark):
    texts = {"mutation { x }": True, "a MUTATION": True, "permutations": False, None: False}
    for text, want in texts.items():
        assert one(spark, text, "string", P.has_write_keyword) is want


def test_metric_phrases(spark):
    df = spark.createDataFrame([("Open Deals Value",), ("realization",), ("zzz",)], "phrase string")
    assert [r["metric"] for r in explain_metrics(df).collect()] == [
        "open_deals_value", "revenue_realization_rate", next(iter(C.METRICS))]


def test_energy_group_expands_everywhere(spark):
    df = spark.createDataFrame([("Renewables",), ("Powerline",), ("Utilities",)], "sector string")
    assert df.filter(P.sector_filter("Energy")).count() == 2
    assert df.filter(P.sector_filter(None, "energy_group")).count() == 2
    assert df.filter(P.sector_contains("energy")).count() == 2
    assert P.sector_filter(None) is None
