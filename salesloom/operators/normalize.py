"""Turn raw board exports into typed tables, and record what was wrong in the ledger."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from salesloom import contracts as C
from salesloom.functions import scalars as S
from salesloom.functions.predicates import is_blank
from salesloom.operators import ledger as L

DATE_FORMATS = ["MM/dd/yyyy", "dd MMM yyyy", "dd-MMM-yyyy"]


@dataclass(frozen=True)
class Normalized:
    rows: DataFrame
    ledger: DataFrame


def to_number(col: Column) -> Column:
    return S.strip(col.cast("string")).try_cast("double")


def to_date(col: Column) -> Column:
    """Timestamp without zone; text that is no date becomes null."""
    text = S.strip(col.cast("string"))
    formats = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS]
    return F.coalesce(text.try_cast("timestamp_ntz"), *formats)


def as_timestamp(day: dt.date) -> Column:
    return F.lit(day).cast("timestamp_ntz")


def with_known_titles(df: DataFrame, titles: dict[str, str]) -> DataFrame:
    """Rename the known columns, whatever white space surrounds their titles."""
    renames = {c: titles[c.strip()] for c in df.columns if c.strip() in titles}
    return df.withColumnsRenamed(renames)


# ---------------------------------------------------------------- deals

def status_title(df: DataFrame) -> str:
    return next((c for c in df.columns if "status" in c.lower()), "Deal Status")


def is_stray_header(df: DataFrame) -> Column:
    title = status_title(df)
    return F.coalesce(F.lower(S.strip(F.col(f"`{title}`"))) == title.strip().lower(), F.lit(False))


def with_copies(df: DataFrame) -> DataFrame:
    """One row per distinct row and how often it occurred. Copies collapse before the shuffle."""
    return df.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))


def derive_deals(df: DataFrame, as_of: dt.date = C.DEFAULT_AS_OF) -> DataFrame:
    """Columns every deal tool reads, from typed columns."""
    filled = lambda name, default: S.strip(F.coalesce(F.col(name), F.lit(default)))
    weight = S.probability_weight(F.col("closure_probability"))
    fiscal_date = F.coalesce("close_date_actual", "tentative_close_date")
    return df.withColumns({
        "deal_name": S.strip(F.col("deal_alias")),
        "owner_code": filled("owner_id", "UNASSIGNED"),
        "client_code": filled("client_id", "UNKNOWN_CLIENT"),
        "deal_status": filled("status", "Unknown"),
        "deal_stage": filled("stage_raw", "Unknown"),
        "sector": S.repair_sector(F.col("sector_raw")),
        "value_is_missing": F.col("deal_value").isNull(),
        "deal_value": F.coalesce("deal_value", F.lit(0.0)),
        "close_date": F.col("close_date_actual"),
        "prob_weight": weight.cast("double"),
        "weighted_deal_value": F.coalesce("deal_value", F.lit(0.0)) * weight.cast("double"),
        "fiscal_year": S.fiscal_year(fiscal_date),
        "fiscal_quarter": S.fiscal_quarter(fiscal_date),
        "is_stale": F.coalesce((F.col("status") == "Open") & (F.col("tentative_close_date") < as_timestamp(as_of)),
                               F.lit(False)),
        "join_key": S.strip(F.lower(S.strip(F.col("deal_alias")))),
    })


def deal_rules() -> dict[str, Column]:
    """Rules checked row by row on clean deals."""
    return {
        "DQ003": F.col("value_is_missing"),
        "DQ004": is_blank(F.col("owner_id")) | is_blank(F.col("client_id")),
        "DQ005": F.col("is_stale"),
        "DQ006": (F.col("status") == "Won") & F.col("stage_raw").startswith("A."),
        "DQ007": (F.col("status") == "Open") & (F.col("sector") == C.OUTLIER_SECTOR),
    }


SAMPLED_DEAL_RULES = ["DQ005", "DQ006"]


def typed_deals(distinct: DataFrame) -> DataFrame:
    named = with_known_titles(distinct, C.DEAL_COLUMNS)
    return named.withColumns({"deal_value": to_number(F.col("deal_value")),
                              **{c: to_date(F.col(c)) for c in C.DEAL_DATES}})


def as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def normalize_deals(sheet: DataFrame, as_of: dt.date = C.DEFAULT_AS_OF, keep=as_is) -> Normalized:
    """Raw deals export to clean deals and rules DQ001-DQ007.

    Copies collapse in one aggregation that also counts them, and all rules are counted in a single pass. With
    keep=session.stored the rows, stray headers among them, are written once: the export is read for that alone, and
    the ledger takes counts and samples from two scans of the few columns it needs.
    """
    first = F.col(f"`{sheet.columns[0]}`")
    counted = with_copies(sheet)
    counted = counted.withColumns({"_header": is_stray_header(counted), "_first": first})
    every = keep(derive_deals(typed_deals(counted), as_of), "clean-deals")
    header = F.col("_header")

    is_open = (F.col("status") == "Open") & ~header
    largest = F.max_by(F.when(~header, F.struct("deal_alias", "deal_value")), F.when(~header, F.struct("deal_value", "deal_alias")))
    rules = {code: cond & ~header for code, cond in deal_rules().items()}
    totals = every.agg(
        F.coalesce(F.sum(F.when(header, F.col("_copies"))), F.lit(0)).alias("DQ001"),
        F.coalesce(F.sum(F.when(~header, F.col("_copies") - 1)), F.lit(0)).alias("DQ002"),
        *[S.count_if(cond).alias(code) for code, cond in rules.items()],
        S.money_sum_if(is_open & (F.col("sector") == C.OUTLIER_SECTOR), F.col("deal_value")).alias("outlier_value"),
        S.money_sum_if(is_open, F.col("deal_value")).alias("open_value"),
        largest.alias("largest"),
    )
    totals = keep(totals, "deal-totals")  # one row, read by several parts of the ledger
    counts = L.counts_to_rows(totals, ["DQ001", "DQ002", *rules])

    samples = L.rule_samples(every, {"DQ001": header, "DQ002": (F.col("_copies") > 1) & ~header,
                                     **{c: rules[c] for c in SAMPLED_DEAL_RULES}},
                             F.when(header, F.col("_first")).otherwise(F.col("deal_alias")), {"DQ001": F.col("_copies")})
    biggest = totals.filter(F.col("largest").isNotNull()).select(
        F.lit("DQ007").alias("code"), F.array("largest.deal_alias").alias("sample_identifiers"))
    samples = samples.unionByName(biggest)

    share = S.percent(F.col("outlier_value"), F.col("open_value"))
    described = totals.select(F.inline(F.array(
        F.struct(F.lit("DQ005").alias("code"),
                 F.lit(f"Open deals whose tentative close date is before as-of date ({as_of}).")
                 .alias("found_description")),
        F.struct(F.lit("DQ007").alias("code"), F.concat(
            F.lit("Tender sector represents "), S.format_pct(share), F.lit(" of open pipeline. Largest deal "),
            F.coalesce(F.col("largest.deal_alias"), F.lit("")), F.lit(" = "),
            S.format_inr(F.coalesce(F.col("largest.deal_value"), F.lit(0.0))), F.lit("."))
            .alias("found_description")))))
    rows = every.filter(~header).drop("_copies", "_header", "_first")
    return Normalized(rows, L.build_ledger(counts, samples, described))


# ---------------------------------------------------------------- work orders

def derive_orders(df: DataFrame, as_of: dt.date = C.DEFAULT_AS_OF) -> DataFrame:
    """Columns every work-order tool reads, from typed columns."""
    filled = lambda name, default: S.strip(F.coalesce(F.col(name), F.lit(default)))
    present = [c for c in C.ORDER_MONEY if c in df.columns]
    fiscal_date = F.coalesce("po_date", "start_date")
    status = filled("execution_status", "Unknown")
    standard = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(x) for pair in C.EXECUTION_SPELLINGS.items() for x in pair]), status), status)
    billing = F.when(F.col("billing_status") == "BIlled", "Billed").otherwise(
        F.coalesce("billing_status", F.lit("Not Specified")))
    completed = F.coalesce(F.lower("execution_status") == "completed", F.lit(False))
    alias = filled("deal_alias", "UNKNOWN_WO")
    return df.withColumns({
        "deal_name": alias,
        "client_code": filled("client_id", "UNKNOWN_CLIENT"),
        "owner_code": filled("owner_id", "UNASSIGNED"),
        "sector": S.repair_sector(F.col("sector_raw")),
        "billed_is_missing": F.col("billed_excl_gst").isNull(),
        "billing_is_misspelt": F.coalesce(S.strip(F.col("billing_status")) == "BIlled", F.lit(False)),
        "is_completed": completed,
        "is_overdue": ~completed & F.coalesce(F.col("end_date") < as_timestamp(as_of), F.lit(False)),
        **{c: F.coalesce(c, F.lit(0.0)) for c in present},
        "billing_status": billing,
        "execution_status": standard,
        "fiscal_year": S.fiscal_year(fiscal_date),
        "fiscal_quarter": S.fiscal_quarter(fiscal_date),
        "join_key": S.strip(F.lower(alias)),
    })


def order_rules() -> dict[str, Column]:
    return {
        "DQ009": F.col("receivable_amount") < 0,
        "DQ010": F.col("is_completed") & F.col("data_delivery_date").isNull(),
        "DQ011": F.col("is_overdue"),
        "DQ013": F.col("billing_is_misspelt"),
        "DQ014": F.col("billed_is_missing"),
        "DQ015": F.lit(True),
        "DQ016": F.lit(True),
    }


#: What the rules of both boards read of clean rows, besides the helpers that begin with an underscore.
RULE_COLUMNS = {"deal_alias", "status", "sector", "deal_value", "value_is_missing", "owner_id", "client_id", "is_stale", "stage_raw",
                "receivable_amount", "is_completed", "data_delivery_date", "is_overdue", "billing_is_misspelt", "billed_is_missing"}
SAMPLED_ORDER_RULES = ["DQ009", "DQ010", "DQ011"]


def order_titles(sheet: DataFrame) -> DataFrame:
    """Stable column names; columns the export lacks are added as nulls, so the schema never depends on the data."""
    import re
    named = with_known_titles(sheet, C.ORDER_COLUMNS)
    vendor = [c for c in named.columns if re.match(C.SOFTWARE_COLUMN_PATTERN, c.strip())]
    named = named.withColumnsRenamed({c: C.SOFTWARE_COLUMN for c in vendor[:1]})
    wanted = [*C.ORDER_COLUMNS.values(), C.SOFTWARE_COLUMN]
    missing = {c: F.lit(None).cast("string") for c in wanted if c not in named.columns}
    return named.withColumns(missing) if missing else named


def typed_orders(sheet: DataFrame) -> DataFrame:
    named = order_titles(sheet)
    return named.withColumns({**{c: to_number(F.col(c)) for c in C.ORDER_MONEY},
                              **{c: to_date(F.col(c)) for c in C.ORDER_DATES}})


def empty_columns(sheet: DataFrame) -> DataFrame:
    """Titles of columns without a single value, found in one pass: (title, is_empty)."""
    filled = sheet.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(sheet.columns)])
    return filled.select(F.inline(F.array(*[
        F.struct(F.lit(c.strip()).alias("title"), (F.col(f"c{i}") == 0).alias("is_empty"))
        for i, c in enumerate(sheet.columns)])))


def normalize_orders(sheet: DataFrame, as_of: dt.date = C.DEFAULT_AS_OF, keep=as_is) -> Normalized:
    """Raw work-order export to clean work orders and rules DQ008-DQ016; keep as for deals."""
    marked = sheet.withColumns({f"_filled{i}": bits for i, bits in enumerate(filled_bits(sheet))})
    every = keep(derive_orders(typed_orders(marked), as_of), "clean-orders")
    rules = order_rules()
    marks = [c for c in every.columns if c.startswith("_filled")]
    totals = every.agg(*[S.count_if(cond).alias(code) for code, cond in rules.items()],
                       *[F.coalesce(F.bit_or(c), F.lit(0)).alias(c) for c in marks])
    totals = keep(totals, "order-totals")
    empty = totals.select(F.inline(F.array(*[
        F.struct(F.lit(c.strip()).alias("title"), (bit_of(i) == 0).alias("is_empty")) for i, c in enumerate(sheet.columns)]))).filter("is_empty")
    counts = L.counts_to_rows(totals, list(rules)).unionByName(
        empty.agg(F.count(F.lit(1)).alias("affected_count")).select(F.lit("DQ008").alias("code"), "affected_count"))
    samples = L.rule_samples(every, {c: rules[c] for c in SAMPLED_ORDER_RULES}, F.col("deal_alias")).unionByName(
        empty.agg(F.array_sort(F.collect_list("title")).alias("sample_identifiers"))
        .select(F.lit("DQ008").alias("code"), "sample_identifiers"))
    return Normalized(every.drop(*marks), L.build_ledger(counts, samples))


#: Columns whose presence is told by the bits of one number.
MARKED = 62


def filled_bits(sheet: DataFrame) -> list[Column]:
    """Numbers whose bits tell which columns of a row have a value, so that one aggregate finds the empty ones."""
    bits = [F.when(F.col(f"`{c}`").isNotNull(), F.lit(1 << (i % MARKED))).otherwise(0).cast("long") for i, c in enumerate(sheet.columns)]
    return [reduce(lambda x, y: x.bitwiseOR(y), bits[i:i + MARKED]) for i in range(0, len(bits), MARKED)]


def bit_of(column: int) -> Column:
    return F.shiftright(f"_filled{column // MARKED}", column % MARKED).bitwiseAND(F.lit(1))


def drop_empty_columns(rows: DataFrame, empty_titles: list[str]) -> DataFrame:
    """Drop the reported columns, on request only."""
    return rows.drop(*[C.ORDER_COLUMNS.get(t, t) for t in empty_titles])


def full_ledger(deals: Normalized, orders: Normalized) -> DataFrame:
    return deals.ledger.unionByName(orders.ledger)
