"""Data-quality tools over the ledger and the boards."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from salesloom import contracts as C
from salesloom.functions import predicates as P
from salesloom.functions import scalars as S
from salesloom.operators import deals as D
from salesloom.operators.ledger import export_view
from salesloom.operators.normalize import is_stray_header, with_copies
from salesloom.operators.results import ToolResult, as_facts, fact

STALE_TYPES = ["stale_open_deals", "stale_deals", "stale"]


def as_frame(ledger) -> DataFrame:
    """A ledger may come as a function, called only where it is read."""
    return ledger() if callable(ledger) else ledger


def scorecard(ledger, board=None, severity=None, code=None) -> DataFrame:
    return P.keep(as_frame(ledger), P.ledger_filter(board, code, severity)).select(
        "code", P.board_of_rule(F.col("code")).alias("board"), "rule_name", "severity", "affected_count",
        "description", "resolution")


def ledger_totals(card: DataFrame) -> DataFrame:
    level = F.upper("severity")
    return card.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        S.count_if(level == "HIGH").alias("high_severity"),
        S.count_if(level == "MEDIUM").alias("medium_severity"),
        S.count_if(~level.isin("HIGH", "MEDIUM")).alias("other_severity"),
        F.coalesce(F.sum("affected_count"), F.lit(0)).alias("total_affected"))


def data_quality_report(ledger: DataFrame, board=None, severity=None) -> ToolResult:
    card = scorecard(ledger, board, severity)
    totals = ledger_totals(card)
    facts = as_facts(totals, [
        fact(1, "total_anomalies", "Total Data Quality Anomalies", F.col("total_anomalies"), "count",
             display=F.concat(S.format_count(F.col("total_anomalies"), "anomalies"), F.lit(" ("),
                              S.format_count(F.col("total_affected"), "rows affected"), F.lit(")")),
             must_mention=True, role="primary"),
        fact(2, "high_severity_dq_count", "High Severity Hygiene Anomalies", F.col("high_severity"), "count",
             noun="high severity", must_mention=True),
        fact(3, "total_affected_rows", "Cumulative Rows Affected", F.col("total_affected"), "count", noun="rows"),
    ])
    donut = totals.select(F.expr(
        "stack(3, 'High Severity', high_severity, 'Medium Severity', medium_severity, 'Low / Info', other_severity)"
        " AS (slice, value)"))
    return ToolResult("data_quality_report", facts, {"t_dq_scorecard": card.orderBy("code")},
                      {"chart_dq_severity": donut}, "[[F1]], of which [[F2]], touch [[F3]].", None,
                      {"board": board, "severity": severity})


def data_debt_list(deals: DataFrame, ledger: DataFrame, board=None, issue_code=None, severity=None, type=None,
                   limit: int = 50, format: str = "json") -> ToolResult:
    if type and type.strip().lower() in STALE_TYPES:
        facts = as_facts(D.stale_totals(deals), [
            fact(1, "stale_deals_count", "Stale Open Deals (DQ005)", F.col("stale_count"), "count",
                 noun="stale deals", caveats=["DQ005"], must_mention=True, role="primary"),
            fact(2, "stale_deals_value", "Stale Pipeline Value", F.col("stale_value"), "INR", caveats=["DQ005"]),
        ])
        rows = D.stale_deals(deals).orderBy(F.desc("deal_value"), "deal_alias").limit(limit)
        return ToolResult("data_debt_list", facts, {"t_stale_deals": rows}, {},
                          "[[F1]] lock [[F2]].", None, {"type": type, "limit": limit}, ["DQ005"])
    card = scorecard(ledger, board, severity, issue_code)
    facts = as_facts(card.agg(F.count(F.lit(1)).alias("issues")), [
        fact(1, "debt_issues_count", "Data Debt Issues Listed", F.col("issues"), "count", noun="issues",
             must_mention=True, role="primary")])
    listed = card.orderBy("code").limit(limit)
    tables = {"t_data_debt": listed}
    if format == "csv":
        tables["csv_rows"] = csv_lines(listed)
    return ToolResult("data_debt_list", facts, tables, {}, "[[F1]] need attention.", None,
                      {"board": board, "issue_code": issue_code, "severity": severity, "limit": limit})


def csv_lines(listed: DataFrame) -> DataFrame:
    """The listed issues as CSV text lines."""
    columns = ["code", "board", "rule_name", "severity", "affected_count", "resolution"]
    return listed.select(F.to_csv(F.struct(*columns)).alias("line"))


def quality_summary(deals: DataFrame, ledger: DataFrame) -> DataFrame:
    """Share of deals without value, total anomalies and the row of every rule."""
    total = deals.agg(F.count(F.lit(1)).alias("deals"))
    sums = ledger.agg(F.coalesce(F.sum("affected_count"), F.lit(0)).alias("total_anomalies"),
                      F.coalesce(F.sum(F.when(F.col("code") == "DQ003", F.col("affected_count"))), F.lit(0))
                      .alias("no_value"))
    share = S.percent(F.col("no_value"), F.col("deals"))
    head = sums.crossJoin(total).select(
        "total_anomalies", share.alias("no_value_pct"),
        F.concat(S.format_pct(share), F.lit(" ("), F.col("no_value").cast("string"), F.lit(" deals)"))
        .alias("share_of_deals_with_no_value"))
    return ledger.select("code", F.col("rule_name").alias("name"), F.col("affected_count").alias("count"),
                         F.lower("severity").alias("severity")).crossJoin(F.broadcast(head))


# ---------------------------------------------------------------- record-level debt

def debt_records(deals: DataFrame, orders: DataFrame) -> DataFrame:
    """Every record that needs repair, by three rules."""
    amount = F.format_number(S.money(F.col("amount_excl_gst")), 2)

    def debt(cond: Column, prefix: str, category: str, text: Column, action: str) -> Column:
        return F.when(cond, F.struct(
            F.concat(F.lit(prefix), serial).alias("id"), F.lit("work_order").alias("type"),
            F.col("deal_alias").alias("entity_name"), F.col("owner_id").alias("owner"), "sector",
            F.lit(category).alias("issue_category"), F.lit("High").alias("severity"), text.alias("description"),
            F.lit(action).alias("recommended_action")))

    serial = F.coalesce("serial_no", "deal_alias")
    update = debt(F.col("billing_status") == "Update Required", "WO-", "Billing Status 'Update Required'",
                  F.concat(F.lit("Order "), serial, F.lit(" needs a billing update. Contracted: ₹"), amount),
                  "Check the deliverables with operations and raise the pending invoice")
    unbilled = debt(P.is_completed_unbilled(), "WO-UNBILLED-", "Unbilled Completed Project",
                    F.concat(F.lit("Completed, but ₹"), amount, F.lit(" is not billed")), "Raise the tax invoice")
    # Both rules in one pass over the orders: an order may need either, both or neither.
    of_orders = orders.select(F.inline(F.array_compact(F.array(update, unbilled))))
    zero = deals.filter((F.coalesce("deal_value", F.lit(0.0)) == 0) & F.expr(D.IS_OPEN)).select(
        F.concat(F.lit("DEAL-ZERO-"), "deal_alias").alias("id"), F.lit("deal").alias("type"),
        F.col("deal_alias").alias("entity_name"), F.col("owner_id").alias("owner"), "sector",
        F.lit("Missing Deal Value in Pipeline").alias("issue_category"), F.lit("Medium").alias("severity"),
        F.concat(F.lit("Open deal in stage '"), "deal_stage", F.lit("' has no value")).alias("description"),
        F.lit("Add an estimated value").alias("recommended_action"))
    return of_orders.unionByName(zero)


def debt_severity(records: DataFrame) -> DataFrame:
    return records.groupBy("severity").agg(F.count(F.lit(1)).alias("records"))


# ---------------------------------------------------------------- profiles

def profile_deals(sheet: DataFrame, clean: DataFrame) -> DataFrame:
    """Raw, header, duplicate and clean counts with the main board figures."""
    header = is_stray_header(sheet)
    raw = sheet.agg(F.count(F.lit(1)).alias("raw_rows"), S.count_if(header).alias("stray_headers"))
    copies = with_copies(sheet.filter(~header)).agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"),
        F.count(F.lit(1)).alias("cleaned_rows"))
    is_open, won, value = F.expr(D.IS_OPEN), F.col("status") == "Won", F.col("deal_value")
    known = ~F.col("value_is_missing")
    tender = is_open & (F.col("sector") == C.OUTLIER_SECTOR)
    energy = is_open & S.is_energy_sector(F.col("sector"))
    largest = F.max_by(F.struct("deal_alias", "deal_value"),
                       F.when(is_open & known, F.struct("deal_value", "deal_alias")))
    board = clean.agg(
        S.count_if(is_open).alias("open_count"), S.count_if(is_open & known).alias("open_known_value_count"),
        S.money_sum_if(is_open, value).alias("open_known_value_sum"), S.count_if(tender).alias("tender_open_count"),
        S.money_sum_if(tender, value).alias("tender_open_value"), S.count_if(won).alias("won_count"),
        S.count_if(won & known).alias("won_known_value_count"), S.money_sum_if(won, value).alias("won_known_value_sum"),
        S.count_if(won & F.col("stage_raw").startswith("A.")).alias("won_stage_a_count"),
        S.count_if(energy).alias("energy_open_count"), S.money_sum_if(energy, value).alias("energy_open_value"),
        S.count_if(F.col("is_stale")).alias("stale_open_count"), largest.alias("largest"))
    row = raw.crossJoin(copies).crossJoin(board)
    return row.withColumns({
        "tender_share_pct": S.percent(F.col("tender_open_value"), F.col("open_known_value_sum")),
        "open_excl_tender_value": F.round(F.col("open_known_value_sum") - F.col("tender_open_value"), 2),
        "max_deal_alias": F.col("largest.deal_alias"), "max_deal_value": F.col("largest.deal_value"),
    }).drop("largest")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per value of each column, nulls included, in one pass."""
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])))
    return pairs.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows"))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column in one pass."""
    totals = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(c.strip()).alias("column_name"), F.col(f"c{i}").alias("nulls"))
        for i, c in enumerate(df.columns)])))


def profile_orders(orders: DataFrame) -> DataFrame:
    due = F.col("receivable_amount")
    return orders.agg(
        F.count(F.lit(1)).alias("raw_rows"), S.money_sum(F.col("amount_excl_gst")).alias("total_contract_value"),
        S.money_sum(due).alias("total_receivable"), S.count_if(due < 0).alias("negative_receivable_count"),
        S.count_if(F.col("billed_is_missing")).alias("billed_excl_null_count"),
        S.count_if((F.col("execution_status") == "Completed") & F.col("data_delivery_date").isNull())
        .alias("completed_missing_delivery"))


def exported(ledger: DataFrame) -> DataFrame:
    return export_view(ledger)
