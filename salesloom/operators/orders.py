"""Work-order tools: revenue ladder, receivables, execution health."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from salesloom import contracts as C
from salesloom.functions import predicates as P
from salesloom.functions import scalars as S
from salesloom.functions.periods import resolve
from salesloom.operators.results import ToolResult, accounting, as_facts, caveat_when, fact

ONGOING_WORDS = ["ongoing", "active", "in-progress", "in progress"]


# ---------------------------------------------------------------- revenue ladder

def won_bookings(deals: DataFrame, sector=None, period=None, as_of: dt.date = C.DEFAULT_AS_OF) -> DataFrame:
    scope = P.keep(deals, F.col("status") == "Won", P.sector_filter(sector),
                   P.period_filter(resolve(period, as_of), "close_date_actual"))
    return scope.agg(S.money_sum(F.col("deal_value")).alias("won_value"), F.count(F.lit(1)).alias("won_count"))


def order_condition(sector=None, period=None, column="po_date", as_of: dt.date = C.DEFAULT_AS_OF) -> Column | None:
    return P.all_of(P.period_filter(resolve(period, as_of), column), P.sector_filter(sector))


def order_money(orders: DataFrame) -> DataFrame:
    """All ladder sums of the filtered orders in one pass."""
    credit = F.col("receivable_amount") < 0
    total = lambda c: S.money_sum(F.col(c)).alias(c)
    return orders.agg(
        F.count(F.lit(1)).alias("wo_count"), total("amount_excl_gst"), total("billed_excl_gst"),
        total("billed_incl_gst"), total("collected_incl_gst"), total("receivable_amount"),
        total("to_be_billed_excl_gst"), S.count_if(credit).alias("neg_receivable_count"),
        S.money_sum_if(credit, F.col("receivable_amount")).alias("neg_receivable_sum"))


def ladder(deals: DataFrame, orders: DataFrame, sector=None, period=None,
           as_of: dt.date = C.DEFAULT_AS_OF) -> DataFrame:
    """Bookings to cash as one row. Both sides are single-row aggregates."""
    scope = P.keep(orders, order_condition(sector, period, as_of=as_of))
    row = won_bookings(deals, sector, period, as_of).crossJoin(order_money(scope))
    contracted, billed, collected = (F.col(c) for c in ("amount_excl_gst", "billed_excl_gst", "collected_incl_gst"))
    rate = F.when(F.col("billed_incl_gst") > 0, collected / F.col("billed_incl_gst") * 100) \
        .when(billed > 0, collected / billed * 100).otherwise(0.0)
    return row.withColumns({
        "realization_rate_pct": S.percent(billed, contracted),
        "collection_rate_pct": F.round(rate, 4),
        "unbilled_backlog": F.round(F.greatest(contracted - billed, F.lit(0.0)), 2),
    })


def ladder_stages(row: DataFrame) -> DataFrame:
    """The ladder in long form."""
    stages = [("1. Won Deal Bookings", "won_value"), ("2. Contracted Work Orders", "amount_excl_gst"),
              ("3. Invoiced Billed Value", "billed_excl_gst"), ("4. Cash Collected", "collected_incl_gst"),
              ("5. Net Accounts Receivable", "receivable_amount"), ("6. Unbilled Backlog", "unbilled_backlog")]
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("stage"), F.col(c).alias("amount"), S.format_inr(F.col(c)).alias("display"))
        for name, c in stages])))


def ladder_series(row: DataFrame) -> DataFrame:
    bars = [("Contracted", "amount_excl_gst"), ("Billed", "billed_excl_gst"), ("Collected", "collected_incl_gst"),
            ("Receivable", "receivable_amount"), ("Unbilled", "unbilled_backlog")]
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("bar"), S.crore(F.col(c)).alias("value_cr"))
        for i, (name, c) in enumerate(bars, 1)])))


def revenue_ladder(deals: DataFrame, orders: DataFrame, sector=None, period=None,
                   as_of: dt.date = C.DEFAULT_AS_OF) -> ToolResult:
    row = ladder(deals, orders, sector, period, as_of)
    facts = as_facts(row, [
        fact(1, "billed_work_orders", "Billed Work Orders", F.col("billed_excl_gst"), "INR", n=F.col("wo_count"),
             must_mention=True, role="primary"),
        fact(2, "wo_contracted_value", "Work Orders Contracted", F.col("amount_excl_gst"), "INR",
             n=F.col("wo_count"), must_mention=True),
        fact(3, "realization_rate_pct", "Revenue Realization Rate", F.round("realization_rate_pct", 1), "pct"),
        fact(4, "wo_collected_value", "Collected Cash Receipts (Incl GST)", F.col("collected_incl_gst"), "INR",
             must_mention=True),
        fact(5, "wo_receivable_value", "Net Accounts Receivable", F.col("receivable_amount"), "INR",
             caveats=caveat_when(F.col("neg_receivable_count") > 0, "DQ009"), must_mention=True),
        fact(6, "unbilled_backlog", "Unbilled Backlog (Excl GST)", F.col("unbilled_backlog"), "INR"),
        fact(7, "won_deal_value", "Won Deals Value (Bookings)", F.col("won_value"), "INR", n=F.col("won_count")),
    ])
    return ToolResult("revenue_ladder", facts, {"t_revenue_ladder": ladder_stages(row)},
                      {"chart_revenue_waterfall": ladder_series(row)},
                      "[[F1]] is billed against [[F2]] contracted ([[F3]]); [[F4]] is collected and [[F5]] is due.",
                      accounting(orders, order_condition(sector, period, as_of=as_of)),
                      {"sector": sector, "period": period}, ["DQ009"])


def legacy_realization(deals: DataFrame, orders: DataFrame, sector=None) -> DataFrame:
    row = ladder(deals, orders, sector)
    return row.select(
        F.col("wo_count").alias("total_work_orders"),
        F.col("amount_excl_gst").alias("contracted_amount_excl_gst"),
        F.col("billed_excl_gst").alias("billed_amount_excl_gst"),
        F.col("collected_incl_gst").alias("collected_amount_incl_gst"),
        F.col("unbilled_backlog").alias("unbilled_backlog_excl_gst"),
        F.col("receivable_amount").alias("outstanding_receivables"),
        F.round("realization_rate_pct", 2).alias("realization_rate_pct"),
        S.percent(F.col("collected_incl_gst"), F.col("billed_incl_gst"), 2).alias("collection_efficiency_pct"))


# ---------------------------------------------------------------- receivables

def receivable_totals(orders: DataFrame) -> DataFrame:
    due = F.col("receivable_amount")
    return orders.agg(
        F.count(F.lit(1)).alias("total_wo"),
        S.money_sum(due).alias("total_receivable"),
        S.money_sum(F.col("collected_incl_gst")).alias("total_collected"),
        S.money_sum(F.col("billed_excl_gst")).alias("total_billed"),
        S.count_if(due > 0).alias("positive_debtors_count"),
        S.money_sum_if(due > 0, due).alias("positive_debtors_sum"),
        S.count_if(due < 0).alias("credit_notes_count"),
        S.money_sum_if(due < 0, due).alias("credit_notes_sum"))


def top_debtors(orders: DataFrame, n: int = 10) -> DataFrame:
    return (orders.filter(F.col("receivable_amount") > 0).groupBy("client_id", "sector")
            .agg(F.count(F.lit(1)).alias("wo_count"), S.money_sum(F.col("receivable_amount")).alias("total_receivable"),
                 S.money_sum(F.col("billed_excl_gst")).alias("billed_val"))
            .orderBy(F.desc("total_receivable"), "client_id", "sector").limit(n))


def receivables_summary(orders: DataFrame, sector=None, top_n: int = 10, metric: str | None = None) -> ToolResult:
    condition = P.sector_filter(sector)
    scope = P.keep(orders, condition)
    totals = receivable_totals(scope)
    if metric == "collected_cash":
        facts = as_facts(totals, [
            fact(1, "collected_cash", "Collected Cash Receipts (Incl GST)", F.col("total_collected"), "INR",
                 n=F.col("total_wo"), must_mention=True, role="primary"),
            fact(2, "total_billed_value", "Total Invoiced / Billed Value", F.col("total_billed"), "INR"),
            fact(3, "outstanding_receivables", "Outstanding Net Receivables", F.col("total_receivable"), "INR"),
        ])
        template = "[[F1]] is collected against [[F2]] billed, which leaves [[F3]] due."
    else:
        facts = as_facts(totals, [
            fact(1, "wo_receivable_value", "Outstanding Net Receivables", F.col("total_receivable"), "INR",
                 must_mention=True, role="primary"),
            fact(2, "credit_notes_count", "Credit Balance Work Orders (DQ009)", F.col("credit_notes_count"), "count",
                 noun="credits", caveats=["DQ009"], role="caveat"),
            fact(3, "gross_receivable_positive", "Gross Positive Receivables", F.col("positive_debtors_sum"), "INR"),
            fact(4, "outstanding_receivables", "Outstanding Net Receivables", F.col("total_receivable"), "INR"),
        ])
        template = "Net receivables are [[F1]]: [[F3]] gross, less [[F2]] with a credit balance."
    return ToolResult("receivables_summary", facts, {"t_debtors": top_debtors(scope, top_n)}, {}, template,
                      accounting(orders, condition), {"sector": sector, "top_n": top_n, "metric": metric}, ["DQ009"])


# ---------------------------------------------------------------- execution health

def health_condition(sector=None, status=None, period=None, as_of: dt.date = C.DEFAULT_AS_OF) -> Column | None:
    wanted = (status or "").strip().lower()
    extra = P.is_completed_unbilled() if wanted == "completed_unbilled" else (
        P.is_delayed(as_of) if wanted == "delayed" else None)
    return P.all_of(order_condition(sector, period, "start_date", as_of), extra)


def execution_breakdown(orders: DataFrame) -> DataFrame:
    return (orders.groupBy("execution_status")
            .agg(F.count(F.lit(1)).alias("count"), S.money_sum(F.col("amount_excl_gst")).alias("contracted_val"),
                 S.money_sum(F.col("billed_excl_gst")).alias("billed_val"),
                 S.money_sum(F.col("to_be_billed_excl_gst")).alias("unbilled_val"))
            .orderBy(F.desc("count"), "execution_status"))


def health_totals(orders: DataFrame, as_of: dt.date = C.DEFAULT_AS_OF) -> DataFrame:
    """Full counts, taken before any row limit."""
    amount = F.col("amount_excl_gst")
    ongoing = F.lower("execution_status").contains("ongoing")
    totals = orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        S.count_if(F.col("execution_status") == "Completed").alias("completed_count"),
        S.count_if(P.is_delayed(as_of)).alias("delayed_count"),
        S.money_sum_if(P.is_delayed(as_of), amount).alias("delayed_value"),
        S.count_if(P.is_completed_unbilled()).alias("completed_unbilled_count"),
        S.money_sum_if(P.is_completed_unbilled(), amount).alias("completed_unbilled_value"),
        S.count_if(ongoing).alias("ongoing_count"),
        S.money_sum_if(ongoing, amount).alias("ongoing_value"))
    return totals.withColumn("completion_rate_pct", S.percent(F.col("completed_count"), F.col("total_orders")))


def delayed_orders(orders: DataFrame, as_of: dt.date = C.DEFAULT_AS_OF, n: int = 10) -> DataFrame:
    return (orders.filter(P.is_delayed(as_of))
            .select("deal_alias", "serial_no", "client_id", "sector", "execution_status",
                    S.date_text(F.col("end_date")).alias("end_date"), "amount_excl_gst", "to_be_billed_excl_gst")
            .orderBy(F.desc("amount_excl_gst"), "serial_no").limit(n))


def completed_unbilled_orders(orders: DataFrame, n: int = 10) -> DataFrame:
    return (orders.filter(P.is_completed_unbilled())
            .select("deal_alias", "serial_no", "client_id", "sector", "amount_excl_gst")
            .orderBy(F.desc("amount_excl_gst"), "serial_no").limit(n))


def billing_breakdown(orders: DataFrame) -> DataFrame:
    return (orders.groupBy("billing_status")
            .agg(F.count(F.lit(1)).alias("count"), S.money_sum(F.col("amount_excl_gst")).alias("contracted_value"))
            .orderBy(F.desc("count"), "billing_status"))


def workorder_health(orders: DataFrame, sector=None, status_filter=None, status=None, period=None,
                     as_of: dt.date = C.DEFAULT_AS_OF) -> ToolResult:
    wanted = (status or status_filter or "").strip().lower()
    condition = health_condition(sector, wanted, period, as_of)
    scope = P.keep(orders, condition)
    totals = health_totals(scope, as_of)
    unbilled_asked = wanted == "completed_unbilled"
    if wanted in ONGOING_WORDS:
        facts = as_facts(totals, [
            fact(1, "ongoing_orders", "Ongoing Work Orders", F.col("ongoing_count"), "count", noun="orders",
                 n=F.col("ongoing_count"), must_mention=True, role="primary"),
            fact(2, "ongoing_contracted_value", "Ongoing Contracted Value", F.col("ongoing_value"), "INR"),
            fact(3, "total_work_orders", "Total Work Orders Portfolio", F.col("total_orders"), "count", noun="total"),
        ])
        template = "[[F1]] are under way, worth [[F2]], of [[F3]]."
    else:
        facts = as_facts(totals, [
            fact(1, "total_work_orders", "Total Work Orders", F.col("total_orders"), "count", noun="work orders",
                 n=F.col("total_orders"), must_mention=True, role="support" if unbilled_asked else "primary"),
            fact(2, "completed_work_orders_count", "Completed Work Orders", F.col("completed_count"), "count",
                 noun="completed", n=F.col("completed_count")),
            fact(3, "completion_rate_pct", "Operations Completion Rate", F.round("completion_rate_pct", 1), "pct"),
            fact(4, "delayed_work_orders_count", "Delayed Delivery Work Orders (DQ011)", F.col("delayed_count"),
                 "count", noun="delayed", caveats=["DQ011"], role="caveat"),
            fact(5, "completed_unbilled_count", "Completed But Unbilled Orders", F.col("completed_unbilled_count"),
                 "count", noun="orders", role="support" if unbilled_asked else "caveat"),
            fact(6, "completed_unbilled_value", "Completed Unbilled Value", F.col("completed_unbilled_value"), "INR",
                 role="primary" if unbilled_asked else "caveat"),
        ])
        template = "[[F1]] are tracked, [[F2]] ([[F3]]); [[F4]], and [[F5]] are unbilled ([[F6]])."
    breakdown = execution_breakdown(scope)
    return ToolResult("workorder_health", facts,
                      {"t_wo_execution": breakdown, "t_delayed_orders": delayed_orders(scope, as_of),
                       "t_completed_unbilled": completed_unbilled_orders(scope),
                       "t_billing": billing_breakdown(scope)},
                      {"chart_execution": breakdown.select("execution_status", "count")}, template,
                      accounting(orders, condition), {"sector": sector, "status": wanted or None, "period": period},
                      ["DQ010", "DQ011"])
