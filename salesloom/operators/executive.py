"""Executive tools: brief, period comparison, metric catalogue, governed metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from salesloom import contracts as C
from salesloom.functions import predicates as P
from salesloom.functions import scalars as S
from salesloom.functions.periods import Period, resolve, resolve_columns
from salesloom.operators import deals as D
from salesloom.operators import orders as O
from salesloom.operators import quality as Q
from salesloom.operators import sectors as X
from salesloom.operators.results import ToolResult, accounting, as_facts, fact

# Measures a comparison phrase selects: words, board, amount, date.
COMPARISONS = [
    (["contract", "order"], "orders", "amount_excl_gst", "po_date"),
    (["bill", "revenue"], "orders", "billed_excl_gst", "po_date"),
    (["collect"], "orders", "collected_incl_gst", "po_date"),
]
DEAL_COMPARISON = ("deals", "deal_value", "tentative_close_date")
OPEN_WORDS = ["open", "pipeline"]


def brief_row(deals: DataFrame, orders: DataFrame, ledger: DataFrame, period=None,
              as_of: dt.date = C.DEFAULT_AS_OF) -> DataFrame:
    """Headline figures of all boards as one row; every joined side is a one-row aggregate."""
    pipeline = D.open_totals(deals.filter(D.open_conditions(period=period, as_of=as_of))).select(
        "open_count", "open_value", "weighted_value")
    money = O.ladder(deals, orders, period=period, as_of=as_of).select(
        "amount_excl_gst", "billed_excl_gst", "collected_incl_gst", "receivable_amount", "unbilled_backlog",
        "realization_rate_pct")
    health = O.health_totals(P.keep(orders, O.health_condition(period=period, as_of=as_of)), as_of).select(
        "delayed_count", "completed_unbilled_count", "completion_rate_pct")
    quality = Q.ledger_totals(Q.as_frame(ledger)).select("total_anomalies", F.col("high_severity").alias("high_dq_count"))
    row = pipeline.crossJoin(money).crossJoin(health).crossJoin(quality)
    return row.withColumn("operational_risks", F.col("delayed_count") + F.col("high_dq_count"))


def brief_table(row: DataFrame) -> DataFrame:
    pct = S.format_pct(F.col("realization_rate_pct"))
    lines = [
        ("Open Sales Pipeline", "open_value", F.concat(F.col("open_count").cast("string"), F.lit(" open deals"))),
        ("Executed Order Book", "amount_excl_gst", F.lit("Before tax")),
        ("Realized Billing", "billed_excl_gst", F.concat(pct, F.lit(" billed vs contracted"))),
        ("Cash Receipts", "collected_incl_gst", F.lit("With tax")),
        ("Outstanding Receivables", "receivable_amount", F.lit("Still to be recovered")),
        ("Unbilled Delivery Backlog", "unbilled_backlog", F.lit("Still to be invoiced")),
    ]
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("kpi"), S.format_inr(F.col(c)).alias("value"), note.alias("note"))
        for name, c, note in lines])))


def leadership_brief(deals: DataFrame, orders: DataFrame, ledger: DataFrame, period=None,
                     as_of: dt.date = C.DEFAULT_AS_OF) -> ToolResult:
    row = brief_row(deals, orders, ledger, period, as_of)
    inr = lambda i, metric, label, c, **kw: fact(i, metric, label, F.col(c), "INR", **kw)
    facts = as_facts(row, [
        inr(1, "open_pipeline_value", "Open Pipeline Value", "open_value", must_mention=True, role="primary"),
        inr(2, "wo_contracted_value", "Contracted Work Orders (Excl GST)", "amount_excl_gst", must_mention=True,
            role="primary"),
        inr(3, "wo_billed_value", "Invoiced Billed Value (Excl GST)", "billed_excl_gst", must_mention=True),
        inr(4, "wo_collected_value", "Collected Cash Receipts (Incl GST)", "collected_incl_gst", must_mention=True),
        inr(5, "wo_receivable_value", "Net Accounts Receivable", "receivable_amount", must_mention=True),
        inr(6, "unbilled_backlog", "Unbilled Backlog", "unbilled_backlog"),
        fact(7, "realization_rate_pct", "Revenue Realization Rate", F.round("realization_rate_pct", 1), "pct"),
        fact(8, "operational_risks_count", "High Severity Risk Flags", F.col("operational_risks"), "count",
             noun="risks", must_mention=True, role="caveat"),
    ])
    return ToolResult("leadership_brief", facts, {"t_exec_kpis": brief_table(row)}, {},
                      "Pipeline [[F1]], contracted [[F2]], billed [[F3]], collected [[F4]], due [[F5]]; [[F8]].",
                      accounting(deals, D.open_conditions(period=period, as_of=as_of)), {"period": period})


# ---------------------------------------------------------------- period comparison

def comparison_of(metric: str) -> tuple[str, str, str]:
    words = metric.strip().lower()
    for keys, *target in COMPARISONS:
        if any(k in words for k in keys):
            return tuple(target)
    return DEAL_COMPARISON


def compare(deals: DataFrame, orders: DataFrame, metric: str, period_a: str, period_b: str, sector=None,
            as_of: dt.date = C.DEFAULT_AS_OF) -> DataFrame:
    """Both periods in one scan of one board."""
    board, amount, date = comparison_of(metric)
    a, b = resolve(period_a, as_of), resolve(period_b, as_of)
    in_a, in_b = (c if c is not None else F.lit(True) for c in (P.period_filter(a, date), P.period_filter(b, date)))
    only_open = board == "deals" and any(w in metric.lower() for w in OPEN_WORDS)
    scope = P.keep(deals if board == "deals" else orders, P.sector_filter(sector), in_a | in_b,
                   F.expr(D.IS_OPEN) if only_open else None)
    row = scope.agg(
        S.money_sum_if(in_a, F.col(amount)).alias("value_a"), S.count_if(in_a).alias("count_a"),
        S.money_sum_if(in_b, F.col(amount)).alias("value_b"), S.count_if(in_b).alias("count_b"))
    delta = F.col("value_b") - F.col("value_a")
    return row.select(F.lit(a.label).alias("period_a"), F.lit(b.label).alias("period_b"), "value_a", "count_a",
                      "value_b", "count_b", F.round(delta, 2).alias("delta"),
                      S.percent(delta, F.col("value_a")).alias("delta_pct"))


def compare_periods(deals: DataFrame, orders: DataFrame, metric: str = "open_pipeline_value",
                    period_a: str = "last quarter", period_b: str = "this quarter", sector=None,
                    as_of: dt.date = C.DEFAULT_AS_OF) -> ToolResult:
    row = compare(deals, orders, metric, period_a, period_b, sector, as_of)
    a, b = resolve(period_a, as_of).label, resolve(period_b, as_of).label
    title = metric.replace("_", " ").title()
    facts = as_facts(row, [
        fact(1, f"{metric}_{a}", f"{title} ({a})", F.col("value_a"), "INR", n=F.col("count_a"), must_mention=True),
        fact(2, f"{metric}_{b}", f"{title} ({b})", F.col("value_b"), "INR", n=F.col("count_b"), must_mention=True),
        fact(3, f"{metric}_delta_value", "Delta Value", F.col("delta"), "INR", must_mention=True),
        fact(4, f"{metric}_delta_pct", "Percentage Change", F.round("delta_pct", 1), "pct", must_mention=True),
    ])
    board, _, date = comparison_of(metric)
    return ToolResult("compare_periods", facts, {"t_compare_periods": row}, {},
                      "[[F1]] against [[F2]]: [[F3]] ([[F4]]).",
                      accounting(deals if board == "deals" else orders, P.period_filter(resolve(period_b, as_of), date)),
                      {"metric": metric, "period_a": period_a, "period_b": period_b, "sector": sector})


# ---------------------------------------------------------------- metric catalogue

def metric_match(phrase: Column) -> Column:
    """Best catalogue entry for a phrase: contained either way, else a shared word, else the first entry."""
    catalogue = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(row[0]).alias("name"), F.lit(row[1]).alias("unit"),
                                   F.lit(row[2]).alias("description"), F.lit(row[3]).alias("formula"))
                          for k, row in C.METRICS.items()])
    key = F.replace(F.lower(S.strip(phrase)), F.lit(" "), F.lit("_"))
    parts = F.filter(F.split(key, "_"), lambda p: F.length(p) > 3)
    contained = F.filter(catalogue, lambda e: e["metric"].contains(key) | key.contains(e["metric"]))
    shared = F.filter(catalogue, lambda e: F.exists(parts, lambda p: e["metric"].contains(p)))
    return F.coalesce(F.get(contained, F.lit(0)), F.get(shared, F.lit(0)), F.get(catalogue, F.lit(0)))


def explain_metrics(phrases: DataFrame, column: str = "phrase") -> DataFrame:
    """Name, unit, description and formula for every requested phrase. A row-local lookup, no join."""
    best = phrases.withColumn("_best", metric_match(F.col(column)))
    return best.select(*phrases.columns, "_best.metric", "_best.name", "_best.unit", "_best.description",
                       "_best.formula")


def explain_metric(spark, metric: str = "open_deals_value") -> ToolResult:
    row = explain_metrics(spark.range(1).select(F.lit(metric).alias("phrase")))
    facts = as_facts(row, [
        fact(1, "metric_name", "Metric Display Name", F.col("name"), "text", must_mention=True),
        fact(2, "metric_definition", "Metric Definition", F.col("description"), "text", must_mention=True),
        fact(3, "metric_sql_formula", "Authoritative Formula", F.col("formula"), "text", must_mention=True),
    ])
    return ToolResult("explain_metric", facts, {"t_explain_metric": row}, {}, "[[F1]]: [[F2]] Formula: [[F3]].",
                      None, {"metric": metric})


def resolve_periods(phrases: DataFrame, column: str = "phrase", as_of: dt.date = C.DEFAULT_AS_OF) -> DataFrame:
    """Fiscal boundaries for a whole table of phrases."""
    return resolve_columns(phrases, column, as_of)


def resolve_period(spark, text=None, start=None, end=None, as_of: dt.date = C.DEFAULT_AS_OF) -> ToolResult:
    p: Period = resolve(text, as_of, start and dt.date.fromisoformat(str(start)),
                        end and dt.date.fromisoformat(str(end)))
    text_of = lambda v: F.lit(None if v is None else str(v)).cast("string")
    row = spark.range(1).select(*[text_of(getattr(p, c)).alias(c) for c in
                                  ("label", "fiscal_year", "fiscal_quarter", "start", "end")])
    or_na = lambda c: F.coalesce(c, F.lit("N/A"))
    facts = as_facts(row, [
        fact(1, "period_label", "Resolved Period Label", F.col("label"), "text"),
        fact(2, "fiscal_year", "Fiscal Year", or_na("fiscal_year"), "text"),
        fact(3, "fiscal_quarter", "Fiscal Quarter", or_na("fiscal_quarter"), "text"),
        fact(4, "start_date", "Start Date", or_na("start"), "text"),
        fact(5, "end_date", "End Date", or_na("end"), "text"),
    ])
    return ToolResult("resolve_period", facts, {"t_period": row}, {}, "[[F1]]: [[F4]] to [[F5]].", None,
                      {"text": text, "start": start, "end": end})


# ---------------------------------------------------------------- governed metrics

def deal_metric_columns() -> dict[str, Column]:
    is_open, won, value, sector = F.expr(D.IS_OPEN), F.col("status") == "Won", F.col("deal_value"), F.col("sector")
    weighted = S.money(value) * F.col("prob_weight").cast("decimal(3,2)")
    return {
        "total_deals": F.count(F.lit(1)),
        "open_deals_count": S.count_if(is_open),
        "open_deals_value": S.money_sum_if(is_open, value),
        "weighted_open_pipeline": F.coalesce(F.round(F.sum(F.when(is_open, weighted)), 2).cast("double"), F.lit(0.0)),
        "won_deals_count": S.count_if(won),
        "won_deals_value": S.money_sum_if(won, value),
        "tender_open_pipeline": S.money_sum_if(is_open & (sector == C.OUTLIER_SECTOR), value),
        "non_tender_open_pipeline": S.money_sum_if(is_open & (sector != C.OUTLIER_SECTOR), value),
        "energy_open_pipeline": S.money_sum_if(is_open & S.is_energy_sector(sector), value),
    }


def order_metric_columns() -> dict[str, Column]:
    total = lambda c: S.money_sum(F.col(c))
    return {
        "total_work_orders": F.count(F.lit(1)),
        "contracted_amount_excl_gst": total("amount_excl_gst"),
        "billed_amount_excl_gst": total("billed_excl_gst"),
        "collected_amount_incl_gst": total("collected_incl_gst"),
        "unbilled_backlog_excl_gst": total("to_be_billed_excl_gst"),
        "net_receivable_amount": total("receivable_amount"),
        "_billed_incl": total("billed_incl_gst"),
    }


def governed_metrics(deals: DataFrame, orders: DataFrame) -> DataFrame:
    """Every governed metric from one pass over each board: (metric, value, unit)."""
    named = lambda columns: [c.alias(name) for name, c in columns.items()]
    row = deals.agg(*named(deal_metric_columns())).crossJoin(orders.agg(*named(order_metric_columns())))
    row = row.withColumns({
        "revenue_realization_rate": S.percent(F.col("billed_amount_excl_gst"), F.col("contracted_amount_excl_gst")),
        "collection_efficiency_rate": S.percent(F.col("collected_amount_incl_gst"), F.col("_billed_incl")),
    })
    wanted = [k for k in C.METRICS if k != "cross_board_conversion_rate"]
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(C.METRICS[k][1]).alias("unit"))
        for k in wanted])))


def value_conversion_by_sector(deals: DataFrame, orders: DataFrame) -> DataFrame:
    """Contracted value against won value per sector (the value-based conversion)."""
    return X.sector_reconciliation(deals, orders).select("sector", S.percent(
        F.col("contracted_excl_gst"), F.col("won_deal_val")).alias("cross_board_conversion_rate"))


def ground_truth(deals: DataFrame, orders: DataFrame) -> DataFrame:
    """The sixteen anchor figures as one row."""
    is_open, won, value, sector = F.expr(D.IS_OPEN), F.col("status") == "Won", F.col("deal_value"), F.col("sector")
    tender, energy = sector == C.OUTLIER_SECTOR, S.is_energy_sector(sector)
    d = deals.agg(
        F.count(F.lit(1)).alias("total_deals"), S.count_if(is_open).alias("open_deals_count"),
        S.count_if(is_open & (value > 0)).alias("open_deals_with_value_count"),
        S.money_sum_if(is_open, value).alias("open_pipeline_value"), S.count_if(won).alias("won_deals_count"),
        S.count_if(won & (value > 0)).alias("won_deals_with_value_count"),
        S.money_sum_if(won, value).alias("won_deal_value"),
        S.money_sum_if(is_open & tender, value).alias("tender_open_val"),
        S.money_sum_if(is_open & ~tender, value).alias("non_tender_open_val"),
        S.count_if(is_open & energy).alias("energy_open_count"),
        S.money_sum_if(is_open & energy, value).alias("energy_open_val"))
    w = orders.agg(
        F.count(F.lit(1)).alias("total_work_orders"),
        S.money_sum(F.col("amount_excl_gst")).alias("wo_contracted_excl_gst"),
        S.money_sum(F.col("receivable_amount")).alias("wo_receivable_net"),
        S.count_if(F.col("receivable_amount") < 0).alias("wo_negative_receivable_count"))
    return d.withColumn("tender_open_pct", S.percent(F.col("tender_open_val"), F.col("open_pipeline_value"))
                        ).crossJoin(w)
