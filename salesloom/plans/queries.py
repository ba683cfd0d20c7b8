"""Every registered query, by name. Each takes a Context and returns a lazy frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesloom.functions import predicates as P
from salesloom.operators import deals as D
from salesloom.operators import executive as E
from salesloom.operators import orders as O
from salesloom.operators import quality as Q
from salesloom.operators import sectors as X
from salesloom.plans.board_queries import BOARD_QUERIES
from salesloom.plans.context import AS_OF, QUARTER, YEAR, Context
from salesloom.plans.registry import run
from salesloom.plans.text_queries import TEXT_QUERIES

__all__ = ["QUERIES", "Context"]
FACT_COLUMNS = ["id", "metric", "value_double", "unit", "display", "must_mention", "role"]


def _open(**kw):
    return lambda c: D.open_totals(c.deals.filter(D.open_conditions(**kw, as_of=AS_OF)))


def _facts(tool: str, **kw):
    return lambda c: run(tool, c.boards, **kw).facts.select(*FACT_COLUMNS)


def _win_loss(**kw):
    return lambda c: D.win_loss_totals(P.keep(c.deals, D.win_loss_condition(as_of=AS_OF, **kw)))


TOOL_QUERIES = {
    "a1_open_deal_totals": _open(),
    "a1_open_deal_totals_energy_quarter": _open(sector_group="energy", period=QUARTER),
    "a1_open_deal_totals_created_basis": _open(period=YEAR, basis="created", exclude_outliers=True),
    "a1_open_deal_totals_by_alias": _open(sector="solar"),
    "a2_tender_share": lambda c: D.open_totals(c.open_deals).select(
        "tender_count", "tender_value", "open_value", "tender_share_pct"),
    "a3_open_deals_by_stage": lambda c: D.open_breakdown(c.open_deals, "stage"),
    "a3_open_deals_by_sector": lambda c: D.open_breakdown(c.open_deals, "sector"),
    "a3_open_grouping_sets": lambda c: D.open_grouping_sets(c.open_deals),
    "a4_top_open_deals": lambda c: D.top_deals(c.open_deals),
    "a5_tender_view": lambda c: D.tender_view(c.deals),
    "a5_tender_deals": lambda c: D.tender_deals(c.deals),
    "a6_win_loss_totals": _win_loss(),
    "a6_win_loss_totals_year": _win_loss(period=YEAR),
    "a6_win_loss_lost_only": lambda c: D.win_loss_totals(c.deals, ["Lost"]),
    "a7_win_loss_by_sector": lambda c: D.win_loss_breakdown(c.deals, "sector"),
    "a7_win_loss_by_owner": lambda c: D.win_loss_breakdown(c.deals, "owner"),
    "a7_win_loss_by_product": lambda c: D.win_loss_breakdown(c.deals, "product"),
    "a8_owner_performance": lambda c: D.rank_owners(D.owner_totals(c.deals)),
    "a9_unassigned_deals": lambda c: D.owner_headline(D.owner_totals(c.deals)),
    "a10_revenue_ladder": lambda c: O.ladder(c.deals, c.orders, as_of=AS_OF),
    "a10_revenue_ladder_energy_year": lambda c: O.ladder(c.deals, c.orders, "Energy", YEAR, AS_OF),
    "a10_ladder_stages": lambda c: O.ladder_stages(O.ladder(c.deals, c.orders)),
    "a10_ladder_series": lambda c: O.ladder_series(O.ladder(c.deals, c.orders)),
    "a11_receivables": lambda c: O.receivable_totals(c.orders),
    "a11_receivables_mining": lambda c: O.receivable_totals(P.keep(c.orders, P.sector_filter("coal"))),
    "a12_top_debtors": lambda c: O.top_debtors(c.orders),
    "a13_sector_reconciliation": lambda c: X.sector_reconciliation(c.deals, c.orders),
    "a14_sector_ranking": lambda c: X.rank_sectors(X.sector_reconciliation(c.deals, c.orders)),
    "a14_sector_ranking_open_top": lambda c: X.rank_sectors(
        X.sector_reconciliation(c.deals, c.orders), "open_pipeline", 1),
    "a14_sector_ranking_billed_year": lambda c: X.sector_performance(
        c.deals, c.orders, "billed", YEAR, as_of=AS_OF).tables["t_sectors"],
    "a14_sector_ranking_contains": lambda c: X.rank_sectors(
        X.sector_reconciliation(c.deals, c.orders), "won", sector="power"),
    "a15_execution_status": lambda c: O.execution_breakdown(c.orders),
    "a15_execution_status_year": lambda c: O.execution_breakdown(
        P.keep(c.orders, O.health_condition(period=YEAR, as_of=AS_OF))),
    "a15_health_totals": lambda c: O.health_totals(c.orders, AS_OF),
    "a16_delayed_orders": lambda c: O.delayed_orders(c.orders, AS_OF),
    "a17_completed_unbilled": lambda c: O.completed_unbilled_orders(c.orders),
    "a17_completed_unbilled_filter": lambda c: O.execution_breakdown(
        P.keep(c.orders, O.health_condition(status="completed_unbilled", as_of=AS_OF))),
    "a18_ongoing_orders": lambda c: O.health_totals(c.orders, AS_OF).select("ongoing_count", "ongoing_value"),
    "a19_billing_status": lambda c: O.billing_breakdown(c.orders),
    "a20_linkage_bridge": lambda c: run("link_deals_to_orders", c.boards).tables["t_bridge"],
    "a21_top_won_deals": lambda c: D.top_won_deals(c.deals),
    "a22_debt_records": lambda c: Q.debt_records(c.deals, c.orders),
    "a23_debt_severity": lambda c: Q.debt_severity(Q.debt_records(c.deals, c.orders)),
    "a26_stale_deals": lambda c: D.stale_deals(c.deals),
    "a26_stale_totals": lambda c: D.stale_totals(c.deals),
    "a28_compare_open_value": lambda c: E.compare(c.deals, c.orders, "open_pipeline_value", "last quarter",
                                                  "this quarter", as_of=AS_OF),
    "a28_compare_billed": lambda c: E.compare(c.deals, c.orders, "billed", "last quarter", "this quarter",
                                              as_of=AS_OF),
    "a28_compare_collected_energy": lambda c: E.compare(c.deals, c.orders, "collected", "last fy", "this fy",
                                                        "energy", AS_OF),
    "a31_governed_metrics": lambda c: E.governed_metrics(c.deals, c.orders),
    "a31_value_conversion": lambda c: E.value_conversion_by_sector(c.deals, c.orders),
    "a32_ground_truth": lambda c: E.ground_truth(c.deals, c.orders),
    "a35_legacy_open_summary": lambda c: D.legacy_open_summary(c.deals),
    "a35_legacy_realization": lambda c: O.legacy_realization(c.deals, c.orders),
    "j1_sector_join": lambda c: X.sector_dimension(c.spark).join(
        F.broadcast(X.deals_by_sector(c.deals)), "sector", "left").na.fill(0),
    "j4_scalar_combine": lambda c: O.won_bookings(c.deals).crossJoin(O.order_money(c.orders)),
    "o1_top_won_ten": lambda c: D.top_won_deals(c.deals, 10),
    "o2_full_sort": lambda c: D.tender_deals(c.deals),
    "o3_rule_union": lambda c: Q.debt_records(c.deals, c.orders).groupBy("issue_category", "type").agg(
        F.count(F.lit(1)).alias("records")),
    "j2_lifecycle": lambda c: X.lifecycle(c.deals, c.orders),
    "j3_linkage_measure": lambda c: X.linkage_measure(c.deals, c.orders),
    "j3_unmatched_keys": lambda c: X.unmatched_keys(c.deals, c.orders),
    "facts_pipeline_summary": _facts("pipeline_summary"),
    "facts_revenue_ladder": _facts("revenue_ladder"),
    "facts_win_loss_analysis": _facts("win_loss_analysis"),
    "facts_owner_performance": _facts("owner_performance"),
    "facts_receivables_summary": _facts("receivables_summary"),
    "facts_collected_cash": _facts("receivables_summary", metric="collected_cash"),
    "facts_workorder_health": _facts("workorder_health"),
    "facts_ongoing_orders": _facts("work_order_health", status="Ongoing"),
    "facts_tender_mode": _facts("pipeline_summary", deal_type="Tender"),
    "facts_compare_periods": _facts("compare_periods", metric="billed", period_a="last quarter",
                                    period_b="this quarter"),
    "facts_stale_deals": _facts("data_debt_list", type="stale_open_deals"),
    "facts_leadership_brief": _facts("leadership_brief"),
}

QUERIES = {**TOOL_QUERIES, **BOARD_QUERIES, **TEXT_QUERIES}
