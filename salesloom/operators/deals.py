"""Deal tools: open pipeline, win/loss, owners."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from salesloom import contracts as C
from salesloom.functions import predicates as P
from salesloom.functions import scalars as S
from salesloom.functions.periods import resolve
from salesloom.operators.results import ToolResult, accounting, as_facts, caveat_when, fact

IS_OPEN = "status = 'Open'"
BREAKDOWNS = {"stage": "deal_stage", "sector": "sector"}
WIN_LOSS_GROUPS = {"sector": "sector", "owner": "owner_id", "product": "product"}


def weighted_sum() -> Column:
    weighted = S.money(F.col("deal_value")) * F.col("prob_weight").cast("decimal(3,2)")
    return F.coalesce(F.round(F.sum(weighted), 2).cast("double"), F.lit(0.0))


def open_conditions(sector=None, sector_group=None, period=None, basis="tentative_close", exclude_outliers=False,
                    as_of: dt.date = C.DEFAULT_AS_OF) -> Column:
    dated = "tentative_close_date" if basis == "tentative_close" else "created_date"
    return P.all_of(
        F.expr(IS_OPEN),
        P.period_filter(resolve(period, as_of), dated),
        P.sector_filter(sector, sector_group),
        P.without_outliers() if exclude_outliers else None,
    )


def open_totals(open_deals: DataFrame) -> DataFrame:
    """Counts, value, weighted value, mean positive size and the outlier sector's share, in one pass."""
    value, outlier = F.col("deal_value"), F.col("sector") == C.OUTLIER_SECTOR
    totals = open_deals.agg(
        F.count(F.lit(1)).alias("open_count"),
        S.count_if(value > 0).alias("with_value_count"),
        S.count_if(F.col("is_stale")).alias("stale_count"),
        S.money_sum(value).alias("open_value"),
        weighted_sum().alias("weighted_value"),
        S.money_sum_if(value > 0, value).alias("positive_value"),
        S.count_if(outlier).alias("tender_count"),
        S.money_sum_if(outlier, value).alias("tender_value"),
    )
    mean = F.when(F.col("with_value_count") > 0, F.col("positive_value") / F.col("with_value_count")).otherwise(0.0)
    return totals.select(
        "open_count", "with_value_count", "stale_count", "open_value", "weighted_value",
        F.round(mean, 4).alias("avg_deal_size"), "tender_count", "tender_value",
        S.percent(F.col("tender_value"), F.col("open_value")).alias("tender_share_pct"),
    )


def open_breakdown(open_deals: DataFrame, group_by: str = "stage") -> DataFrame:
    column = BREAKDOWNS.get(group_by, "sector")
    return (open_deals.groupBy(F.col(column).alias("label"))
            .agg(F.count(F.lit(1)).alias("count"), S.money_sum(F.col("deal_value")).alias("value"),
                 weighted_sum().alias("weighted_value"))
            .orderBy(F.desc("value"), "label"))


def open_grouping_sets(open_deals: DataFrame) -> DataFrame:
    """Total, per stage and per sector from a single scan and a single shuffle."""
    grouped = open_deals.groupingSets(
        [[], [F.col("deal_stage")], [F.col("sector")]], F.col("deal_stage"), F.col("sector"))
    return grouped.agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("count"),
        S.money_sum(F.col("deal_value")).alias("value"), weighted_sum().alias("weighted_value"))


def top_deals(open_deals: DataFrame, n: int = 5) -> DataFrame:
    return (open_deals.select("deal_alias", "sector", "deal_stage", "deal_value", "weighted_deal_value",
                              "closure_probability")
            .orderBy(F.desc("deal_value"), "deal_alias").limit(n))


def tender_view(deals: DataFrame) -> DataFrame:
    """Outlier sector against all open deals."""
    value, tender = F.col("deal_value"), F.col("sector") == C.OUTLIER_SECTOR
    totals = deals.filter(IS_OPEN).agg(
        S.count_if(tender).alias("tender_count"), S.money_sum_if(tender, value).alias("tender_value"),
        F.count(F.lit(1)).alias("open_count"), S.money_sum(value).alias("open_value"))
    return totals.withColumn("tender_share_pct", S.percent(F.col("tender_value"), F.col("open_value")))


def tender_deals(deals: DataFrame) -> DataFrame:
    """Every open deal of the outlier sector, largest first."""
    return (deals.filter(F.expr(IS_OPEN) & (F.col("sector") == C.OUTLIER_SECTOR))
            .select("deal_alias", "sector", "deal_stage", "deal_value", "closure_probability")
            .orderBy(F.desc("deal_value"), "deal_alias"))


def pipeline_summary(deals: DataFrame, sector=None, sector_group=None, period=None, basis="tentative_close",
                     exclude_outliers=False, group_by="stage", deal_type=None,
                     as_of: dt.date = C.DEFAULT_AS_OF) -> ToolResult:
    """Open value, weighted value, breakdown and outlier concentration of open deals."""
    if deal_type and deal_type.strip().lower() == "tender":
        totals = tender_view(deals)
        facts = as_facts(totals, [
            fact(1, "tender_share_pct", "Tender Concentration Share", F.round("tender_share_pct", 1), "pct",
                 must_mention=True, role="primary"),
            fact(2, "tender_pipeline_value", "Tender Pipeline Value", F.col("tender_value"), "INR"),
            fact(3, "tender_deal_count", "Tender Deal Count", F.col("tender_count"), "count", noun="deals"),
            fact(4, "open_pipeline", "Total Open Pipeline", F.col("open_value"), "INR"),
        ])
        return ToolResult(
            "pipeline_summary", facts, {"t_tender_deals": tender_deals(deals)}, {},
            "Tender bids are [[F1]] of the open pipeline: [[F2]] in [[F3]] out of [[F4]].",
            accounting(deals, F.col("sector") == C.OUTLIER_SECTOR, F.expr(IS_OPEN)),
            {"deal_type": deal_type}, ["DQ007"])

    condition = open_conditions(sector, sector_group, period, basis, exclude_outliers, as_of)
    open_deals = deals.filter(condition)
    totals = open_totals(open_deals)
    scope = {"sector": sector or sector_group or "All", "period": resolve(period, as_of).label}
    facts = as_facts(totals, [
        fact(1, "open_pipeline_value", "Open Pipeline", F.col("open_value"), "INR", dimensions=scope,
             n=F.col("open_count"), n_missing=F.col("open_count") - F.col("with_value_count"),
             caveats=caveat_when(F.col("tender_share_pct") > 50, "DQ007"), must_mention=True, role="primary"),
        fact(2, "open_deals_count", "Open Deals Count", F.col("open_count"), "count", noun="deals",
             n=F.col("open_count")),
        fact(3, "weighted_pipeline_value", "Probability-Weighted Pipeline", F.col("weighted_value"), "INR",
             n=F.col("open_count")),
        fact(4, "tender_share_pct", "Tender Share", F.round("tender_share_pct", 1), "pct",
             caveats=caveat_when(F.col("tender_share_pct") > 50, "DQ007"), role="caveat"),
        fact(5, "stale_deals_count", "Stale Open Deals", F.col("stale_count"), "count", noun="deals",
             caveats=["DQ005"], role="caveat"),
        fact(6, "avg_deal_size", "Average Deal Size", F.col("avg_deal_size"), "INR", n=F.col("with_value_count")),
    ])
    breakdown = open_breakdown(open_deals, group_by)
    return ToolResult(
        "pipeline_summary", facts, {"t_breakdown": breakdown, "t_top_deals": top_deals(open_deals)},
        {"chart_breakdown": breakdown.select("label", S.crore(F.col("value")).alias("value_cr"),
                                             S.crore(F.col("weighted_value")).alias("weighted_cr"))},
        "Open pipeline stands at [[F1]] across [[F2]], weighted [[F3]].",
        accounting(deals, condition, F.expr(IS_OPEN)),
        {"sector": sector, "sector_group": sector_group, "period": period, "basis": basis,
         "exclude_outliers": exclude_outliers, "group_by": group_by})


# ---------------------------------------------------------------- win / loss

def is_lost(lost_statuses: list[str]) -> Column:
    return F.col("status").isin(lost_statuses)


def win_loss_condition(period=None, sector=None, as_of: dt.date = C.DEFAULT_AS_OF) -> Column | None:
    return P.all_of(P.period_filter(resolve(period, as_of), "close_date_actual"), P.sector_filter(sector))


def win_loss_totals(deals: DataFrame, lost_statuses: list[str] = C.LOST_STATUSES) -> DataFrame:
    won, lost, value = F.col("status") == "Won", is_lost(lost_statuses), F.col("deal_value")
    totals = deals.agg(
        F.count(F.lit(1)).alias("total_deals"),
        S.count_if(won).alias("won_count"),
        S.count_if(won & (value > 0)).alias("won_with_value_count"),
        S.count_if(lost).alias("lost_count"),
        S.count_if(F.expr(IS_OPEN)).alias("open_count"),
        S.money_sum_if(won, value).alias("won_value"),
        S.money_sum_if(lost, value).alias("lost_value"),
    )
    return totals.withColumns({
        "win_rate_count": S.percent(F.col("won_count"), F.col("won_count") + F.col("lost_count")),
        "win_rate_value": S.percent(F.col("won_value"), F.col("won_value") + F.col("lost_value")),
    })


def win_loss_breakdown(deals: DataFrame, group_by: str = "sector", n: int = 10,
                       lost_statuses: list[str] = C.LOST_STATUSES) -> DataFrame:
    won = F.col("status") == "Won"
    return (deals.groupBy(F.col(WIN_LOSS_GROUPS.get(group_by, "product")).alias("group_name"))
            .agg(F.count(F.lit(1)).alias("total"), S.count_if(won).alias("won"),
                 S.count_if(is_lost(lost_statuses)).alias("lost"),
                 S.money_sum_if(won, F.col("deal_value")).alias("won_val"))
            .orderBy(F.desc("won_val"), F.asc_nulls_last("group_name")).limit(n))


def win_loss_analysis(deals: DataFrame, period=None, sector=None, group_by="sector",
                      lost_statuses: list[str] = C.LOST_STATUSES, as_of: dt.date = C.DEFAULT_AS_OF) -> ToolResult:
    condition = win_loss_condition(period, sector, as_of)
    scope = P.keep(deals, condition)
    facts = as_facts(win_loss_totals(scope, lost_statuses), [
        fact(1, "won_deals_count", "Won Deals Count", F.col("won_count"), "count", noun="deals",
             n=F.col("won_count"), must_mention=True),
        fact(2, "won_deals_value", "Won Deals Value", F.col("won_value"), "INR", n=F.col("won_with_value_count"),
             n_missing=F.col("won_count") - F.col("won_with_value_count"), must_mention=True, role="primary"),
        fact(3, "win_rate_count", "Win Rate (by Count)", F.round("win_rate_count", 1), "pct"),
        fact(4, "win_rate_value", "Win Rate (by Value)", F.round("win_rate_value", 1), "pct"),
        fact(5, "lost_deals_count", "Lost Deals Count", F.col("lost_count"), "count", noun="deals"),
    ])
    table = win_loss_breakdown(scope, group_by, lost_statuses=lost_statuses)
    return ToolResult("win_loss_analysis", facts, {"t_win_loss": table},
                      {"chart_win_loss": table.select("group_name", "won", "lost")},
                      "[[F1]] won worth [[F2]]; win rate [[F3]] by count and [[F4]] by value.",
                      accounting(deals, condition), {"period": period, "sector": sector, "group_by": group_by})


# ---------------------------------------------------------------- owners

def owner_totals(deals: DataFrame) -> DataFrame:
    """Per owner; ownerless deals are one group with a null owner."""
    won = F.col("status") == "Won"
    return deals.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("total_deals"),
        S.count_if(F.expr(IS_OPEN)).alias("open_deals"),
        S.money_sum_if(F.expr(IS_OPEN), F.col("deal_value")).alias("open_pipeline_val"),
        S.count_if(won).alias("won_deals"),
        S.money_sum_if(won, F.col("deal_value")).alias("won_val"))


def rank_owners(totals: DataFrame, n: int = 10) -> DataFrame:
    return totals.orderBy(F.desc("open_pipeline_val"), F.asc_nulls_last("owner_id")).limit(n)


def owner_headline(totals: DataFrame) -> DataFrame:
    """Owners, ownerless deals and the leader, from the per-owner totals and before any limit."""
    ownerless = P.is_blank(F.col("owner_id"))
    lead = F.max_by(F.struct("owner_id", "open_pipeline_val"),
                    F.when(~ownerless, F.struct(F.col("open_pipeline_val"), F.col("total_deals"),
                                                F.col("owner_id"))))
    return totals.agg(
        S.count_if(~ownerless).alias("owners_count"),
        F.coalesce(F.sum(F.when(ownerless, F.col("total_deals"))), F.lit(0)).alias("unassigned_deals"),
        S.money_sum_if(ownerless, F.col("open_pipeline_val")).alias("unassigned_value"),
        lead.alias("lead"),
    ).select("owners_count", "unassigned_deals", "unassigned_value", F.col("lead.owner_id").alias("top_owner"),
             F.col("lead.open_pipeline_val").alias("top_owner_value"))


def owner_performance(deals: DataFrame, period=None, top_n: int = 10,
                      as_of: dt.date = C.DEFAULT_AS_OF) -> ToolResult:
    condition = P.period_filter(resolve(period, as_of), "tentative_close_date")
    totals = owner_totals(P.keep(deals, condition))
    facts = as_facts(owner_headline(totals), [
        fact(1, "active_owners_count", "Active Commercial Owners", F.col("owners_count"), "count", noun="owners"),
        fact(2, "unassigned_deals_count", "Unassigned Deals (DQ004)", F.col("unassigned_deals"), "count",
             noun="deals", caveats=["DQ004"], role="caveat"),
        fact(3, "top_owner_pipeline",
             F.concat(F.lit("Leading Owner ("), F.coalesce("top_owner", F.lit("none")), F.lit(") Pipeline")),
             F.coalesce("top_owner_value", F.lit(0.0)), "INR", role="primary"),
    ])
    table = rank_owners(totals, top_n)
    return ToolResult("owner_performance", facts, {"t_owners": table},
                      {"chart_owners": table.select("owner_id", S.crore(F.col("open_pipeline_val")).alias("open_cr"))},
                      "[[F1]] carry the pipeline, led with [[F3]]; [[F2]] have no owner.",
                      accounting(deals, condition), {"period": period, "top_n": top_n})


def stale_deals(deals: DataFrame) -> DataFrame:
    return deals.filter(F.expr(IS_OPEN) & F.col("is_stale")).select(
        "deal_alias", "client_id", "sector", "owner_id", S.date_text(F.col("tentative_close_date"))
        .alias("tentative_close"), "deal_value")


def stale_totals(deals: DataFrame) -> DataFrame:
    return stale_deals(deals).agg(F.count(F.lit(1)).alias("stale_count"),
                                  S.money_sum(F.col("deal_value")).alias("stale_value"))


def top_won_deals(deals: DataFrame, n: int = 5) -> DataFrame:
    """Largest won deals, waiting to be handed over."""
    return (deals.filter(F.col("status") == "Won")
            .select(F.col("deal_alias").alias("deal_name"), "sector", F.col("owner_id").alias("owner_code"),
                    "deal_value").orderBy(F.desc("deal_value"), "deal_name").limit(n))


def legacy_open_summary(deals: DataFrame) -> DataFrame:
    """Mean size over all open deals, valued or not."""
    return open_totals(deals.filter(IS_OPEN)).select(
        F.col("open_count").alias("total_open_deals"), F.col("open_value").alias("total_pipeline_value"),
        F.col("weighted_value").alias("total_weighted_pipeline"),
        F.round(F.when(F.col("open_count") > 0, F.col("open_value") / F.col("open_count")).otherwise(0.0), 2)
        .alias("avg_deal_size"))
