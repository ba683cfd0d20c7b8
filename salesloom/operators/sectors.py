"""Cross-board views: the sector bridge, ranking, linkage audit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window as W, functions as F

from salesloom import contracts as C
from salesloom.functions import predicates as P
from salesloom.functions import scalars as S
from salesloom.functions.periods import resolve
from salesloom.operators.results import ToolResult, accounting, as_facts, fact
from salesloom.operators.skew import left_join_split

RANKINGS = {"open_pipeline": "open_pipeline_val", "pipeline": "open_pipeline_val", "won": "won_deal_val",
            "won_deals": "won_deal_val", "won_value": "won_deal_val", "billed": "billed_excl_gst",
            "revenue": "billed_excl_gst"}
# Second names under which the view repeats a column.
VIEW_ALIASES = {"open_deals": "open_deals_count", "open_pipeline_val": "open_pipeline_value",
                "won_deals": "won_deals_count", "won_deal_val": "won_deal_value",
                "contracted_excl_gst": "contracted_amount_excl_gst", "billed_excl_gst": "billed_amount_excl_gst",
                "collected_incl_gst": "collected_amount_incl_gst", "receivable_amount": "outstanding_receivable"}


def sector_dimension(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in C.CANONICAL_SECTORS])).alias("sector"))


def deals_by_sector(deals: DataFrame) -> DataFrame:
    is_open, won, value = F.col("status") == "Open", F.col("status") == "Won", F.col("deal_value")
    return deals.groupBy(S.canonical_sector(F.col("sector")).alias("sector")).agg(
        F.count(F.lit(1)).alias("total_deals"),
        S.count_if(is_open).alias("open_deals_count"),
        S.money_sum_if(is_open, value).alias("open_pipeline_value"),
        S.count_if(won).alias("won_deals_count"),
        S.money_sum_if(won, value).alias("won_deal_value"))


def orders_by_sector(orders: DataFrame) -> DataFrame:
    return orders.groupBy(S.canonical_sector(F.col("sector")).alias("sector")).agg(
        F.count(F.lit(1)).alias("total_work_orders"),
        S.money_sum(F.col("amount_excl_gst")).alias("contracted_amount_excl_gst"),
        S.money_sum(F.col("billed_excl_gst")).alias("billed_amount_excl_gst"),
        S.money_sum(F.col("collected_incl_gst")).alias("collected_amount_incl_gst"),
        S.money_sum(F.col("receivable_amount")).alias("outstanding_receivable"))


def sector_reconciliation(deals: DataFrame, orders: DataFrame) -> DataFrame:
    """Nine rows: both boards side by side.

    Each side is aggregated to at most nine rows first, so the two joins are
    broadcasts of a size fixed by the sector list.
    """
    joined = (sector_dimension(deals.sparkSession)
              .join(F.broadcast(deals_by_sector(deals)), "sector", "left")
              .join(F.broadcast(orders_by_sector(orders)), "sector", "left"))
    filled = joined.na.fill(0)
    rate = F.when(F.col("won_deals_count") > 0,
                  F.round(F.col("total_work_orders") / F.col("won_deals_count") * 100, 1)).otherwise(0.0)
    return filled.withColumns({**{alias: F.col(c) for alias, c in VIEW_ALIASES.items()},
                               "conversion_rate_pct": rate})


def rank_sectors(view: DataFrame, metric: str = "order_book", top_n: int = 10, sector: str | None = None) -> DataFrame:
    """Sectors by the chosen measure, with their rank. The view has nine rows."""
    column = RANKINGS.get(metric, "contracted_excl_gst")
    ranked = P.keep(view, P.sector_contains(sector)).withColumn(
        "rank", F.rank().over(W.orderBy(F.desc(column))))
    return ranked.select(
        "rank", "sector", "total_deals", "open_deals", "open_pipeline_val", "won_deals", "won_deal_val",
        "total_work_orders", "contracted_excl_gst", "billed_excl_gst", "collected_incl_gst", "receivable_amount",
        "conversion_rate_pct").orderBy("rank", "sector").limit(top_n)


def sector_performance(deals: DataFrame, orders: DataFrame, metric="order_book", period=None, top_n: int = 10,
                       sector=None, as_of: dt.date = C.DEFAULT_AS_OF) -> ToolResult:
    when = resolve(period, as_of)
    view = sector_reconciliation(P.keep(deals, P.period_filter(when, "tentative_close_date")),
                                 P.keep(orders, P.period_filter(when, "po_date")))
    column = RANKINGS.get(metric, "contracted_excl_gst")
    ranked = rank_sectors(view, metric, top_n, sector)
    lead = ranked.orderBy("rank", "sector").limit(1)
    facts = as_facts(lead, [
        fact(1, "top_sector", "Leading Sector", F.col("sector"), "text", must_mention=True, role="primary"),
        fact(2, f"top_sector_{column}", F.concat(F.lit("Leading Sector Value: "), F.col("sector")), F.col(column),
             "INR", must_mention=True),
        fact(3, "conversion_rate_pct", "Orders per Won Deal", F.col("conversion_rate_pct"), "pct"),
    ])
    return ToolResult("sector_performance", facts, {"t_sectors": ranked},
                      {"chart_sectors": ranked.select("sector", S.crore(F.col(column)).alias("value_cr"))},
                      "[[F1]] leads with [[F2]].", accounting(orders, P.period_filter(when, "po_date")),
                      {"metric": metric, "period": period, "top_n": top_n, "sector": sector})


# ---------------------------------------------------------------- linkage

def lifecycle(deals: DataFrame, orders: DataFrame) -> DataFrame:
    """Deals with their work orders on the join key. An audit view only: names are masked independently.

    Orders without a name share one placeholder key; such keys do not end in one task.
    """
    d = deals.select("deal_name", F.col("owner_code").alias("deal_owner"), F.col("client_code").alias("deal_client"),
                     "deal_status", "deal_stage", "deal_value", "weighted_deal_value",
                     F.col("sector").alias("deal_sector"), "closure_probability", "join_key")
    w = orders.select(F.col("serial_no").alias("wo_serial"), "execution_status", "billing_status",
                      F.col("amount_excl_gst").alias("wo_contracted_excl_gst"),
                      F.col("billed_excl_gst").alias("wo_billed_excl_gst"),
                      F.col("collected_incl_gst").alias("wo_collected_incl_gst"),
                      F.col("to_be_billed_excl_gst").alias("wo_unbilled_excl_gst"),
                      F.col("receivable_amount").alias("wo_receivable"), F.lit(1).alias("_hit"), "join_key")
    return (left_join_split(d, w, "join_key").drop("join_key")
            .withColumn("has_work_order", F.coalesce("_hit", F.lit(0))).drop("_hit"))


def key_counts(deals: DataFrame, orders: DataFrame) -> DataFrame:
    """Rows per join key on each board. Counting first keeps a hot key from fanning out."""
    d = deals.groupBy("join_key").agg(F.count(F.lit(1)).alias("deals"))
    w = orders.groupBy("join_key").agg(F.count(F.lit(1)).alias("orders"))
    return d.join(w, "join_key", "full").na.fill(0, ["deals", "orders"])


def linkage_measure(deals: DataFrame, orders: DataFrame) -> DataFrame:
    """How much the boards really overlap: keys, match rate, fan-out, client codes."""
    both = (F.col("deals") > 0) & (F.col("orders") > 0)
    keys = key_counts(deals, orders).agg(
        S.count_if(F.col("deals") > 0).alias("deal_keys"), S.count_if(F.col("orders") > 0).alias("order_keys"),
        S.count_if(both).alias("matched_keys"),
        F.coalesce(F.sum(F.when(both, F.col("deals"))), F.lit(0)).alias("matched_deals"),
        F.coalesce(F.sum("deals"), F.lit(0)).alias("all_deals"),
        F.coalesce(F.sum(F.when(both, F.col("deals") * F.col("orders"))), F.lit(0)).alias("joined_rows"),
        F.coalesce(F.max(F.when(both, F.col("orders"))), F.lit(0)).alias("max_fan_out"))
    shared = deals.select("client_id").intersect(orders.select("client_id")).filter("client_id IS NOT NULL")
    return keys.crossJoin(shared.agg(F.count(F.lit(1)).alias("shared_clients"))).withColumn(
        "match_rate_pct", S.percent(F.col("matched_deals"), F.col("all_deals")))


def unmatched_keys(deals: DataFrame, orders: DataFrame) -> DataFrame:
    """Deals whose key has no work order, per status."""
    return (deals.join(orders.select("join_key").distinct(), "join_key", "left_anti").groupBy("deal_status")
            .agg(F.count(F.lit(1)).alias("unmatched_deals")))


def client_code_ranges(deals: DataFrame, orders: DataFrame) -> DataFrame:
    """Smallest and largest number in the client codes of each board."""
    number = F.nullif(F.regexp_extract("client_id", r"(\d+)", 1), F.lit("")).cast("long")
    one = lambda df, board: df.agg(F.min(number).alias("lowest"), F.max(number).alias("highest")).select(
        F.lit(board).alias("board"), "lowest", "highest")
    return one(deals, "deals").unionByName(one(orders, "work_orders"))


def link_deals_to_orders(deals: DataFrame, orders: DataFrame, sector=None) -> ToolResult:
    """Direct joins between the boards are refused; the sector bridge and the measured overlap are given."""
    view = P.keep(sector_reconciliation(deals, orders), P.sector_filter(sector))
    bridge = view.select("sector", "open_pipeline_val", "won_deal_val", "contracted_excl_gst", "billed_excl_gst",
                         "collected_incl_gst", "conversion_rate_pct").orderBy(F.desc("contracted_excl_gst"), "sector")
    facts = as_facts(bridge.agg(F.count(F.lit(1)).alias("sectors")), [
        fact(1, "direct_link_feasible", "Direct Foreign Key Link Feasible", F.lit("Infeasible"), "text",
             display=F.lit("Infeasible (Direct joins rejected)"), caveats=["DQ015"], must_mention=True,
             role="primary"),
        fact(2, "direct_foreign_key_match_rate", "Direct Foreign Key Match Rate (DQ015)", F.lit(0.0), "pct",
             caveats=["DQ015"], must_mention=True, role="caveat"),
        fact(3, "sectors_reconciled", "Reconciled Canonical Sectors", F.col("sectors"), "count", noun="sectors"),
    ])
    return ToolResult("link_deals_to_orders", facts,
                      {"t_bridge": bridge, "t_overlap": linkage_measure(deals, orders)}, {},
                      "[[F1]]: the boards meet in [[F3]].", accounting(deals, P.sector_filter(sector)),
                      {"sector": sector}, ["DQ015"])
