"""Tools by name: describe them, and run one over the boards."""

from __future__ import annotations

import datetime as dt
import inspect
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, functions as F

from salesloom import contracts as C
from salesloom.operators import audits, deals, executive, orders, quality, sectors
from salesloom.operators.results import ToolResult, as_facts, fact


@dataclass
class Boards:
    """The frames tools read. The ledger may be a function, called only when a tool asks for it."""
    deals: DataFrame
    orders: DataFrame
    ledger: DataFrame | Callable[[], DataFrame] | None = None
    as_of: dt.date = C.DEFAULT_AS_OF

    def register_views(self) -> None:
        """Temporary views for plain SQL."""
        self.deals.createOrReplaceTempView("deals")
        self.orders.createOrReplaceTempView("work_orders")
        sectors.sector_reconciliation(self.deals, self.orders).createOrReplaceTempView("sector_reconciliation")
        sectors.lifecycle(self.deals, self.orders).createOrReplaceTempView("deal_wo_lifecycle")

    def query(self, sql: str, params: list | None = None) -> DataFrame:
        """Parameterised SQL over the views, lazily."""
        self.register_views()
        spark = self.deals.sparkSession
        return spark.sql(sql, args=params) if params else spark.sql(sql)


def list_capabilities(spark) -> ToolResult:
    rows = describe_tools(spark)
    facts = as_facts(rows.agg(F.count(F.lit(1)).alias("tools")), [
        fact(1, "tools_count", "Registered Tools", F.col("tools"), "count", noun="tools", must_mention=True,
             role="primary")])
    return ToolResult("list_capabilities", facts, {"t_tools": rows}, {}, "[[F1]] are available.")


TOOLS: dict[str, Callable[..., ToolResult]] = {
    "pipeline_summary": deals.pipeline_summary,
    "win_loss_analysis": deals.win_loss_analysis,
    "owner_performance": deals.owner_performance,
    "revenue_ladder": orders.revenue_ladder,
    "receivables_summary": orders.receivables_summary,
    "sector_performance": sectors.sector_performance,
    "workorder_health": orders.workorder_health,
    "work_order_health": orders.workorder_health,
    "link_deals_to_orders": sectors.link_deals_to_orders,
    "data_quality_report": quality.data_quality_report,
    "data_debt_list": quality.data_debt_list,
    "leadership_brief": executive.leadership_brief,
    "compare_periods": executive.compare_periods,
    "explain_metric": executive.explain_metric,
    "list_capabilities": list_capabilities,
    "resolve_period": executive.resolve_period,
}
# By tool: the board it reads, whose share of what is measured, and the column it cannot do without; the last tools
# read both boards, so how far they overlap counts too.
RECEIPT_RULES = {
    "pipeline_summary": ("deals", "client_id", "deal_value", "tentative_close_date"),
    "win_loss_analysis": ("deals", "client_id", "deal_value", "close_date_actual"),
    "owner_performance": ("deals", "owner_id", "deal_value", "owner_id"),
    "compare_periods": ("deals", "client_id", "deal_value", "tentative_close_date"),
    "revenue_ladder": ("orders", "client_id", "amount_excl_gst", "po_date"),
    "receivables_summary": ("orders", "client_id", "receivable_amount", "client_id"),
    "workorder_health": ("orders", "owner_id", "amount_excl_gst", "data_delivery_date"),
    "sector_performance": ("orders", "sector", "amount_excl_gst", "sector"),
    "link_deals_to_orders": ("orders", "sector", "amount_excl_gst", "join_key"),
}
BOTH_BOARDS = ("sector_performance", "link_deals_to_orders")
# Parameters the boards provide; all others come from the caller.
BOARD_PARAMETERS = ["deals", "orders", "ledger", "as_of", "spark"]


def parameters(name: str) -> dict[str, inspect.Parameter]:
    return {k: p for k, p in inspect.signature(TOOLS[name]).parameters.items() if k not in BOARD_PARAMETERS}


def describe_tools(spark) -> DataFrame:
    """Name, purpose and parameters of every tool."""
    rows = [(name, (inspect.getdoc(fn) or "").split("\n")[0], list(parameters(name))) for name, fn in TOOLS.items()]
    return spark.createDataFrame(rows, "tool string, purpose string, parameters array<string>")


def run(name: str, boards: Boards, **arguments) -> ToolResult:
    """Run a tool. Unknown arguments are ignored; an unknown tool raises KeyError."""
    if name not in TOOLS:
        raise KeyError(f"no tool named {name!r}; there are {sorted(TOOLS)}")
    wanted = inspect.signature(TOOLS[name]).parameters
    provided = {"deals": boards.deals, "orders": boards.orders, "ledger": boards.ledger, "as_of": boards.as_of,
                "spark": boards.deals.sparkSession}
    given = {k: v for k, v in arguments.items() if k in wanted and k not in BOARD_PARAMETERS}
    result = TOOLS[name](**{k: v for k, v in provided.items() if k in wanted}, **given)
    result.tool = name
    return result


def receipt(name: str, boards: Boards, stale: bool = False, fallback: bool = False, **arguments) -> DataFrame:
    """The audit row of a tool run with these arguments; its confidence comes from the boards themselves."""
    board, entity, value, needed = RECEIPT_RULES[name]
    result = run(name, boards, **arguments)
    coverage = sectors.linkage_measure(boards.deals, boards.orders) if name in BOTH_BOARDS else None
    inputs = audits.receipt_inputs(result.accounting, getattr(boards, board), entity, value, F.col(needed).isNotNull(),
                                   coverage, stale, fallback)
    told = ",".join(f"{k}={v}" for k, v in sorted(arguments.items())) or None
    return audits.receipt(inputs, name, result.template, told, boards.as_of)
