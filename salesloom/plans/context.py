"""The boards of one data folder, built lazily and once per query."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from salesloom.operators import deals as D
from salesloom.operators import normalize as N
from salesloom.plans.registry import Boards
from salesloom.session import compile_wide_plans, shared_folder, stored
from salesloom.sources import bridge

AS_OF = bridge.AS_OF
YEAR, QUARTER = "FY1998", "Q2 FY1998"


def stored_for_rules(df: DataFrame, name: str) -> DataFrame:
    return stored(df.select(*[c for c in df.columns if c in N.RULE_COLUMNS or not name.startswith("clean") or c.startswith("_")]), name)


#: Typed columns that accounts and receipts of tools read.
RECEIPT_DEALS = ["deal_alias", "owner_id", "client_id", "status", "close_date_actual", "tentative_close_date", "deal_value", "sector_raw"]
RECEIPT_ORDERS = ["deal_alias", "owner_id", "client_id", "sector_raw", "amount_excl_gst", "receivable_amount", "po_date",
                  "data_delivery_date"]


def only(board: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The board with these columns written once and its other ones null."""
    kept = stored(board.select(*columns), name)
    return kept.select(*[F.col(f.name) if f.name in columns else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in board.schema.fields])


class Context:
    def __init__(self, spark: SparkSession, folder: str):
        compile_wide_plans(spark)
        self.spark, self.folder = spark, folder
        self.t = bridge.Tables(spark, folder)

    @cached_property
    def deals(self) -> DataFrame:
        return N.derive_deals(bridge.deals_board(self.t), AS_OF)

    @cached_property
    def orders(self) -> DataFrame:
        return N.derive_orders(bridge.orders_board(self.t), AS_OF)

    @cached_property
    def deals_sheet(self) -> DataFrame:
        return bridge.deals_sheet(self.t)

    @cached_property
    def orders_sheet(self) -> DataFrame:
        return bridge.orders_sheet(self.t)

    @cached_property
    def clean_deals(self) -> N.Normalized:
        return N.normalize_deals(self.deals_sheet, AS_OF)

    @cached_property
    def clean_orders(self) -> N.Normalized:
        return N.normalize_orders(self.orders_sheet, AS_OF)

    @cached_property
    def kept_deals(self) -> N.Normalized:
        """The same with the clean rows written once, for queries that read them several times."""
        return N.normalize_deals(self.deals_sheet, AS_OF, keep=stored)

    @cached_property
    def kept_orders(self) -> N.Normalized:
        return N.normalize_orders(self.orders_sheet, AS_OF, keep=stored)

    @cached_property
    def ledger(self) -> DataFrame:
        """Of the clean rows only what the rules read is written; the rest is never computed."""
        deals = N.normalize_deals(self.deals_sheet, AS_OF, keep=stored_for_rules)
        orders = N.normalize_orders(self.orders_sheet, AS_OF, keep=stored_for_rules)
        return stored(N.full_ledger(deals, orders), "ledger")  # a row per rule

    @property
    def boards(self) -> Boards:
        return Boards(self.deals, self.orders, lambda: self.ledger, AS_OF)

    @cached_property
    def receipt_boards(self) -> Boards:
        """The boards with only what receipts read, written once before columns are derived; all else is null."""
        deals = only(bridge.deals_board(self.t), RECEIPT_DEALS, "receipt-deals")
        orders = only(bridge.orders_board(self.t), RECEIPT_ORDERS, "receipt-orders")
        return Boards(N.derive_deals(deals, AS_OF), N.derive_orders(orders, AS_OF), lambda: self.ledger, AS_OF)

    @property
    def open_deals(self) -> DataFrame:
        return self.deals.filter(D.IS_OPEN)

    def scratch(self, name: str) -> str:
        """A new path in the shared folder, for queries that write files and read them back."""
        return f"{shared_folder(self.spark)}/salesloom/{name}-{uuid.uuid4().hex}"
