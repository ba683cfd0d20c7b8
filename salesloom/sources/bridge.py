"""Deals and work orders derived from the order tables, so every tool can run on them.

Amounts are exact decimals rounded to two digits per row, then stored as doubles.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salesloom import contracts as C

AS_OF = dt.date(1998, 7, 15)
REPEATED_EVERY = 25
HEADER_EVERY = 5000
EMPTY_ORDER_COLUMNS = ["quantity_billed", "quantity_balance", "expected_billing_month", "actual_billing_month"]


class Tables:
    """The given tables of one folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _pick(col: Column, values: dict, otherwise: Column | None = None) -> Column:
    chain = None
    for key, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(col == key, value) if chain is None else chain.when(col == key, value)
    return chain if otherwise is None else chain.otherwise(otherwise)


def _text(prefix: str, *cols: Column) -> Column:
    return F.concat(F.lit(prefix), *[c.cast("string") for c in cols])


def deals_board(t: Tables) -> DataFrame:
    """One deal per order."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key, sector_no = F.col("o_orderkey"), F.col("n_nationkey") % 9
    price = F.col("o_totalprice")
    return o.select(
        _text("Deal-", key).alias("deal_alias"),
        F.when(F.col("o_custkey") % 11 != 0, _text("OWNER_", F.col("o_custkey") % 7)).alias("owner_id"),
        F.when(key % 97 != 0, F.col("c_name")).alias("client_id"),
        F.when(F.col("o_orderstatus") == "O", "Open").when(F.col("o_orderstatus") == "F", "Won")
        .when(key % 3 == 0, "Lost").when(key % 3 == 1, "Dead").otherwise("On Hold").alias("status"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 45 DAY"))
        .alias("close_date_actual"),
        _pick(F.col("o_orderpriority"), {"1-URGENT": "High", "2-HIGH": "High", "3-MEDIUM": "Medium", "5-LOW": "Low"})
        .alias("closure_probability"),
        F.when(key % 13 == 0, F.lit(None)).when(
            sector_no == 7, (price.cast("decimal(15,2)") * 10).cast("double")).otherwise(price).alias("deal_value"),
        (F.col("o_orderdate") + F.expr("INTERVAL 90 DAY")).alias("tentative_close_date"),
        _pick(key % 5, {0: "A. Lead Generated", 1: "B. Qualified", 2: "C. Proposal Sent", 3: "D. Demo / POC"},
              F.lit("E. Negotiation / Contracting")).alias("stage_raw"),
        F.col("c_mktsegment").alias("product"),
        _pick(sector_no, {0: "mining", 1: "Renewables", 2: "powerlines", 3: "GIS", 4: "Infrastructure",
                          5: " agriculture", 6: "Water Bodies", 7: "Tender"}).alias("sector_raw"),
        F.col("o_orderdate").alias("created_date"),
    )


def orders_board(t: Tables) -> DataFrame:
    """One work order per order line."""
    joined = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")))
    line, status = F.col("l_linenumber"), F.col("l_linestatus")
    dec = lambda name: F.col(name).cast("decimal(15,2)")
    cents = lambda col: F.round(col, 2).cast("decimal(15,2)")
    one = F.lit(1).cast("decimal(3,2)")
    share = lambda text: F.lit(text).cast("decimal(3,2)")
    joined = joined.withColumns({
        "_amount": dec("l_extendedprice"),
        "_taxed": one + dec("l_tax").cast("decimal(3,2)"),
        "_billed": F.when(status == "F", cents(dec("l_extendedprice") * (one - dec("l_discount").cast("decimal(3,2)")))),
    })
    joined = joined.withColumn("_billed_incl", cents(F.col("_billed") * F.col("_taxed")))
    joined = joined.withColumn("_collected", cents(F.col("_billed_incl") * _pick(
        F.col("l_returnflag"), {"R": share("1.00"), "A": share("0.60")}, share("1.02"))))
    number = lambda col: col.cast("double")
    return joined.select(
        _text("Deal-", F.col("l_orderkey")).alias("deal_alias"),
        F.concat(_text("WO-", F.col("l_orderkey")), _text("-", line), _text("-", F.col("l_partkey")),
                 _text("-", F.col("l_suppkey"))).alias("serial_no"),
        _text("WOCOMPANY_", F.col("o_custkey") % 52 + 1).alias("client_id"),
        _text("OWNER_", F.col("l_suppkey") % 7).alias("owner_id"),
        _pick(F.col("s_nationkey") % 9, {0: "Mining", 1: "Renewables", 2: "Powerline", 3: "GIS", 4: "Infrastructure",
                                         5: "Agriculture", 6: "Utilities", 7: "Tender"}).alias("sector_raw"),
        _pick(line % 7, {0: "Completed", 1: "Ongoing", 2: "Executed until current month", 3: "Not Started",
                         4: "Pause / struck", 5: "Completed"}).alias("execution_status"),
        F.when((status == "F") & (line % 2 == 0), "BIlled").when(status == "F", "Billed")
        .when(line % 3 == 0, "Update Required").alias("billing_status"),
        number(F.col("_amount")).alias("amount_excl_gst"),
        number(cents(F.col("_amount") * F.col("_taxed"))).alias("amount_incl_gst"),
        number(F.col("_billed")).alias("billed_excl_gst"),
        number(F.col("_billed_incl")).alias("billed_incl_gst"),
        number(F.col("_collected")).alias("collected_incl_gst"),
        number(F.col("_amount") - F.coalesce(F.col("_billed"), F.lit(0))).alias("to_be_billed_excl_gst"),
        number(F.col("_billed_incl") - F.col("_collected")).alias("receivable_amount"),
        F.when(line != 3, F.col("o_orderdate")).alias("po_date"),
        (F.col("o_orderdate") + F.expr("INTERVAL 7 DAY")).alias("start_date"),
        F.col("l_shipdate").alias("end_date"),
        F.when(line != 5, F.col("l_shipdate")).alias("data_delivery_date"),
    )


def _as_sheet(df: DataFrame, titles: dict[str, str], amounts: list[str]) -> DataFrame:
    """All columns as text, under the titles the board export uses."""
    title_of = {name: title for title, name in titles.items()}
    return df.select([
        (F.col(c).cast("decimal(18,2)") if c in amounts else F.col(c)).cast("string").alias(title_of[c])
        for c in df.columns])


def deals_sheet(t: Tables) -> DataFrame:
    """The deals board as a dirty text export: repeated rows and stray header rows."""
    sheet = _as_sheet(deals_board(t), C.DEAL_COLUMNS, ["deal_value"])
    number = F.regexp_extract(F.col("Deal Name"), r"(\d+)$", 1).cast("long")
    repeated = sheet.filter(number % REPEATED_EVERY == 0)
    headers = t.orders.filter(F.col("o_orderkey") % HEADER_EVERY == 1).select(
        [F.lit(title).alias(title) for title in sheet.columns])
    return sheet.unionByName(repeated).unionByName(headers)


def orders_sheet(t: Tables) -> DataFrame:
    """The work-order board as a text export with four columns nobody filled in."""
    board = orders_board(t).withColumns({c: F.lit(None).cast("string") for c in EMPTY_ORDER_COLUMNS})
    return _as_sheet(board, C.ORDER_COLUMNS, C.ORDER_MONEY)
