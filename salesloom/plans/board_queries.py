"""Queries over raw and clean boards: normalisation rules, ledger, scalars, predicates, sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from salesloom import contracts as C
from salesloom.functions import predicates as P
from salesloom.functions import scalars as S
from salesloom.functions.answers import first_sentence
from salesloom.functions.periods import resolve
from salesloom.operators import executive as E
from salesloom.operators import ledger as L
from salesloom.operators import normalize as N
from salesloom.operators import orders as O
from salesloom.operators import quality as Q
from salesloom.operators import sectors as X
from salesloom.plans.context import AS_OF, QUARTER, YEAR, Context
from salesloom.plans.registry import run
from salesloom.session import stored
from salesloom.sources import boards, event_capture, sheets, snapshots

NOW = dt.datetime(2026, 1, 15, 12, 0, 0)
FIVE_MINUTES_AGO = dt.datetime(2026, 1, 15, 11, 55, 0)
SHEET_COLUMNS = list(C.DEAL_COLUMNS)
DEAL_TABLE = ["deal_alias", "owner_id", "client_id", "status", "closure_probability", "deal_value", "stage_raw",
              "product", "sector_raw", "deal_name", "owner_code", "client_code", "deal_status", "deal_stage", "sector",
              "prob_weight", "weighted_deal_value", "fiscal_year", "fiscal_quarter", "is_stale", "join_key",
              "close_date_actual", "tentative_close_date", "created_date"]
ORDER_TABLE = ["deal_alias", "serial_no", "client_id", "owner_id", "sector", "execution_status", "billing_status",
               *C.ORDER_MONEY, "po_date", "start_date", "end_date", "data_delivery_date", "is_overdue", "fiscal_year",
               "fiscal_quarter", "join_key", "deal_name", "client_code", "owner_code"]
PHRASES = ["Q1 FY25-26", "FY24-25", "this quarter", "last quarter", "ytd", "last year", "q3", "all time", "",
           "FY 2023-2024", "next month", "2024-01-01 to 2024-02-15", "current FY q2", "FY99"]
METRIC_PHRASES = ["open deals value", "Realization", "weighted", "work orders", "receivable", "tender", "nothing",
                  "collection efficiency", "won deals", "unbilled backlog", "total_deals and more"]


def _pick(values: list[str], key: Column) -> Column:
    """One of the values per row, by a number of that row."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def _rule(board: str, code: str):
    """Affected rows and samples of one rule."""
    def query(c: Context) -> DataFrame:
        ledger = (c.kept_deals if board == "deals" else c.kept_orders).ledger
        return ledger.filter(F.col("code") == code).select(
            "code", "severity", "affected_count", F.concat_ws(", ", "sample_identifiers").alias("samples"))
    return query


def _sums(df: DataFrame, cond: Column | None, amount: str) -> DataFrame:
    return P.keep(df, cond).agg(F.count(F.lit(1)).alias("rows"), S.money_sum(F.col(amount)).alias("amount"))


def _deal_filter(build):
    return lambda c: _sums(c.deals, build(), "deal_value")


def _order_filter(build):
    return lambda c: _sums(c.orders, build(), "amount_excl_gst")


def copies(c: Context) -> DataFrame:
    sheet = c.deals_sheet
    return N.with_copies(sheet.filter(~N.is_stray_header(sheet))).agg(
        F.sum("_copies").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"),
        F.sum(F.col("_copies") - 1).alias("duplicates"))


def order_formats(c: Context) -> DataFrame:
    """Amounts of every size and sign."""
    key = F.col("o_orderkey")
    factor = _pick(["0.01", "1", "10", "1000", "-1", "-100"], key).cast("decimal(8,2)")
    amount = F.round(F.col("o_totalprice").cast("decimal(15,2)") * factor, 2).cast("double")
    return c.t.orders.select(key, F.when(key % 50 != 0, amount).alias("amount"))


def phrases(c: Context, values: list[str]) -> DataFrame:
    return c.t.orders.select("o_orderkey", _pick(values, F.col("o_orderkey")).alias("phrase"))


def answers(c: Context) -> DataFrame:
    """Documents dressed as written answers."""
    head = _pick(["# Direct Answer\n", "## Overview of sales\n", "**Answer:** ", "Executive Summary: ", "", "\n\n"],
                 F.col("doc_id"))
    return c.t.documents.select("doc_id", F.concat(head, F.col("text")).alias("answer"))


def board_capture(c: Context) -> DataFrame:
    """The deals sheet stored as board pages, then read back."""
    sheet = c.deals_sheet
    number = F.regexp_extract(F.col("Deal Name"), r"(\d+)$", 1).try_cast("long")  # also evaluated on headers
    paged = sheet.filter(~N.is_stray_header(sheet)).withColumn("_page", F.floor(number / boards.PAGE_SIZE) + 1)
    # Copies of a row go to its page, so one exchange serves for dropping them and for making pages.
    path = boards.write_pages(paged.repartition("_page").dropDuplicates(), "_page", "Deal Name", c.scratch("pages"))
    return boards.read_items(c.spark, path)


def _unique_sheet(c: Context) -> DataFrame:
    sheet = c.deals_sheet
    return sheet.filter(~N.is_stray_header(sheet)).dropDuplicates()


def floating_sheet(c: Context) -> DataFrame:
    """The deals sheet exported below a title row, then read back."""
    path = c.scratch("sheet")
    sheet = _unique_sheet(c)
    title = c.spark.range(1).select([F.lit("Export" if i == 0 else None).cast("string").alias(n)
                                     for i, n in enumerate(sheet.columns)])
    header = c.spark.range(1).select([F.lit(n).alias(n) for n in sheet.columns])
    as_is = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "header": False}
    title.unionByName(header).coalesce(1).write.options(**as_is).csv(f"{path}/a")
    sheet.write.options(**as_is).csv(f"{path}/b")
    return sheets.read_floating_header(c.spark, f"{path}/*", len(sheet.columns))


def wide_sheet(c: Context) -> DataFrame:
    """The deals sheet with line breaks and quotes in its names and, in some rows, two cells more than its header has."""
    path = c.scratch("wide")
    sheet = _unique_sheet(c)
    number = F.regexp_extract(F.col("Deal Name"), r"(\d+)$", 1).cast("long")
    quoted = lambda v: F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    name = F.when(number % 10 == 0, F.concat("Deal Name", F.lit('\nsecond "line", with a comma'))).otherwise(F.col("Deal Name"))
    cells = [quoted(name), *[quoted(F.coalesce(F.col(f"`{t}`"), F.lit(""))) for t in sheet.columns[1:]]]
    more = F.when(number % 7 == 0, F.lit(',"more, of it",last')).otherwise("")
    c.spark.range(1).select(F.lit(",".join(sheet.columns)).alias("value")).coalesce(1).write.text(f"{path}/a")
    sheet.select(F.concat(F.array_join(F.array(*cells), ","), more).alias("value")).write.text(f"{path}/b")
    return sheets.read_floating_header(c.spark, f"{path}/*", len(sheet.columns), surplus="surplus")


def wide_sheet_losses(c: Context) -> DataFrame:
    return wide_sheet(c).agg(
        F.count(F.lit(1)).alias("rows"), S.count_if(F.col("surplus").isNotNull()).alias("wide_rows"),
        F.coalesce(F.sum(F.size("surplus")), F.lit(0)).alias("surplus_cells"),
        S.count_if(F.contains("Deal Name", F.lit("\nsecond"))).alias("broken_names"),
        F.count_distinct(F.regexp_extract("Deal Name", r"^Deal-(\d+)", 1)).alias("deals"))


def snapshot(c: Context) -> str:
    """Two snapshots and a load that never finished. Each board is derived once: the second load finds the orders as they
    stand in the first snapshot."""
    path = c.scratch("snapshot")
    deals = stored(c.deals, "deals")
    ledger = stored(L.rule_counts(deals, {"DQ005": F.col("is_stale")}), "rule-counts")  # a row per rule
    snapshots.write(c.spark, path, 1, deals.filter(F.col("status") == "Open"), c.orders, ledger, NOW)
    orders = snapshots.read(c.spark, path, "work_orders", 1)
    snapshots.write(c.spark, path, 2, deals, orders, ledger, FIVE_MINUTES_AGO)
    orders.write.option("compression", "zstd").parquet(f"{path}/work_orders/snapshot_id=3")  # a load that never finished
    return path


def snapshot_read(c: Context) -> DataFrame:
    path = snapshot(c)
    return snapshots.read(c.spark, path, "deals").groupBy("status").agg(
        F.count(F.lit(1)).alias("deals"), S.money_sum(F.col("deal_value")).alias("value"))


def snapshot_status(c: Context) -> DataFrame:
    path = snapshot(c)
    return snapshots.status(snapshots.manifest(c.spark, path), NOW, AS_OF)


def ledger_export(c: Context) -> DataFrame:
    path = L.export_csv(c.kept_deals.ledger, c.scratch("ledger"))
    return c.spark.read.option("header", True).csv(path).withColumn(
        "Affected Rows", F.col("Affected Rows").cast("long")).select(
        "DQ Code", "Rule Name", "Severity", "Affected Rows", "Resolution Strategy", "Sample Identifiers")


def capture(c: Context) -> DataFrame:
    """The event table written as stream captures, one file per writer task, then parsed back."""
    path = c.scratch("capture")
    body = F.to_json(F.struct("event_id", "user_id", "value"))
    data = F.when(F.col("event_id") % 10 == 3, F.lit("data: {broken")).otherwise(F.concat(F.lit("data: "), body))
    text = F.concat_ws("\n", F.lit(": keep-alive"), F.concat(F.lit("event: "), F.col("event_type")), data,
                       F.when(F.col("event_id") % 7 == 0, data), F.lit(""))
    c.t.events.select(text.alias("value")).write.text(path)
    parsed = event_capture.read_events(c.spark, path)
    return parsed.select("event", F.get_json_object("data", "$.event_id").cast("long").alias("event_id"),
                         F.get_json_object("data", "$.user_id").cast("long").alias("user_id"))


def sql_scan(c: Context) -> DataFrame:
    return c.boards.query("SELECT deal_stage, count(*) AS deals FROM deals WHERE status = ? AND deal_value > ? "
                          "GROUP BY deal_stage", ["Open", 100000.0])


def registered_view(c: Context) -> DataFrame:
    return c.boards.query("SELECT sector, total_deals, total_work_orders, conversion_rate_pct FROM "
                          "sector_reconciliation WHERE total_deals > 0")


BOARD_QUERIES = {
    # sources and sinks
    "s1_board_items": lambda c: board_capture(c).select("id", "name", F.size("column_values").alias("cells")),
    "s2_wide_board": lambda c: boards.widen(board_capture(c), SHEET_COLUMNS, "Deal Name"),
    "s2_unlisted_titles": lambda c: boards.unlisted(board_capture(c), SHEET_COLUMNS[:5], "Deal Name"),
    "s3_floating_header": floating_sheet,
    "s3_wide_export": lambda c: wide_sheet(c).select("Deal Name", "Deal Status", F.array_join("surplus", "|").alias("surplus")),
    "s3_wide_export_losses": wide_sheet_losses,
    "s4_renamed_columns": lambda c: N.order_titles(c.orders_sheet).agg(
        *[F.count(n).alias(n) for n in [*C.ORDER_COLUMNS.values(), C.SOFTWARE_COLUMN]]),
    "s5_typed_board": lambda c: sheets.apply_schema_map(c.deals_sheet, sheets.DEALS_SCHEMA_MAP),
    "s6_registered_view": registered_view,
    "s7_parameterised_scan": sql_scan,
    "s8_latest_snapshot": snapshot_read,
    "s9_snapshot_checksum": lambda c: snapshots.checksum(c.deals, c.orders),
    "s10_snapshot_status": snapshot_status,
    "s11_ledger_export": ledger_export,
    "s12_event_capture": capture,
    # deals normalisation
    "nd1_header_rows": _rule("deals", "DQ001"),
    "nd2_duplicates": copies,
    "nd2_duplicate_rule": _rule("deals", "DQ002"),
    "nd3_text_aliases": lambda c: c.clean_deals.rows.select(
        "deal_alias", "deal_name", "owner_code", "client_code", "deal_status", "deal_stage"),
    "nd4_sector": lambda c: c.clean_deals.rows.groupBy("sector").agg(F.count(F.lit(1)).alias("deals")),
    "nd5_missing_values": _rule("deals", "DQ003"),
    "nd6_missing_entities": _rule("deals", "DQ004"),
    "nd7_dates": lambda c: c.clean_deals.rows.agg(
        *[F.count(d).alias(d) for d in ("close_date_actual", "tentative_close_date", "created_date", "close_date")],
        F.min("tentative_close_date").alias("first_close"), F.max("created_date").alias("last_created")),
    "nd8_probability_weight": lambda c: c.clean_deals.rows.select("deal_alias", "prob_weight", "weighted_deal_value"),
    "nd9_fiscal": lambda c: c.clean_deals.rows.groupBy("fiscal_year", "fiscal_quarter").agg(
        F.count(F.lit(1)).alias("deals")),
    "nd10_stale": _rule("deals", "DQ005"),
    "nd11_won_early_stage": _rule("deals", "DQ006"),
    "nd12_outliers": _rule("deals", "DQ007"),
    "nd13_join_key": lambda c: c.clean_deals.rows.select("deal_alias", "join_key"),
    "nd14_clean_deals": lambda c: c.clean_deals.rows.select(*DEAL_TABLE),
    # work-order normalisation
    "nw1_empty_columns": lambda c: N.empty_columns(c.orders_sheet),
    "nw1_empty_column_rule": _rule("orders", "DQ008"),
    "nw2_aliases": lambda c: c.clean_orders.rows.groupBy("client_code", "owner_code", "sector").agg(
        F.count(F.lit(1)).alias("orders")),
    "nw3_null_billed": _rule("orders", "DQ014"),
    "nw4_amounts": lambda c: c.clean_orders.rows.agg(*[S.money_sum(F.col(m)).alias(m) for m in C.ORDER_MONEY]),
    "nw5_negative_receivables": _rule("orders", "DQ009"),
    "nw6_billing_typo": _rule("orders", "DQ013"),
    "nw6_billing_status": lambda c: c.clean_orders.rows.groupBy("billing_status").agg(
        F.count(F.lit(1)).alias("orders")),
    "nw7_dates": lambda c: c.clean_orders.rows.agg(*[F.count(d).alias(d) for d in C.ORDER_DATES]),
    "nw8_missing_delivery": _rule("orders", "DQ010"),
    "nw9_overdue": _rule("orders", "DQ011"),
    "nw10_linkage_rules": lambda c: c.kept_orders.ledger.filter(F.col("code").isin("DQ015", "DQ016")).select(
        "code", "affected_count"),
    "nw10_client_code_ranges": lambda c: X.client_code_ranges(c.deals, c.orders),
    "nw11_execution_status": lambda c: c.clean_orders.rows.groupBy("execution_status").agg(
        F.count(F.lit(1)).alias("orders")),
    "nw12_fiscal": lambda c: c.clean_orders.rows.groupBy("fiscal_year", "fiscal_quarter").agg(
        F.count(F.lit(1)).alias("orders")),
    "nw13_join_key": lambda c: c.clean_orders.rows.select("serial_no", "join_key"),
    "nw14_clean_orders": lambda c: c.clean_orders.rows.select(*ORDER_TABLE),
    "nw15_ledger": lambda c: c.ledger.select("code", "rule_name", "severity", "affected_count",
                                             F.concat_ws(", ", "sample_identifiers").alias("samples")),
    # scalars
    "f1_fiscal_calendar": lambda c: c.t.lineitem.select(
        S.fiscal_year(F.col("l_shipdate")).alias("fiscal_year"),
        S.fiscal_quarter(F.col("l_shipdate")).alias("fiscal_quarter")).groupBy("fiscal_year", "fiscal_quarter").agg(
        F.count(F.lit(1)).alias("lines")),
    "f2_repaired_sector": lambda c: c.deals.groupBy("sector_raw", "sector").agg(F.count(F.lit(1)).alias("deals")),
    "f3_canonical_sector": lambda c: c.deals.groupBy(
        "sector", S.canonical_sector(F.col("sector_raw")).alias("bucket")).agg(F.count(F.lit(1)).alias("deals")),
    "f4_resolved_alias": lambda c: c.t.orders.select(S.resolve_sector(
        _pick([" Coal", "GRID", "rfp", "solar", "space", "Other", "water"], F.col("o_orderkey"))).alias("sector"))
        .groupBy("sector").agg(F.count(F.lit(1)).alias("rows")),
    "f5_is_canonical": lambda c: c.orders.groupBy(S.is_canonical_sector(F.col("sector")).alias("canonical")).agg(
        F.count(F.lit(1)).alias("orders")),
    "f6_energy_group": lambda c: c.orders.groupBy(S.is_energy_sector(F.col("sector")).alias("energy")).agg(
        F.count(F.lit(1)).alias("orders"), S.money_sum(F.col("amount_excl_gst")).alias("amount")),
    "f7_clean_text": lambda c: c.t.documents.select("doc_id", F.md5(S.clean_text(
        F.concat(F.lit(" \t"), F.col("text"), F.lit("\n ")))).alias("clean_md5")),
    "f8_format_inr": lambda c: order_formats(c).select("o_orderkey", S.format_inr(F.col("amount")).alias("text")),
    "f9_format_pct": lambda c: order_formats(c).select(
        "o_orderkey", S.format_pct(F.col("amount") / 1000).alias("text")),
    "f10_format_count": lambda c: order_formats(c).select(
        "o_orderkey", S.format_count(F.col("amount"), "deals").alias("text")),
    "f11_crore": lambda c: order_formats(c).select("o_orderkey", S.crore(F.col("amount")).alias("crore")),
    "f12_period_labels": lambda c: E.resolve_periods(phrases(c, PHRASES), as_of=C.DEFAULT_AS_OF).groupBy(
        "phrase", "label").agg(F.count(F.lit(1)).alias("rows")),
    "f13_period_bounds": lambda c: E.resolve_periods(phrases(c, PHRASES), as_of=C.DEFAULT_AS_OF).select(
        "o_orderkey", "fiscal_year", "fiscal_quarter", F.col("start_date").cast("string").alias("start_date"),
        F.col("end_date").cast("string").alias("end_date")),
    "f15_first_sentence": lambda c: answers(c).select("doc_id", first_sentence(F.col("answer")).alias("sentence")),
    "f16_date_text": lambda c: c.deals.select("deal_alias", S.date_text(F.col("close_date_actual")).alias("closed")),
    # predicates
    "p1_status": lambda c: _sums(c.deals, F.col("status") == "Won", "deal_value"),
    "p2_sector_alias": _order_filter(lambda: P.sector_filter("Quarry")),
    "p3_energy_group": _order_filter(lambda: P.sector_filter("Energy")),
    "p4_without_outliers": _deal_filter(P.without_outliers),
    "p5_sector_contains": _deal_filter(lambda: P.sector_contains("struct")),
    "p6_period_range": _deal_filter(lambda: P.period_filter(resolve(QUARTER), "tentative_close_date")),
    "p7_date_basis": _deal_filter(lambda: P.period_filter(resolve(YEAR), "created_date")),
    "p8_completed_unbilled": _order_filter(P.is_completed_unbilled),
    "p9_delayed": _order_filter(lambda: P.is_delayed(AS_OF)),
    "p10_credit_balance": _order_filter(lambda: F.col("receivable_amount") < 0),
    "p11_ledger_filter": lambda c: Q.scorecard(c.ledger, board="work_orders", severity="medium").select(
        "code", "board", "severity", "affected_count"),
    "p12_write_guard": lambda c: c.t.documents.select("doc_id", P.has_write_keyword(F.concat(
        F.col("text"), _pick([" Mutation x", " permutations", " query", " MUTATION"], F.col("doc_id"))))
        .alias("forbidden")).groupBy("forbidden").agg(F.count(F.lit(1)).alias("texts")),
    # quality tools and profiles
    "a24_quality_report": lambda c: Q.ledger_totals(Q.scorecard(c.ledger)),
    "a24_quality_report_deals_high": lambda c: Q.ledger_totals(Q.scorecard(c.ledger, "deals", "HIGH")),
    "a25_debt_list": lambda c: run("data_debt_list", c.boards, severity="low").tables["t_data_debt"].select(
        "code", "board", "rule_name", "severity", "affected_count"),
    "a27_leadership_brief": lambda c: E.brief_row(c.deals, c.orders, c.ledger, as_of=AS_OF),
    "a27_brief_table": lambda c: E.brief_table(E.brief_row(c.deals, c.orders, c.ledger, as_of=AS_OF)),
    "a29_metric_phrases": lambda c: E.explain_metrics(phrases(c, METRIC_PHRASES)).groupBy("phrase", "metric", "unit")
        .agg(F.count(F.lit(1)).alias("rows")),
    "a33_quality_summary": lambda c: Q.quality_summary(c.kept_deals.rows, c.ledger),
    "a34_deals_profile": lambda c: Q.profile_deals(c.deals_sheet, c.clean_deals.rows),
    "a34_orders_profile": lambda c: Q.profile_orders(c.orders),
    "a34_value_counts": lambda c: Q.value_counts(c.deals, ["status", "closure_probability"]),
    "a34_null_counts": lambda c: Q.null_counts(c.deals_sheet),
    "o4_entity_names": lambda c: _entities(c),
    "o6_intersect_except": lambda c: _set_sizes(c),
}


def _entities(c: Context) -> DataFrame:
    """Distinct owners, clients and deals of both boards."""
    kinds = {"owner": "owner_id", "client": "client_id", "deal": "deal_alias"}
    cells = F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name")) for kind, name in kinds.items()]))
    return c.deals.select(cells).union(c.orders.select(cells)).filter("name IS NOT NULL").distinct()


def _set_sizes(c: Context) -> DataFrame:
    keys = lambda df: df.select("owner_id").filter("owner_id IS NOT NULL").distinct()
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias("owners")).select(F.lit(name).alias("set"), "owners")
    d, w = keys(c.deals), keys(c.orders)
    return size(d.intersect(w), "both").unionByName(size(d.exceptAll(w), "deals only"))
