"""SQL for normalisation, ledger, scalars, predicates and sources."""

from __future__ import annotations

from parity.boards import (AS_OF, BOTH, BUCKETS, D, DEALS, DEALS_SRC, ORDERS, ORDERS_SRC, RECON, W, between, bucket, cnt,
                           count_text, inr, msum, pct, pct_text, wsum)
from parity.tools import DELAYED, OPEN, TENDER, UNBILLED, _health, _ladder_cte, _totals

TITLES = {"Deal Name": "deal_alias", "Owner code": "owner_id", "Client Code": "client_id", "Deal Status": "status",
          "Close Date (A)": "close_date_actual", "Closure Probability": "closure_probability",
          "Masked Deal value": "deal_value", "Tentative Close Date": "tentative_close_date", "Deal Stage": "stage_raw",
          "Product deal": "product", "Sector/service": "sector_raw", "Created Date": "created_date"}

_txt = lambda c: f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)" if c == "deal_value" else f"CAST({c} AS VARCHAR)"
SHEET = f"""{DEALS_SRC}, one AS (SELECT {", ".join(f'{_txt(c)} AS "{t}"' for t, c in TITLES.items())} FROM deals_src),
 sheet AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE CAST(substr("Deal Name", 6) AS BIGINT) % 25 = 0
   UNION ALL SELECT {", ".join(f"'{t}'" for t in TITLES)} FROM orders WHERE o_orderkey % 5000 = 1),
 nohead AS (SELECT * FROM sheet WHERE coalesce(lower(trim("Deal Status")) <> 'deal status', TRUE)),
 copies AS (SELECT *, count(*) AS n FROM nohead GROUP BY ALL)"""
# The clean table, from the dirty sheet.
CLEAN = SHEET + ", deals_typed AS (SELECT " + ", ".join(
    (f'TRY_CAST("{t}" AS DOUBLE) AS {c}' if c == "deal_value" else
     f'TRY_CAST("{t}" AS TIMESTAMP) AS {c}' if c.endswith("date") or c.startswith("close_date") else f'"{t}" AS {c}')
    for t, c in TITLES.items()) + ", n FROM copies), " + D.replace("FROM deals_src", "FROM deals_typed")
DIRTY = "WITH " + CLEAN + " "
ALL = "WITH " + CLEAN + ", " + ORDERS_SRC + ", " + W + " "

RULES = {  # code: (name, severity)
    "DQ001": ("Stray Repeated Header Rows", "HIGH"), "DQ002": ("Exact Duplicate Records", "HIGH"),
    "DQ003": ("Missing Deal Values", "MEDIUM"), "DQ004": ("Missing Entity Identifiers", "LOW"),
    "DQ005": ("Stale Open Pipeline Deals", "HIGH"), "DQ006": ("Won Status with Early Pipeline Stage", "MEDIUM"),
    "DQ007": ("Pipeline Outlier Concentration", "HIGH"), "DQ008": ("Fully Empty Columns", "LOW"),
    "DQ009": ("Negative Accounts Receivable (Credits)", "MEDIUM"),
    "DQ010": ("Completed Work Orders Missing Delivery Date", "MEDIUM"), "DQ011": ("Overdue Incomplete Work Orders", "HIGH"),
    "DQ013": ("Billing Status Case Inconsistency", "LOW"), "DQ014": ("Unbilled Rows Represented as Null", "INFO"),
    "DQ015": ("Independent Alias Masking Across Boards", "INFO"), "DQ016": ("Client Code Range Mismatch", "INFO"),
}
RESOLUTIONS = {"DQ001": "Rows whose status equals the column name are dropped.", "DQ002": "One copy is kept.",
               "DQ003": "Counted as 0.0; known and unknown values are tracked.",
               "DQ004": "Placeholders UNASSIGNED / UNKNOWN_CLIENT are used.", "DQ005": "Flagged as is_stale.",
               "DQ006": "Status is authoritative.", "DQ007": "Views with and without the outliers."}
_blank = "(owner_id IS NULL OR trim(owner_id) = '' OR client_id IS NULL OR trim(client_id) = '')"
_EARLY = "(status = 'Won' AND stage_raw LIKE 'A.%')"


def _few(source: str, name: str, cond: str) -> str:
    return (f"coalesce((SELECT string_agg(s, ', ' ORDER BY s) FROM (SELECT {name} AS s FROM {source} WHERE {cond} "
            f"ORDER BY 1 LIMIT 5)), '')")


HEAD = "coalesce(lower(trim(\"Deal Status\")) = 'deal status', FALSE)"
DEAL_LEDGER = {
    "DQ001": (f"(SELECT count(*) FROM sheet WHERE {HEAD})", _few("sheet", '"Deal Name"', HEAD)),
    "DQ002": ("(SELECT sum(n - 1) FROM copies)", _few("copies", '"Deal Name"', "n > 1")),
    "DQ003": ("(SELECT count(*) FROM d WHERE value_is_missing)", "''"),
    "DQ004": (f"(SELECT count(*) FROM d WHERE {_blank})", "''"),
    "DQ005": ("(SELECT count(*) FROM d WHERE is_stale)", _few("d", "deal_alias", "is_stale")),
    "DQ006": (f"(SELECT count(*) FROM d WHERE {_EARLY})", _few("d", "deal_alias", _EARLY)),
    "DQ007": (f"(SELECT count(*) FROM d WHERE {OPEN} AND {TENDER})",
              "(SELECT deal_alias FROM d ORDER BY deal_value DESC, deal_alias DESC LIMIT 1)"),
}
_nodeliv = "(is_completed AND data_delivery_date IS NULL)"
ORDER_LEDGER = {
    "DQ008": ("4", "'Actual Billing Month, Balance in quantity, Expected Billing Month, Quantity billed (till date)'"),
    "DQ009": ("(SELECT count(*) FROM w WHERE receivable_amount < 0)", _few("w", "deal_alias", "receivable_amount < 0")),
    "DQ010": (f"(SELECT count(*) FROM w WHERE {_nodeliv})", _few("w", "deal_alias", _nodeliv)),
    "DQ011": ("(SELECT count(*) FROM w WHERE is_overdue)", _few("w", "deal_alias", "is_overdue")),
    "DQ013": ("(SELECT count(*) FROM w WHERE trim(billing_raw) = 'BIlled')", "''"),
    "DQ014": ("(SELECT count(*) FROM w WHERE billed_is_missing)", "''"),
    "DQ015": ("(SELECT count(*) FROM w)", "''"), "DQ016": ("(SELECT count(*) FROM w)", "''"),
}


def _ledger(rules: dict) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS code, '{RULES[c][0]}' AS rule_name, '{RULES[c][1]}' AS severity, CAST({n} AS BIGINT) AS affected_count, "
        f"{s} AS samples" for c, (n, s) in rules.items())


LEDGER = f"led AS ({_ledger({**DEAL_LEDGER, **ORDER_LEDGER})})"


def _rule(code: str) -> str:
    part, prefix = (DEAL_LEDGER, DIRTY) if code in DEAL_LEDGER else (ORDER_LEDGER, ORDERS)
    return prefix + f"SELECT code, severity, affected_count, samples FROM ({_ledger({code: part[code]})})"


def _pick(values: list[str], key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


q = lambda s: "'" + s.replace("'", "''") + "'"
_FORMATS = f"""WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(round(CAST(o_totalprice AS DECIMAL(15,2)) *
  CAST({_pick(["0.01", "1", "10", "1000", "-1", "-100"], "o_orderkey")} AS DECIMAL(8,2)), 2) AS DOUBLE) END AS amount FROM orders) """

# phrase -> label, fiscal year, quarter, start, end (as of 2026-01-15)
PERIODS = [
    ("Q1 FY25-26", "FY25-26 Q1", "FY25-26", "Q1", "2025-04-01", "2025-06-30"),
    ("FY24-25", "FY24-25", "FY24-25", None, "2024-04-01", "2025-03-31"),
    ("this quarter", "FY25-26 Q4", "FY25-26", "Q4", "2026-01-01", "2026-03-31"),
    ("last quarter", "FY25-26 Q3", "FY25-26", "Q3", "2025-10-01", "2025-12-31"),
    ("ytd", "YTD FY25-26", "FY25-26", None, "2025-04-01", "2026-01-15"),
    ("last year", "FY24-25", "FY24-25", None, "2024-04-01", "2025-03-31"),
    ("q3", "FY25-26 Q3", "FY25-26", "Q3", "2025-10-01", "2025-12-31"),
    ("all time", "All Time", None, None, None, None),
    ("", "All Time", None, None, None, None),
    ("FY 2023-2024", "FY23-24", "FY23-24", None, "2023-04-01", "2024-03-31"),
    ("next month", "next month", None, None, None, None),
    ("2024-01-01 to 2024-02-15", "2024-01-01 to 2024-02-15", None, None, "2024-01-01", "2024-02-15"),
    ("current FY q2", "FY25-26 Q2", "FY25-26", "Q2", "2025-07-01", "2025-09-30"),
    ("FY99", "FY99-00", "FY99-00", None, "2099-04-01", "2100-03-31"),
]
_lit = lambda v: "NULL" if v is None else q(v)
_PERIODS = "p AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, " + ", ".join(_lit(v) for v in row) + ")" for i, row in enumerate(PERIODS)) + \
    ") AS v(i, phrase, label, fiscal_year, fiscal_quarter, start_date, end_date))"

METRIC_PHRASES = [  # phrase, metric, unit
    ("open deals value", "open_deals_value", "INR"), ("Realization", "revenue_realization_rate", "percentage"),
    ("weighted", "weighted_open_pipeline", "INR"), ("work orders", "total_work_orders", "count"),
    ("receivable", "net_receivable_amount", "INR"), ("tender", "tender_open_pipeline", "INR"),
    ("nothing", "total_deals", "count"), ("collection efficiency", "collection_efficiency_rate", "percentage"),
    ("won deals", "won_deals_count", "count"), ("unbilled backlog", "unbilled_backlog_excl_gst", "INR"),
    ("total_deals and more", "total_deals", "count"),
]
_METRIC_PHRASES = "m AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {q(a)}, {q(b)}, {q(c)})" for i, (a, b, c) in enumerate(METRIC_PHRASES)) + ") AS v(i, phrase, metric, unit))"

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_strip = lambda x: f"trim({x}, {_WS})"
_LABELS = "('direct answer','answer','executive summary','key takeaways','overview')"
_unlabel = lambda x: _strip(
    f"regexp_replace({x}, '^(?:direct answer|answer|executive summary|key takeaways)[\\s:\\-]+', '', 'i')")
_SENTENCE = f"""WITH a AS (SELECT doc_id, {_pick(["'# Direct Answer' || chr(10)", "'## Overview of sales' || chr(10)", "'**Answer:** '",
   "'Executive Summary: '", "''", "chr(10) || chr(10)"], "doc_id")} || text AS answer FROM documents),
 l AS (SELECT doc_id, answer, list_transform(string_split({_strip('answer')}, chr(10)), lambda x: {_strip('x')}) AS ls FROM a),
 m AS (SELECT doc_id, answer, list_transform(ls, lambda x: CASE
     WHEN starts_with(x, '#') THEN {_strip("regexp_replace(x, '^#+\\s*', '')")}
     WHEN starts_with(x, '**') THEN {_strip("regexp_replace(x, '^[*]{1,3}[^*]+[*]{1,3}\\s*[:\\-]?\\s*', '')")} ELSE x END) AS ms, ls FROM l),
 f AS (SELECT doc_id, answer, array_to_string(list_filter(list_transform(range(1, len(ms) + 1), lambda i:
     CASE WHEN (starts_with(ls[i], '#') OR starts_with(ls[i], '**')) AND lower(ms[i]) IN {_LABELS} THEN '' ELSE {_unlabel('ms[i]')} END),
     lambda y: y <> ''), ' ') AS prose FROM m),
 g AS (SELECT doc_id, CASE WHEN prose <> '' THEN prose ELSE {_strip("replace(answer, chr(10), ' ')")} END AS prose FROM f),
 h AS (SELECT doc_id, prose, regexp_extract(prose, '^(.*?[.!?])(?:\\s|$)', 1) AS s FROM g)
 SELECT doc_id, CASE WHEN s <> '' THEN {_strip('s')} ELSE {_strip('substr(prose, 1, 120)')} END AS sentence FROM h"""

MONEY = ["amount_excl_gst", "amount_incl_gst", "billed_excl_gst", "billed_incl_gst", "collected_incl_gst",
         "to_be_billed_excl_gst", "to_be_billed_incl_gst", "receivable_amount"]
_M = lambda c: "CAST(0 AS DOUBLE)" if c == "to_be_billed_incl_gst" else msum(c)
ORDER_COLS = ["deal_alias", "client_id", "serial_no", "nature_of_work", "last_executed_month", "execution_status",
              "data_delivery_date", "po_date", "document_type", "start_date", "end_date", "owner_id", "sector_raw",
              "type_of_work", "last_invoice_date", "latest_invoice_no", "amount_excl_gst", "amount_incl_gst",
              "billed_excl_gst", "billed_incl_gst", "collected_incl_gst", "to_be_billed_excl_gst",
              "to_be_billed_incl_gst", "receivable_amount", "ar_priority", "quantity_ops", "quantity_po",
              "quantity_billed", "quantity_balance", "invoice_status", "expected_billing_month",
              "actual_billing_month", "actual_collection_month", "wo_status_billed", "collection_status",
              "collection_date", "billing_status", "has_software"]
PRESENT = ["deal_alias", "client_id", "serial_no", "execution_status", "data_delivery_date", "po_date", "start_date",
           "end_date", "owner_id", "sector_raw", "amount_excl_gst", "amount_incl_gst", "billed_excl_gst",
           "billed_incl_gst", "collected_incl_gst", "to_be_billed_excl_gst", "billing_status"]
_filled = lambda c: f"count({c})" if c in PRESENT else ("count(receivable_dec)" if c == "receivable_amount" else "CAST(0 AS BIGINT)")
ORDER_SHEET = {"Deal name masked": 1, "Serial #": 1, "Customer Name Code": 1, "BD/KAM Personnel code": 1, "Sector": 1,
               "Execution Status": 1, "Billing Status": 1, "Amount in Rupees (Excl of GST) (Masked)": 1,
               "Amount in Rupees (Incl of GST) (Masked)": 1, "Billed Value in Rupees (Excl of GST.) (Masked)": 1,
               "Billed Value in Rupees (Incl of GST.) (Masked)": 1,
               "Collected Amount in Rupees (Incl of GST.) (Masked)": 1,
               "Amount to be billed in Rs. (Exl. of GST) (Masked)": 1, "Amount Receivable (Masked)": 1,
               "Date of PO/LOI": 1, "Probable Start Date": 1, "Probable End Date": 1, "Data Delivery Date": 1,
               "Quantity billed (till date)": 0, "Balance in quantity": 0, "Expected Billing Month": 0,
               "Actual Billing Month": 0}
_sum = lambda src, amount, cond: f"SELECT count(*) AS rows, {msum(amount)} AS amount FROM {src} WHERE {cond}"

SQL = {
    "s1_board_items": DIRTY + """SELECT "Deal Name" AS id, "Deal Name" AS name, CAST(11 AS INTEGER) AS cells FROM copies""",
    "s2_wide_board": DIRTY + f"""SELECT {", ".join(f'"{t}"' for t in TITLES)} FROM copies""",
    "s2_unlisted_titles": DIRTY + " UNION ALL ".join(
        f"""SELECT {q(t)} AS title, count(nullif("{t}", '')) AS cells FROM copies HAVING count(nullif("{t}", '')) > 0""" for t in list(TITLES)[5:]),
    "s3_wide_export": DIRTY + """, n AS (SELECT *, CAST(regexp_extract("Deal Name", '(\\d+)$', 1) AS BIGINT) AS no FROM copies)
      SELECT CASE WHEN no % 10 = 0 THEN "Deal Name" || chr(10) || 'second "line", with a comma' ELSE "Deal Name" END AS "Deal Name",
        nullif("Deal Status", '') AS "Deal Status", CASE WHEN no % 7 = 0 THEN 'more, of it|last' END AS surplus FROM n""",
    "s3_wide_export_losses": DIRTY + """, n AS (SELECT CAST(regexp_extract("Deal Name", '(\\d+)$', 1) AS BIGINT) AS no FROM copies)
      SELECT count(*) AS rows, count(CASE WHEN no % 7 = 0 THEN 1 END) AS wide_rows, 2 * count(CASE WHEN no % 7 = 0 THEN 1 END) AS surplus_cells,
        count(CASE WHEN no % 10 = 0 THEN 1 END) AS broken_names, count(DISTINCT no) AS deals FROM n""",
    "s3_floating_header": DIRTY + f"""SELECT {", ".join(f'"{t}"' for t in TITLES)} FROM copies""",
    "s4_renamed_columns": ORDERS + f"SELECT {', '.join(f'{_filled(c)} AS {c}' for c in ORDER_COLS)} FROM orders_src",
    "s5_typed_board": DIRTY + """SELECT "Deal Name" AS deal_name, "Owner code" AS owner_code, "Client Code" AS client_code,
      "Deal Status" AS status, "Deal Stage" AS deal_stage, "Sector/service" AS sector, TRY_CAST("Masked Deal value" AS DOUBLE) AS deal_value,
      "Closure Probability" AS closure_probability, CAST(TRY_CAST("Close Date (A)" AS TIMESTAMP) AS DATE) AS close_date_actual,
      CAST(TRY_CAST("Tentative Close Date" AS TIMESTAMP) AS DATE) AS tentative_close_date,
      CAST(TRY_CAST("Created Date" AS TIMESTAMP) AS DATE) AS created_date FROM sheet""",
    "s6_registered_view": BOTH + f", {RECON} SELECT sector, total_deals, total_work_orders, conversion_rate_pct FROM recon WHERE total_deals > 0",
    "s7_parameterised_scan": DEALS + f"SELECT deal_stage, count(*) AS deals FROM d WHERE {OPEN} AND deal_value > 100000 GROUP BY 1",
    "s8_latest_snapshot": DEALS + f"SELECT status, count(*) AS deals, {msum('deal_value')} AS value FROM d GROUP BY 1",
    "s9_snapshot_checksum": BOTH + """, k AS (SELECT (SELECT count(*) FROM d) AS a, (SELECT sum(CAST(deal_value AS DECIMAL(18,2))) FROM d) AS b,
      (SELECT count(*) FROM w) AS c, (SELECT sum(CAST(amount_excl_gst AS DECIMAL(18,2))) FROM w) AS e)
      SELECT a AS deals_count, c AS work_orders_count, substr(sha256(CAST(a AS VARCHAR) || CAST(b AS VARCHAR) || CAST(c AS VARCHAR) ||
      CAST(e AS VARCHAR)), 1, 16) AS checksum FROM k""",
    "s10_snapshot_status": BOTH + """, k AS (SELECT (SELECT count(*) FROM d) AS a, (SELECT sum(CAST(deal_value AS DECIMAL(18,2))) FROM d) AS b,
      (SELECT count(*) FROM w) AS c, (SELECT sum(CAST(amount_excl_gst AS DECIMAL(18,2))) FROM w) AS e)
      SELECT a AS deals_count, c AS work_orders_count, substr(sha256(CAST(a AS VARCHAR) || CAST(b AS VARCHAR) || CAST(c AS VARCHAR) ||
      CAST(e AS VARCHAR)), 1, 16) AS checksum, TRUE AS connected, CAST(300 AS BIGINT) AS age_seconds, FALSE AS is_stale,
      'snapshot' AS source, 'Snapshot · synced 11:55 · as of 1998-07-15' AS display_badge, CAST(600 AS INTEGER) AS ttl_seconds FROM k""",
    "s11_ledger_export": DIRTY + f"""SELECT code AS "DQ Code", rule_name AS "Rule Name", severity AS "Severity", affected_count AS "Affected Rows",
      CASE code {" ".join(f"WHEN '{c}' THEN '{r}'" for c, r in RESOLUTIONS.items())} END AS "Resolution Strategy",
      nullif(samples, '') AS "Sample Identifiers" FROM ({_ledger(DEAL_LEDGER)})""",
    "s12_event_capture": """SELECT event_type AS event, event_id, user_id FROM events WHERE event_id % 10 <> 3
      UNION ALL SELECT event_type, event_id, user_id FROM events WHERE event_id % 10 <> 3 AND event_id % 7 = 0""",
    "nd2_duplicates": DIRTY + """SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM copies""",
    "nd3_text_aliases": DIRTY + "SELECT deal_alias, deal_name, owner_code, client_code, deal_status, deal_stage FROM d",
    "nd4_sector": DIRTY + "SELECT sector, count(*) AS deals FROM d GROUP BY 1",
    "nd7_dates": DIRTY + """SELECT count(close_date_actual) AS close_date_actual, count(tentative_close_date) AS tentative_close_date,
      count(created_date) AS created_date, count(close_date_actual) AS close_date, min(tentative_close_date) AS first_close,
      max(created_date) AS last_created FROM d""",
    "nd8_probability_weight": DIRTY + "SELECT deal_alias, prob_weight, weighted_deal_value FROM d",
    "nd9_fiscal": DIRTY + "SELECT fiscal_year, fiscal_quarter, count(*) AS deals FROM d GROUP BY 1, 2",
    "nd13_join_key": DIRTY + "SELECT deal_alias, join_key FROM d",
    "nd14_clean_deals": DIRTY + """SELECT deal_alias, owner_id, client_id, status, closure_probability, deal_value, stage_raw, product,
      sector_raw, deal_name, owner_code, client_code, deal_status, deal_stage, sector, prob_weight, weighted_deal_value, fiscal_year,
      fiscal_quarter, is_stale, join_key, close_date_actual, tentative_close_date, created_date FROM d""",
    "nw1_empty_columns": "SELECT * FROM (VALUES " + ", ".join(
        f"({q(t)}, {'FALSE' if v else 'TRUE'})" for t, v in ORDER_SHEET.items()) + ") AS v(title, is_empty)",
    "nw2_aliases": ORDERS + "SELECT client_code, owner_code, sector, count(*) AS orders FROM w GROUP BY 1, 2, 3",
    "nw4_amounts": ORDERS + f"SELECT {', '.join(f'{_M(c)} AS {c}' for c in MONEY)} FROM w",
    "nw6_billing_status": ORDERS + "SELECT billing_status, count(*) AS orders FROM w GROUP BY 1",
    "nw7_dates": ORDERS + """SELECT count(data_delivery_date) AS data_delivery_date, count(po_date) AS po_date, count(start_date) AS start_date,
      count(end_date) AS end_date, CAST(0 AS BIGINT) AS last_invoice_date, CAST(0 AS BIGINT) AS collection_date FROM w""",
    "nw10_linkage_rules": ORDERS + "SELECT unnest(['DQ015','DQ016']) AS code, (SELECT count(*) FROM w) AS affected_count",
    "nw10_client_code_ranges": BOTH + """SELECT 'deals' AS board, min(CAST(nullif(regexp_extract(client_id, '(\\d+)', 1), '') AS BIGINT)) AS lowest,
      max(CAST(nullif(regexp_extract(client_id, '(\\d+)', 1), '') AS BIGINT)) AS highest FROM d UNION ALL
      SELECT 'work_orders', min(CAST(nullif(regexp_extract(client_id, '(\\d+)', 1), '') AS BIGINT)),
      max(CAST(nullif(regexp_extract(client_id, '(\\d+)', 1), '') AS BIGINT)) FROM w""",
    "nw11_execution_status": ORDERS + "SELECT execution_status, count(*) AS orders FROM w GROUP BY 1",
    "nw12_fiscal": ORDERS + "SELECT fiscal_year, fiscal_quarter, count(*) AS orders FROM w GROUP BY 1, 2",
    "nw13_join_key": ORDERS + "SELECT serial_no, join_key FROM w",
    "nw14_clean_orders": ORDERS + f"""SELECT deal_alias, serial_no, client_id, owner_id, sector, execution_status, billing_status,
      {", ".join("CAST(0 AS DOUBLE) AS to_be_billed_incl_gst" if c == "to_be_billed_incl_gst" else c for c in MONEY)},
      po_date, start_date, end_date, data_delivery_date, is_overdue, fiscal_year, fiscal_quarter, join_key, deal_name, client_code,
      owner_code FROM w""",
    "nw15_ledger": ALL + f", {LEDGER} SELECT code, rule_name, severity, affected_count, samples FROM led",
    "f1_fiscal_calendar": """SELECT 'FY' || strftime(make_date(y, 1, 1), '%y') || '-' || strftime(make_date(y + 1, 1, 1), '%y') AS fiscal_year,
      'Q' || CAST(quarter(s) AS VARCHAR) AS fiscal_quarter, count(*) AS lines
      FROM (SELECT l_shipdate - INTERVAL 3 MONTH AS s, CAST(year(l_shipdate - INTERVAL 3 MONTH) AS BIGINT) AS y FROM lineitem) GROUP BY 1, 2""",
    "f2_repaired_sector": DEALS + "SELECT sector_raw, sector, count(*) AS deals FROM d GROUP BY 1, 2",
    "f3_canonical_sector": DEALS + f"SELECT sector, {bucket('sector_raw')} AS bucket, count(*) AS deals FROM d GROUP BY 1, 2",
    "f4_resolved_alias": f"""SELECT CASE o_orderkey % 7 WHEN 0 THEN 'Mining' WHEN 1 THEN 'Powerline' WHEN 2 THEN 'Tender' WHEN 3 THEN 'Renewables'
      WHEN 4 THEN 'space' WHEN 5 THEN 'Other' ELSE 'Utilities' END AS sector, count(*) AS rows FROM orders GROUP BY 1""",
    "f5_is_canonical": ORDERS + f"SELECT sector IN ({', '.join(q(b) for b in [*BUCKETS, 'Other'])}) AS canonical, count(*) AS orders FROM w GROUP BY 1",
    "f6_energy_group": ORDERS + f"""SELECT sector IN ('Renewables','Powerline') AS energy, count(*) AS orders, {msum('amount_excl_gst')} AS amount
      FROM w GROUP BY 1""",
    "f7_clean_text": f"SELECT doc_id, md5(nullif({_strip('text')}, '')) AS clean_md5 FROM documents",
    "f8_format_inr": _FORMATS + f"SELECT o_orderkey, {inr('amount')} AS text FROM f",
    "f9_format_pct": _FORMATS + f"SELECT o_orderkey, {pct_text('amount / 1000')} AS text FROM f",
    "f10_format_count": _FORMATS + f"SELECT o_orderkey, {count_text('round_even(coalesce(amount, 0), 0)', 'deals')} AS text FROM f",
    "f11_crore": _FORMATS + "SELECT o_orderkey, round(amount / 1e7, 2) AS crore FROM f",
    "f12_period_labels": f"WITH {_PERIODS} SELECT phrase, label, count(*) AS rows FROM orders JOIN p ON o_orderkey % {len(PERIODS)} = i GROUP BY 1, 2",
    "f13_period_bounds": f"""WITH {_PERIODS} SELECT o_orderkey, fiscal_year, fiscal_quarter, start_date, end_date
      FROM orders JOIN p ON o_orderkey % {len(PERIODS)} = i""",
    "f15_first_sentence": _SENTENCE,
    "f16_date_text": DEALS + "SELECT deal_alias, coalesce(strftime(close_date_actual, '%Y-%m-%d'), 'N/A') AS closed FROM d",
    "p1_status": DEALS + _sum("d", "deal_value", "status = 'Won'"),
    "p2_sector_alias": ORDERS + _sum("w", "amount_excl_gst", "lower(sector) = 'mining'"),
    "p3_energy_group": ORDERS + _sum("w", "amount_excl_gst", "sector IN ('Renewables','Powerline')"),
    "p4_without_outliers": DEALS + _sum("d", "deal_value", "sector <> 'Tender'"),
    "p5_sector_contains": DEALS + _sum("d", "deal_value", "sector ILIKE '%struct%'"),
    "p6_period_range": DEALS + _sum("d", "deal_value", between("tentative_close_date", "1998-07-01", "1998-09-30")),
    "p7_date_basis": DEALS + _sum("d", "deal_value", between("created_date", "1998-04-01", "1999-03-31")),
    "p8_completed_unbilled": ORDERS + _sum("w", "amount_excl_gst", UNBILLED),
    "p9_delayed": ORDERS + _sum("w", "amount_excl_gst", DELAYED),
    "p10_credit_balance": ORDERS + _sum("w", "amount_excl_gst", "receivable_amount < 0"),
    "p11_ledger_filter": ALL + f", {LEDGER} SELECT code, 'work_orders' AS board, severity, affected_count FROM led WHERE code > 'DQ007' AND severity = 'MEDIUM'",
    "p12_write_guard": """SELECT doc_id % 4 IN (0, 3) OR regexp_matches(text, '(?i)\\bmutation\\b') AS forbidden, count(*) AS texts FROM documents GROUP BY 1""",
    "a24_quality_report": ALL + f""", {LEDGER} SELECT count(*) AS total_anomalies, {cnt("severity = 'HIGH'")} AS high_severity,
      {cnt("severity = 'MEDIUM'")} AS medium_severity, {cnt("severity NOT IN ('HIGH','MEDIUM')")} AS other_severity,
      CAST(sum(affected_count) AS BIGINT) AS total_affected FROM led""",
    "a24_quality_report_deals_high": ALL + f""", {LEDGER} SELECT count(*) AS total_anomalies, count(*) AS high_severity,
      CAST(0 AS BIGINT) AS medium_severity, CAST(0 AS BIGINT) AS other_severity, CAST(sum(affected_count) AS BIGINT) AS total_affected
      FROM led WHERE code <= 'DQ007' AND severity = 'HIGH'""",
    "a25_debt_list": ALL + f""", {LEDGER} SELECT code, CASE WHEN code <= 'DQ007' THEN 'deals' ELSE 'work_orders' END AS board, rule_name, severity,
      affected_count FROM led WHERE severity = 'LOW' ORDER BY code LIMIT 50""",
    "a29_metric_phrases": f"WITH {_METRIC_PHRASES} SELECT phrase, metric, unit, count(*) AS rows FROM orders JOIN m ON o_orderkey % {len(METRIC_PHRASES)} = i GROUP BY 1, 2, 3",
    "a33_quality_summary": ALL + f""", {LEDGER}, h AS (SELECT CAST(sum(affected_count) AS BIGINT) AS total_anomalies,
      {pct("sum(CASE WHEN code = 'DQ003' THEN affected_count END)", "(SELECT count(*) FROM d)")} AS no_value_pct,
      CAST(sum(CASE WHEN code = 'DQ003' THEN affected_count END) AS BIGINT) AS nv FROM led)
      SELECT code, rule_name AS name, affected_count AS count, lower(severity) AS severity, total_anomalies, no_value_pct,
      {pct_text('no_value_pct')} || ' (' || CAST(nv AS VARCHAR) || ' deals)' AS share_of_deals_with_no_value FROM led, h""",
    "a34_deals_profile": DIRTY + f""", r AS (SELECT count(*) AS raw_rows, CAST(count(CASE WHEN {HEAD} THEN 1 END) AS BIGINT) AS stray_headers FROM sheet),
      c AS (SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) AS cleaned_rows FROM copies),
      b AS (SELECT {cnt(OPEN)} AS open_count, {cnt(OPEN + ' AND NOT value_is_missing')} AS open_known_value_count,
        {msum('deal_value', OPEN)} AS open_known_value_sum, {cnt(OPEN + ' AND ' + TENDER)} AS tender_open_count,
        {msum('deal_value', OPEN + ' AND ' + TENDER)} AS tender_open_value, {cnt("status = 'Won'")} AS won_count,
        {cnt("status = 'Won' AND NOT value_is_missing")} AS won_known_value_count, {msum('deal_value', "status = 'Won'")} AS won_known_value_sum,
        {cnt(_EARLY)} AS won_stage_a_count, {cnt(OPEN + " AND sector IN ('Renewables','Powerline')")} AS energy_open_count,
        {msum('deal_value', OPEN + " AND sector IN ('Renewables','Powerline')")} AS energy_open_value, {cnt('is_stale')} AS stale_open_count FROM d),
      x AS (SELECT deal_alias AS max_deal_alias, deal_value AS max_deal_value FROM d WHERE {OPEN} ORDER BY deal_value DESC, deal_alias DESC LIMIT 1)
      SELECT *, {pct('tender_open_value', 'open_known_value_sum')} AS tender_share_pct,
        round(open_known_value_sum - tender_open_value, 2) AS open_excl_tender_value FROM r, c, b, x""",
    "a34_orders_profile": ORDERS + f"""SELECT count(*) AS raw_rows, {msum('amount_excl_gst')} AS total_contract_value,
      {msum('receivable_amount')} AS total_receivable, {cnt('receivable_amount < 0')} AS negative_receivable_count,
      {cnt('billed_is_missing')} AS billed_excl_null_count,
      {cnt("execution_status = 'Completed' AND data_delivery_date IS NULL")} AS completed_missing_delivery FROM w""",
    "a34_value_counts": DEALS + """SELECT 'status' AS column_name, status AS value, count(*) AS rows FROM d GROUP BY 2 UNION ALL
      SELECT 'closure_probability', closure_probability, count(*) FROM d GROUP BY 2""",
    "a34_null_counts": DIRTY + " UNION ALL ".join(
        f"""SELECT '{t}' AS column_name, count(*) - count("{t}") AS nulls FROM sheet""" for t in TITLES),
    "o4_entity_names": BOTH + """SELECT DISTINCT kind, name FROM (SELECT unnest(['owner', 'client', 'deal']) AS kind, unnest([owner_id, client_id, deal_alias]) AS name FROM d
      UNION ALL SELECT unnest(['owner', 'client', 'deal']), unnest([owner_id, client_id, deal_alias]) FROM w) WHERE name IS NOT NULL""",
    "o6_intersect_except": BOTH + """, a AS (SELECT DISTINCT owner_id FROM d WHERE owner_id IS NOT NULL), b AS (SELECT DISTINCT owner_id FROM w)
      SELECT 'both' AS set, count(*) AS owners FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL
      SELECT 'deals only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
}
for name, code in {"nd1_header_rows": "DQ001", "nd2_duplicate_rule": "DQ002", "nd5_missing_values": "DQ003",
                   "nd6_missing_entities": "DQ004", "nd10_stale": "DQ005", "nd11_won_early_stage": "DQ006",
                   "nd12_outliers": "DQ007", "nw1_empty_column_rule": "DQ008", "nw3_null_billed": "DQ014",
                   "nw5_negative_receivables": "DQ009", "nw6_billing_typo": "DQ013", "nw8_missing_delivery": "DQ010",
                   "nw9_overdue": "DQ011"}.items():
    SQL[name] = _rule(code)

_BRIEF = ALL + f""", {LEDGER}, {_ladder_cte()}, hh AS ({_health()}),
  pp AS (SELECT count(*) AS open_count, {msum('deal_value')} AS open_value, {wsum()} AS weighted_value FROM d WHERE {OPEN}),
  qq AS (SELECT count(*) AS total_anomalies, {cnt("severity = 'HIGH'")} AS high_dq_count FROM led),
  brief AS (SELECT open_count, open_value, weighted_value, amount_excl_gst, billed_excl_gst, collected_incl_gst, receivable_amount,
    unbilled_backlog, realization_rate_pct, delayed_count, completed_unbilled_count, completion_rate_pct, total_anomalies, high_dq_count,
    delayed_count + high_dq_count AS operational_risks FROM pp, ladder, hh, qq)"""
SQL["a27_leadership_brief"] = _BRIEF + " SELECT * FROM brief"
SQL["a27_brief_table"] = _BRIEF + f""" SELECT u.kpi, {inr('u.v')} AS value, u.note FROM brief, LATERAL (VALUES
  ('Open Sales Pipeline', open_value, CAST(open_count AS VARCHAR) || ' open deals'), ('Executed Order Book', amount_excl_gst, 'Before tax'),
  ('Realized Billing', billed_excl_gst, {pct_text('realization_rate_pct')} || ' billed vs contracted'),
  ('Cash Receipts', collected_incl_gst, 'With tax'), ('Outstanding Receivables', receivable_amount, 'Still to be recovered'),
  ('Unbilled Delivery Backlog', unbilled_backlog, 'Still to be invoiced')) AS u(kpi, v, note)"""


def _brief_facts() -> str:
    from parity.tools import _fact_rows
    return _fact_rows(_BRIEF, "brief", [
        (1, "open_pipeline_value", "open_value", "INR", "", True, "primary"),
        (2, "wo_contracted_value", "amount_excl_gst", "INR", "", True, "primary"),
        (3, "wo_billed_value", "billed_excl_gst", "INR", "", True, "support"),
        (4, "wo_collected_value", "collected_incl_gst", "INR", "", True, "support"),
        (5, "wo_receivable_value", "receivable_amount", "INR", "", True, "support"),
        (6, "unbilled_backlog", "unbilled_backlog", "INR", "", False, "support"),
        (7, "realization_rate_pct", "realization_rate_pct", "pct", "", False, "support"),
        (8, "operational_risks_count", "operational_risks", "count", "risks", True, "caveat")])


SQL["facts_leadership_brief"] = _brief_facts()
