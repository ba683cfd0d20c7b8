"""Shared SQL: the bridge boards, their derived columns and small expression helpers."""

from __future__ import annotations

AS_OF = "1998-07-15"


def msum(x: str, cond: str | None = None) -> str:
    inner = f"CAST({x} AS DECIMAL(18,2))"
    inner = inner if cond is None else f"CASE WHEN {cond} THEN {inner} END"
    return f"coalesce(CAST(sum({inner}) AS DOUBLE), CAST(0 AS DOUBLE))"


def wsum(cond: str | None = None) -> str:
    inner = "CAST(deal_value AS DECIMAL(18,2)) * CAST(prob_weight AS DECIMAL(3,2))"
    inner = inner if cond is None else f"CASE WHEN {cond} THEN {inner} END"
    return f"coalesce(CAST(round(sum({inner}), 2) AS DOUBLE), CAST(0 AS DOUBLE))"


def cnt(cond: str) -> str:
    return f"CAST(count(CASE WHEN {cond} THEN 1 END) AS BIGINT)"


def pct(a: str, b: str, digits: int = 4) -> str:
    return f"round(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) * 100 ELSE CAST(0 AS DOUBLE) END, {digits})"


def inr(x: str) -> str:
    a = f"abs(CAST({x} AS DECIMAL(18,2)))"
    two = lambda e: f"CAST(CAST(round({e}, 2) AS DECIMAL(28,2)) AS VARCHAR)"
    return (f"CASE WHEN ({x}) IS NULL THEN '₹0.00' ELSE CASE WHEN ({x}) < 0 THEN '-' ELSE '' END || '₹' || "
            f"CASE WHEN {a} >= 10000000 THEN {two(a + ' * CAST(0.0000001 AS DECIMAL(8,7))')} || ' Cr' "
            f"WHEN {a} >= 100000 THEN {two(a + ' * CAST(0.00001 AS DECIMAL(6,5))')} || ' L' "
            f"ELSE {grouped(a)} END END")


def grouped(x: str) -> str:
    """Amount with thousands commas and two digits."""
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def pct_text(x: str) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN '0.0%' ELSE printf('%.1f%%', round({x}, 1)) END"


def count_text(x: str, noun: str = "") -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))" + (f" || ' {noun}'" if noun else "")


def fiscal(date: str) -> tuple[str, str]:
    y = f"CAST(CASE WHEN month({date}) >= 4 THEN year({date}) ELSE year({date}) - 1 END AS BIGINT)"
    fy = (f"CASE WHEN {date} IS NULL THEN NULL ELSE 'FY' || lpad(CAST({y} % 100 AS VARCHAR), 2, '0') || '-' || "
          f"lpad(CAST(({y} + 1) % 100 AS VARCHAR), 2, '0') END")
    q = (f"CASE WHEN {date} IS NULL THEN NULL WHEN month({date}) <= 3 THEN 'Q4' WHEN month({date}) <= 6 THEN 'Q1' "
         f"WHEN month({date}) <= 9 THEN 'Q2' ELSE 'Q3' END")
    return fy, q


def repaired(x: str) -> str:
    low = f"lower(trim({x}))"
    pairs = {"renewables": "Renewables", "powerline": "Powerline", "powerlines": "Powerline", "mining": "Mining",
             "infrastructure": "Infrastructure", "tender": "Tender", "gis": "GIS", "defence": "Defence",
             "forestry": "Forestry", "agriculture": "Agriculture", "urban planning": "Urban Planning",
             "water bodies": "Water Bodies"}
    whens = " ".join(f"WHEN {low} = '{k}' THEN '{v}'" for k, v in pairs.items())
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'Unspecified' {whens} ELSE trim({x}) END"


BUCKETS = {
    "Mining": "'mining','quarry','mines','extraction','coal'",
    "Renewables": "'renewables','solar','wind','green energy','pv'",
    "Powerline": "'powerline','power','powerlines','transmission','substation','grid','electrical'",
    "Utilities": "'utilities','utility','water','pipeline','gas'",
    "Infrastructure": "'infrastructure','infra','highways','roads','railways','urban','construction','smart city'",
    "Agriculture": "'agriculture','agri','crop','plantation','farming'",
    "Security & Surveillance": "'security & surveillance','security and surveillance','security','surveillance',"
                               "'defense','perimeter','police'",
    "Tender": "'tender','govt tender','bids','public tender','rfp','e-procurement'",
}


def bucket(x: str) -> str:
    whens = " ".join(f"WHEN lower(trim({x})) IN ({v}) THEN '{k}'" for k, v in BUCKETS.items())
    return f"CASE {whens} ELSE 'Other' END"


DEALS_SRC = """deals_src AS (
  SELECT 'Deal-' || CAST(o.o_orderkey AS VARCHAR) AS deal_alias,
    CASE WHEN o.o_custkey % 11 = 0 THEN NULL ELSE 'OWNER_' || CAST(o.o_custkey % 7 AS VARCHAR) END AS owner_id,
    CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE c.c_name END AS client_id,
    CASE WHEN o.o_orderstatus = 'O' THEN 'Open' WHEN o.o_orderstatus = 'F' THEN 'Won'
         WHEN o.o_orderkey % 3 = 0 THEN 'Lost' WHEN o.o_orderkey % 3 = 1 THEN 'Dead' ELSE 'On Hold' END AS status,
    CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderdate + INTERVAL 45 DAY END AS close_date_actual,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN 'High' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
         WHEN '5-LOW' THEN 'Low' END AS closure_probability,
    CASE WHEN o.o_orderkey % 13 = 0 THEN NULL
         WHEN n.n_nationkey % 9 = 7 THEN CAST(CAST(o.o_totalprice AS DECIMAL(15,2)) * 10 AS DOUBLE)
         ELSE o.o_totalprice END AS deal_value,
    o.o_orderdate + INTERVAL 90 DAY AS tentative_close_date,
    CASE o.o_orderkey % 5 WHEN 0 THEN 'A. Lead Generated' WHEN 1 THEN 'B. Qualified' WHEN 2 THEN 'C. Proposal Sent'
         WHEN 3 THEN 'D. Demo / POC' ELSE 'E. Negotiation / Contracting' END AS stage_raw,
    c.c_mktsegment AS product,
    CASE n.n_nationkey % 9 WHEN 0 THEN 'mining' WHEN 1 THEN 'Renewables' WHEN 2 THEN 'powerlines' WHEN 3 THEN 'GIS'
         WHEN 4 THEN 'Infrastructure' WHEN 5 THEN ' agriculture' WHEN 6 THEN 'Water Bodies' WHEN 7 THEN 'Tender'
         END AS sector_raw,
    o.o_orderdate AS created_date
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

_fy, _fq = fiscal("coalesce(close_date_actual, tentative_close_date)")
_weight = "CASE closure_probability WHEN 'High' THEN 0.8 WHEN 'Medium' THEN 0.5 WHEN 'Low' THEN 0.2 ELSE 0.3 END"
D = f"""d AS (
  SELECT * REPLACE (coalesce(deal_value, CAST(0 AS DOUBLE)) AS deal_value),
    deal_value IS NULL AS value_is_missing,
    trim(deal_alias) AS deal_name, trim(coalesce(owner_id, 'UNASSIGNED')) AS owner_code,
    trim(coalesce(client_id, 'UNKNOWN_CLIENT')) AS client_code, trim(coalesce(status, 'Unknown')) AS deal_status,
    trim(coalesce(stage_raw, 'Unknown')) AS deal_stage, {repaired('sector_raw')} AS sector,
    CAST({_weight} AS DOUBLE) AS prob_weight,
    coalesce(deal_value, CAST(0 AS DOUBLE)) * CAST({_weight} AS DOUBLE) AS weighted_deal_value,
    {_fy} AS fiscal_year, {_fq} AS fiscal_quarter,
    coalesce(status = 'Open' AND tentative_close_date < TIMESTAMP '{AS_OF}', FALSE) AS is_stale,
    lower(trim(deal_alias)) AS join_key
  FROM deals_src)"""

ORDERS_SRC = """orders_src AS (
  SELECT t.* EXCLUDE (tax, flag), billed_incl_gst - collected_incl_gst AS receivable_dec FROM (
    SELECT b2.*, CAST(round(billed_incl_gst * CASE flag WHEN 'R' THEN CAST(1.00 AS DECIMAL(3,2))
        WHEN 'A' THEN CAST(0.60 AS DECIMAL(3,2)) ELSE CAST(1.02 AS DECIMAL(3,2)) END, 2) AS DECIMAL(15,2)) AS collected_incl_gst
    FROM (SELECT b.*, CAST(round(billed_excl_gst * (1 + tax), 2) AS DECIMAL(15,2)) AS billed_incl_gst,
        amount_excl_gst - coalesce(billed_excl_gst, 0) AS to_be_billed_excl_gst
      FROM (SELECT
        'Deal-' || CAST(l.l_orderkey AS VARCHAR) AS deal_alias,
        'WO-' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) || '-' ||
          CAST(l.l_partkey AS VARCHAR) || '-' || CAST(l.l_suppkey AS VARCHAR) AS serial_no,
        'WOCOMPANY_' || CAST(o.o_custkey % 52 + 1 AS VARCHAR) AS client_id,
        'OWNER_' || CAST(l.l_suppkey % 7 AS VARCHAR) AS owner_id,
        CASE s.s_nationkey % 9 WHEN 0 THEN 'Mining' WHEN 1 THEN 'Renewables' WHEN 2 THEN 'Powerline' WHEN 3 THEN 'GIS'
          WHEN 4 THEN 'Infrastructure' WHEN 5 THEN 'Agriculture' WHEN 6 THEN 'Utilities' WHEN 7 THEN 'Tender' END AS sector_raw,
        CASE l.l_linenumber % 7 WHEN 0 THEN 'Completed' WHEN 1 THEN 'Ongoing' WHEN 2 THEN 'Executed until current month'
          WHEN 3 THEN 'Not Started' WHEN 4 THEN 'Pause / struck' WHEN 5 THEN 'Completed' END AS execution_status,
        CASE WHEN l.l_linestatus = 'F' AND l.l_linenumber % 2 = 0 THEN 'BIlled' WHEN l.l_linestatus = 'F' THEN 'Billed'
          WHEN l.l_linenumber % 3 = 0 THEN 'Update Required' END AS billing_status,
        CAST(l.l_extendedprice AS DECIMAL(15,2)) AS amount_excl_gst,
        CAST(round(CAST(l.l_extendedprice AS DECIMAL(15,2)) * (1 + CAST(l.l_tax AS DECIMAL(3,2))), 2) AS DECIMAL(15,2)) AS amount_incl_gst,
        CASE WHEN l.l_linestatus = 'F' THEN CAST(round(CAST(l.l_extendedprice AS DECIMAL(15,2)) *
          (1 - CAST(l.l_discount AS DECIMAL(3,2))), 2) AS DECIMAL(15,2)) END AS billed_excl_gst,
        CAST(l.l_tax AS DECIMAL(3,2)) AS tax, l.l_returnflag AS flag,
        CASE WHEN l.l_linenumber = 3 THEN NULL ELSE o.o_orderdate END AS po_date,
        o.o_orderdate + INTERVAL 7 DAY AS start_date, l.l_shipdate AS end_date,
        CASE WHEN l.l_linenumber = 5 THEN NULL ELSE l.l_shipdate END AS data_delivery_date
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey) b) b2) t)"""

_wfy, _wfq = fiscal("coalesce(po_date, start_date)")
_zero = lambda c: f"coalesce(CAST({c} AS DOUBLE), CAST(0 AS DOUBLE))"
W = f"""w AS (
  SELECT deal_alias, serial_no, client_id, owner_id, sector_raw, po_date, start_date, end_date, data_delivery_date,
    execution_status AS execution_raw, billing_status AS billing_raw,
    {", ".join(f"{_zero(c)} AS {c}" for c in ["amount_excl_gst", "amount_incl_gst", "billed_excl_gst",
               "billed_incl_gst", "collected_incl_gst", "to_be_billed_excl_gst"])},
    {_zero("receivable_dec")} AS receivable_amount,
    billed_excl_gst IS NULL AS billed_is_missing,
    trim(coalesce(deal_alias, 'UNKNOWN_WO')) AS deal_name, trim(coalesce(client_id, 'UNKNOWN_CLIENT')) AS client_code,
    trim(coalesce(owner_id, 'UNASSIGNED')) AS owner_code, {repaired('sector_raw')} AS sector,
    CASE WHEN billing_status = 'BIlled' THEN 'Billed' ELSE coalesce(billing_status, 'Not Specified') END AS billing_status,
    CASE trim(coalesce(execution_status, 'Unknown')) WHEN 'Pause / struck' THEN 'Paused/Stuck'
      WHEN 'Executed until current month' THEN 'Ongoing (Monthly)' ELSE trim(coalesce(execution_status, 'Unknown')) END AS execution_status,
    coalesce(lower(execution_status) = 'completed', FALSE) AS is_completed,
    NOT coalesce(lower(execution_status) = 'completed', FALSE) AND coalesce(end_date < TIMESTAMP '{AS_OF}', FALSE) AS is_overdue,
    {_wfy} AS fiscal_year, {_wfq} AS fiscal_quarter, lower(trim(coalesce(deal_alias, 'UNKNOWN_WO'))) AS join_key
  FROM orders_src)"""

DEALS = f"WITH {DEALS_SRC}, {D} "
ORDERS = f"WITH {ORDERS_SRC}, {W} "
BOTH = f"WITH {DEALS_SRC}, {D}, {ORDERS_SRC}, {W} "


def between(col: str, start: str, end: str) -> str:
    return f"({col} >= TIMESTAMP '{start}' AND {col} < TIMESTAMP '{end}' + INTERVAL 1 DAY)"


RECON = f"""dim AS (SELECT unnest(['Mining','Renewables','Powerline','Utilities','Infrastructure','Agriculture',
    'Security & Surveillance','Tender','Other']) AS sector),
  ds AS (SELECT {bucket('sector')} AS b, count(*) AS total_deals, {cnt("status = 'Open'")} AS open_deals_count,
    {msum('deal_value', "status = 'Open'")} AS open_pipeline_value, {cnt("status = 'Won'")} AS won_deals_count,
    {msum('deal_value', "status = 'Won'")} AS won_deal_value FROM d GROUP BY 1),
  ws AS (SELECT {bucket('sector')} AS b, count(*) AS total_work_orders, {msum('amount_excl_gst')} AS contracted,
    {msum('billed_excl_gst')} AS billed, {msum('collected_incl_gst')} AS collected,
    {msum('receivable_amount')} AS receivable FROM w GROUP BY 1),
  recon AS (SELECT dim.sector, CAST(coalesce(total_deals, 0) AS BIGINT) AS total_deals,
    coalesce(open_deals_count, 0) AS open_deals_count, coalesce(open_deals_count, 0) AS open_deals,
    coalesce(open_pipeline_value, 0) AS open_pipeline_value, coalesce(open_pipeline_value, 0) AS open_pipeline_val,
    coalesce(won_deals_count, 0) AS won_deals_count, coalesce(won_deals_count, 0) AS won_deals,
    coalesce(won_deal_value, 0) AS won_deal_value, coalesce(won_deal_value, 0) AS won_deal_val,
    CAST(coalesce(total_work_orders, 0) AS BIGINT) AS total_work_orders,
    coalesce(contracted, 0) AS contracted_amount_excl_gst, coalesce(contracted, 0) AS contracted_excl_gst,
    coalesce(billed, 0) AS billed_amount_excl_gst, coalesce(billed, 0) AS billed_excl_gst,
    coalesce(collected, 0) AS collected_amount_incl_gst, coalesce(collected, 0) AS collected_incl_gst,
    coalesce(receivable, 0) AS outstanding_receivable, coalesce(receivable, 0) AS receivable_amount,
    CASE WHEN coalesce(won_deals_count, 0) > 0 THEN round(CAST(coalesce(total_work_orders, 0) AS DOUBLE) / won_deals_count * 100, 1)
      ELSE CAST(0 AS DOUBLE) END AS conversion_rate_pct
    FROM dim LEFT JOIN ds ON dim.sector = ds.b LEFT JOIN ws ON dim.sector = ws.b)"""
