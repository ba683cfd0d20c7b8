"""SQL for the analytical tools."""

from __future__ import annotations

from parity.boards import (AS_OF, BOTH, DEALS, ORDERS, RECON, between, bucket, cnt, count_text, grouped, inr, msum, pct,
                           pct_text, wsum)

OPEN = "status = 'Open'"
TENDER = "sector = 'Tender'"
Q2 = lambda col: between(col, "1998-07-01", "1998-09-30")
FY = lambda col: between(col, "1998-04-01", "1999-03-31")


def _totals(where: str) -> str:
    mean = (f"CASE WHEN {cnt('deal_value > 0')} > 0 THEN {msum('deal_value', 'deal_value > 0')} / {cnt('deal_value > 0')} "
            f"ELSE CAST(0 AS DOUBLE) END")
    return DEALS + f"""SELECT count(*) AS open_count, {cnt('deal_value > 0')} AS with_value_count, {cnt('is_stale')} AS stale_count,
      {msum('deal_value')} AS open_value, {wsum()} AS weighted_value, round({mean}, 4) AS avg_deal_size,
      {cnt(TENDER)} AS tender_count, {msum('deal_value', TENDER)} AS tender_value,
      {pct(msum('deal_value', TENDER), msum('deal_value'))} AS tender_share_pct
      FROM d WHERE {where}"""


def _breakdown(col: str, where: str = OPEN) -> str:
    return DEALS + (f"SELECT {col} AS label, count(*) AS count, {msum('deal_value')} AS value, {wsum()} AS weighted_value "
                    f"FROM d WHERE {where} GROUP BY 1")


def _win_loss(where: str = "TRUE", lost: str = "status IN ('Lost','Dead')") -> str:
    won = "status = 'Won'"
    wv, lv = msum("deal_value", won), msum("deal_value", lost)
    return DEALS + f"""SELECT count(*) AS total_deals, {cnt(won)} AS won_count, {cnt(won + ' AND deal_value > 0')} AS won_with_value_count,
      {cnt(lost)} AS lost_count, {cnt(OPEN)} AS open_count, {wv} AS won_value, {lv} AS lost_value,
      {pct(cnt(won), f'{cnt(won)} + {cnt(lost)}')} AS win_rate_count, {pct(wv, f'{wv} + {lv}')} AS win_rate_value
      FROM d WHERE {where}"""


def _win_groups(col: str) -> str:
    won = "status = 'Won'"
    lost = "status IN ('Lost','Dead')"
    return DEALS + f"""SELECT {col} AS group_name, count(*) AS total, {cnt(won)} AS won, {cnt(lost)} AS lost,
      {msum('deal_value', won)} AS won_val FROM d GROUP BY 1 ORDER BY won_val DESC, group_name NULLS LAST LIMIT 10"""


_OWNERS = f"""owners AS (SELECT owner_id, count(*) AS total_deals, {cnt(OPEN)} AS open_deals,
  {msum('deal_value', OPEN)} AS open_pipeline_val, {cnt("status = 'Won'")} AS won_deals,
  {msum('deal_value', "status = 'Won'")} AS won_val FROM d GROUP BY 1)"""

_MONEY = ["amount_excl_gst", "billed_excl_gst", "billed_incl_gst", "collected_incl_gst", "receivable_amount",
          "to_be_billed_excl_gst"]


def _ladder_cte(d_where: str = "TRUE", w_where: str = "TRUE") -> str:
    sums = ", ".join(f"{msum(c)} AS {c}" for c in _MONEY)
    return f"""b AS (SELECT {msum('deal_value')} AS won_value, count(*) AS won_count FROM d WHERE status = 'Won' AND {d_where}),
      m AS (SELECT count(*) AS wo_count, {sums}, {cnt('receivable_amount < 0')} AS neg_receivable_count,
        {msum('receivable_amount', 'receivable_amount < 0')} AS neg_receivable_sum FROM w WHERE {w_where}),
      ladder AS (SELECT *, {pct('billed_excl_gst', 'amount_excl_gst')} AS realization_rate_pct,
        round(CASE WHEN billed_incl_gst > 0 THEN collected_incl_gst / billed_incl_gst * 100
          WHEN billed_excl_gst > 0 THEN collected_incl_gst / billed_excl_gst * 100 ELSE CAST(0 AS DOUBLE) END, 4) AS collection_rate_pct,
        round(greatest(amount_excl_gst - billed_excl_gst, 0), 2) AS unbilled_backlog FROM b, m)"""


DELAYED = f"(end_date < TIMESTAMP '{AS_OF}' AND execution_status NOT IN ('Completed','Ongoing (Monthly)'))"
UNBILLED = "(execution_status = 'Completed' AND billed_excl_gst = 0 AND amount_excl_gst > 0)"
ONGOING = "contains(lower(execution_status), 'ongoing')"


def _health(where: str = "TRUE") -> str:
    done = "execution_status = 'Completed'"
    return f"""SELECT count(*) AS total_orders, {cnt(done)} AS completed_count, {cnt(DELAYED)} AS delayed_count,
      {msum('amount_excl_gst', DELAYED)} AS delayed_value, {cnt(UNBILLED)} AS completed_unbilled_count,
      {msum('amount_excl_gst', UNBILLED)} AS completed_unbilled_value, {cnt(ONGOING)} AS ongoing_count,
      {msum('amount_excl_gst', ONGOING)} AS ongoing_value, {pct(cnt(done), 'count(*)')} AS completion_rate_pct FROM w WHERE {where}"""


def _exec(where: str = "TRUE") -> str:
    return ORDERS + f"""SELECT execution_status, count(*) AS count, {msum('amount_excl_gst')} AS contracted_val,
      {msum('billed_excl_gst')} AS billed_val, {msum('to_be_billed_excl_gst')} AS unbilled_val FROM w WHERE {where} GROUP BY 1"""


def _compare(src: str, amount: str, date: str, prefix: str, extra: str = "TRUE",
             a=("1998-04-01", "1998-06-30", "FY98-99 Q1"), b=("1998-07-01", "1998-09-30", "FY98-99 Q2")) -> str:
    ia, ib = between(date, a[0], a[1]), between(date, b[0], b[1])
    va, vb = msum(amount, ia), msum(amount, ib)
    return prefix + f"""SELECT '{a[2]}' AS period_a, '{b[2]}' AS period_b, {va} AS value_a, {cnt(ia)} AS count_a, {vb} AS value_b,
      {cnt(ib)} AS count_b, round({vb} - {va}, 2) AS delta, {pct(f'({vb} - {va})', va)} AS delta_pct
      FROM {src} WHERE ({ia} OR {ib}) AND {extra}"""


_TRUTH_D = f"""SELECT count(*) AS total_deals, {cnt(OPEN)} AS open_deals_count,
  {cnt(OPEN + ' AND deal_value > 0')} AS open_deals_with_value_count, {msum('deal_value', OPEN)} AS open_pipeline_value,
  {cnt("status = 'Won'")} AS won_deals_count, {cnt("status = 'Won' AND deal_value > 0")} AS won_deals_with_value_count,
  {msum('deal_value', "status = 'Won'")} AS won_deal_value, {msum('deal_value', OPEN + ' AND ' + TENDER)} AS tender_open_val,
  {pct(msum('deal_value', OPEN + ' AND ' + TENDER), msum('deal_value', OPEN))} AS tender_open_pct,
  {msum('deal_value', OPEN + " AND sector <> 'Tender'")} AS non_tender_open_val,
  {cnt(OPEN + " AND sector IN ('Renewables','Powerline')")} AS energy_open_count,
  {msum('deal_value', OPEN + " AND sector IN ('Renewables','Powerline')")} AS energy_open_val FROM d"""
_TRUTH_W = f"""SELECT count(*) AS total_work_orders, {msum('amount_excl_gst')} AS wo_contracted_excl_gst,
  {msum('receivable_amount')} AS wo_receivable_net, {cnt('receivable_amount < 0')} AS wo_negative_receivable_count FROM w"""

_GOVERNED = BOTH + f""", gd AS ({_TRUTH_D}), gw AS (SELECT count(*) AS n, {", ".join(f"{msum(c)} AS {c}" for c in _MONEY)} FROM w),
 gx AS (SELECT {wsum(OPEN)} AS weighted FROM d)
SELECT u.metric, u.value, u.unit FROM gd, gw, gx, LATERAL (VALUES
 ('total_deals', CAST(total_deals AS DOUBLE), 'count'), ('open_deals_count', CAST(open_deals_count AS DOUBLE), 'count'),
 ('open_deals_value', open_pipeline_value, 'INR'), ('weighted_open_pipeline', weighted, 'INR'),
 ('won_deals_count', CAST(won_deals_count AS DOUBLE), 'count'), ('won_deals_value', won_deal_value, 'INR'),
 ('tender_open_pipeline', tender_open_val, 'INR'), ('non_tender_open_pipeline', non_tender_open_val, 'INR'),
 ('energy_open_pipeline', energy_open_val, 'INR'), ('total_work_orders', CAST(n AS DOUBLE), 'count'),
 ('contracted_amount_excl_gst', amount_excl_gst, 'INR'), ('billed_amount_excl_gst', billed_excl_gst, 'INR'),
 ('collected_amount_incl_gst', collected_incl_gst, 'INR'), ('unbilled_backlog_excl_gst', to_be_billed_excl_gst, 'INR'),
 ('net_receivable_amount', receivable_amount, 'INR'),
 ('revenue_realization_rate', {pct('billed_excl_gst', 'amount_excl_gst')}, 'percentage'),
 ('collection_efficiency_rate', {pct('collected_incl_gst', 'billed_incl_gst')}, 'percentage')) AS u(metric, value, unit)"""

_RANK_COLS = ("sector, total_deals, open_deals, open_pipeline_val, won_deals, won_deal_val, total_work_orders, contracted_excl_gst, "
              "billed_excl_gst, collected_incl_gst, receivable_amount, conversion_rate_pct")


def _ranked(col: str, where: str = "TRUE", n: int = 10, recon: str = RECON, prefix: str = BOTH) -> str:
    return prefix + f""", {recon} SELECT CAST(rank() OVER (ORDER BY {col} DESC) AS INTEGER) AS rank, {_RANK_COLS}
      FROM recon WHERE {where} ORDER BY rank, sector LIMIT {n}"""


_PERIOD_RECON = RECON.replace("FROM d GROUP", f"FROM d WHERE {FY('tentative_close_date')} GROUP").replace(
    "FROM w GROUP", f"FROM w WHERE {FY('po_date')} GROUP")

_DEBT = f"""debt AS (
  SELECT 'WO-' || serial_no AS id, 'work_order' AS type, deal_alias AS entity_name, owner_id AS owner, sector,
    'Billing Status ''Update Required''' AS issue_category, 'High' AS severity,
    'Order ' || serial_no || ' needs a billing update. Contracted: ₹' || {grouped('amount_excl_gst')} AS description,
    'Check the deliverables with operations and raise the pending invoice' AS recommended_action
  FROM w WHERE billing_status = 'Update Required'
  UNION ALL SELECT 'WO-UNBILLED-' || serial_no, 'work_order', deal_alias, owner_id, sector, 'Unbilled Completed Project', 'High',
    'Completed, but ₹' || {grouped('amount_excl_gst')} || ' is not billed', 'Raise the tax invoice' FROM w WHERE {UNBILLED}
  UNION ALL SELECT 'DEAL-ZERO-' || deal_alias, 'deal', deal_alias, owner_id, sector, 'Missing Deal Value in Pipeline', 'Medium',
    'Open deal in stage ''' || deal_stage || ''' has no value', 'Add an estimated value' FROM d WHERE deal_value = 0 AND {OPEN})"""

SQL = {
    "a1_open_deal_totals": _totals(OPEN),
    "a1_open_deal_totals_energy_quarter": _totals(
        f"{OPEN} AND sector IN ('Renewables','Powerline') AND {Q2('tentative_close_date')}"),
    "a1_open_deal_totals_created_basis": _totals(f"{OPEN} AND {FY('created_date')} AND sector <> 'Tender'"),
    "a1_open_deal_totals_by_alias": _totals(f"{OPEN} AND lower(sector) = 'renewables'"),
    "a2_tender_share": DEALS + f"""SELECT {cnt(TENDER)} AS tender_count, {msum('deal_value', TENDER)} AS tender_value,
      {msum('deal_value')} AS open_value, {pct(msum('deal_value', TENDER), msum('deal_value'))} AS tender_share_pct FROM d WHERE {OPEN}""",
    "a3_open_deals_by_stage": _breakdown("deal_stage"),
    "a3_open_deals_by_sector": _breakdown("sector"),
    "a3_open_grouping_sets": DEALS + f"""SELECT deal_stage, sector, CAST(GROUPING(deal_stage, sector) AS INTEGER) AS level,
      count(*) AS count, {msum('deal_value')} AS value, {wsum()} AS weighted_value FROM d WHERE {OPEN}
      GROUP BY GROUPING SETS ((), (deal_stage), (sector))""",
    "a4_top_open_deals": DEALS + f"""SELECT deal_alias, sector, deal_stage, deal_value, weighted_deal_value, closure_probability
      FROM d WHERE {OPEN} ORDER BY deal_value DESC, deal_alias LIMIT 5""",
    "a5_tender_view": DEALS + f"""SELECT {cnt(TENDER)} AS tender_count, {msum('deal_value', TENDER)} AS tender_value,
      count(*) AS open_count, {msum('deal_value')} AS open_value,
      {pct(msum('deal_value', TENDER), msum('deal_value'))} AS tender_share_pct FROM d WHERE {OPEN}""",
    "a5_tender_deals": DEALS + f"""SELECT deal_alias, sector, deal_stage, deal_value, closure_probability FROM d
      WHERE {OPEN} AND {TENDER}""",
    "a6_win_loss_totals": _win_loss(),
    "a6_win_loss_totals_year": _win_loss(FY("close_date_actual")),
    "a6_win_loss_lost_only": _win_loss(lost="status IN ('Lost')"),
    "a7_win_loss_by_sector": _win_groups("sector"),
    "a7_win_loss_by_owner": _win_groups("owner_id"),
    "a7_win_loss_by_product": _win_groups("product"),
    "a8_owner_performance": DEALS + f", {_OWNERS} SELECT * FROM owners ORDER BY open_pipeline_val DESC, owner_id NULLS LAST LIMIT 10",
    "a9_unassigned_deals": DEALS + f""", {_OWNERS} SELECT CAST(count(owner_id) AS BIGINT) AS owners_count,
      CAST(coalesce(sum(CASE WHEN owner_id IS NULL THEN total_deals END), 0) AS BIGINT) AS unassigned_deals,
      {msum('open_pipeline_val', 'owner_id IS NULL')} AS unassigned_value,
      (SELECT owner_id FROM owners WHERE owner_id IS NOT NULL ORDER BY open_pipeline_val DESC LIMIT 1) AS top_owner,
      (SELECT open_pipeline_val FROM owners WHERE owner_id IS NOT NULL ORDER BY open_pipeline_val DESC LIMIT 1) AS top_owner_value
      FROM owners""",
    "a10_revenue_ladder": BOTH + f", {_ladder_cte()} SELECT * FROM ladder",
    "a10_revenue_ladder_energy_year": BOTH + ", " + _ladder_cte(
        f"sector IN ('Renewables','Powerline') AND {FY('close_date_actual')}",
        f"sector IN ('Renewables','Powerline') AND {FY('po_date')}") + " SELECT * FROM ladder",
    "a10_ladder_stages": BOTH + f""", {_ladder_cte()} SELECT u.stage, u.amount, {inr('u.amount')} AS display FROM ladder, LATERAL (VALUES
      ('1. Won Deal Bookings', won_value), ('2. Contracted Work Orders', amount_excl_gst), ('3. Invoiced Billed Value', billed_excl_gst),
      ('4. Cash Collected', collected_incl_gst), ('5. Net Accounts Receivable', receivable_amount),
      ('6. Unbilled Backlog', unbilled_backlog)) AS u(stage, amount)""",
    "a10_ladder_series": BOTH + f""", {_ladder_cte()} SELECT u.position, u.bar, round(u.v / 1e7, 2) AS value_cr FROM ladder, LATERAL (VALUES
      (1, 'Contracted', amount_excl_gst), (2, 'Billed', billed_excl_gst), (3, 'Collected', collected_incl_gst),
      (4, 'Receivable', receivable_amount), (5, 'Unbilled', unbilled_backlog)) AS u(position, bar, v)""",
    "a11_receivables": ORDERS + f"""SELECT count(*) AS total_wo, {msum('receivable_amount')} AS total_receivable,
      {msum('collected_incl_gst')} AS total_collected, {msum('billed_excl_gst')} AS total_billed,
      {cnt('receivable_amount > 0')} AS positive_debtors_count, {msum('receivable_amount', 'receivable_amount > 0')} AS positive_debtors_sum,
      {cnt('receivable_amount < 0')} AS credit_notes_count, {msum('receivable_amount', 'receivable_amount < 0')} AS credit_notes_sum FROM w""",
    "a11_receivables_mining": ORDERS + f"""SELECT count(*) AS total_wo, {msum('receivable_amount')} AS total_receivable,
      {msum('collected_incl_gst')} AS total_collected, {msum('billed_excl_gst')} AS total_billed,
      {cnt('receivable_amount > 0')} AS positive_debtors_count, {msum('receivable_amount', 'receivable_amount > 0')} AS positive_debtors_sum,
      {cnt('receivable_amount < 0')} AS credit_notes_count, {msum('receivable_amount', 'receivable_amount < 0')} AS credit_notes_sum
      FROM w WHERE lower(sector) = 'mining'""",
    "a12_top_debtors": ORDERS + f"""SELECT client_id, sector, count(*) AS wo_count, {msum('receivable_amount')} AS total_receivable,
      {msum('billed_excl_gst')} AS billed_val FROM w WHERE receivable_amount > 0 GROUP BY 1, 2
      ORDER BY total_receivable DESC, client_id, sector LIMIT 10""",
    "a13_sector_reconciliation": BOTH + f", {RECON} SELECT * FROM recon",
    "a14_sector_ranking": _ranked("contracted_excl_gst"),
    "a14_sector_ranking_open_top": _ranked("open_pipeline_val", n=1),
    "a14_sector_ranking_billed_year": _ranked("billed_excl_gst", recon=_PERIOD_RECON),
    "a14_sector_ranking_contains": _ranked("won_deal_val", "contains(lower(sector), 'power')"),
    "a15_execution_status": _exec(),
    "a15_execution_status_year": _exec(FY("start_date")),
    "a15_health_totals": ORDERS + _health(),
    "a16_delayed_orders": ORDERS + f"""SELECT deal_alias, serial_no, client_id, sector, execution_status,
      coalesce(strftime(end_date, '%Y-%m-%d'), 'N/A') AS end_date, amount_excl_gst, to_be_billed_excl_gst
      FROM w WHERE {DELAYED} ORDER BY amount_excl_gst DESC, serial_no LIMIT 10""",
    "a17_completed_unbilled": ORDERS + f"""SELECT deal_alias, serial_no, client_id, sector, amount_excl_gst FROM w WHERE {UNBILLED}
      ORDER BY amount_excl_gst DESC, serial_no LIMIT 10""",
    "a17_completed_unbilled_filter": _exec(UNBILLED),
    "a18_ongoing_orders": ORDERS + f"SELECT {cnt(ONGOING)} AS ongoing_count, {msum('amount_excl_gst', ONGOING)} AS ongoing_value FROM w",
    "a19_billing_status": ORDERS + f"SELECT billing_status, count(*) AS count, {msum('amount_excl_gst')} AS contracted_value FROM w GROUP BY 1",
    "a20_linkage_bridge": BOTH + f""", {RECON} SELECT sector, open_pipeline_val, won_deal_val, contracted_excl_gst, billed_excl_gst,
      collected_incl_gst, conversion_rate_pct FROM recon""",
    "a21_top_won_deals": DEALS + """SELECT deal_alias AS deal_name, sector, owner_id AS owner_code, deal_value FROM d
      WHERE status = 'Won' ORDER BY deal_value DESC, deal_name LIMIT 5""",
    "a22_debt_records": BOTH + f", {_DEBT} SELECT * FROM debt",
    "a23_debt_severity": BOTH + f", {_DEBT} SELECT severity, count(*) AS records FROM debt GROUP BY 1",
    "a26_stale_deals": DEALS + f"""SELECT deal_alias, client_id, sector, owner_id,
      coalesce(strftime(tentative_close_date, '%Y-%m-%d'), 'N/A') AS tentative_close, deal_value FROM d WHERE {OPEN} AND is_stale""",
    "a26_stale_totals": DEALS + f"SELECT count(*) AS stale_count, {msum('deal_value')} AS stale_value FROM d WHERE {OPEN} AND is_stale",
    "a28_compare_open_value": _compare("d", "deal_value", "tentative_close_date", DEALS, OPEN),
    "a28_compare_billed": _compare("w", "billed_excl_gst", "po_date", ORDERS),
    "a28_compare_collected_energy": _compare("w", "collected_incl_gst", "po_date", ORDERS, "sector IN ('Renewables','Powerline')",
                                             ("1997-04-01", "1998-03-31", "FY97-98"), ("1998-04-01", "1999-03-31", "FY98-99")),
    "a31_governed_metrics": _GOVERNED,
    "a31_value_conversion": BOTH + f", {RECON} SELECT sector, {pct('contracted_excl_gst', 'won_deal_val')} AS cross_board_conversion_rate FROM recon",
    "a32_ground_truth": BOTH + f", gd AS ({_TRUTH_D}), gw AS ({_TRUTH_W}) SELECT * FROM gd, gw",
    "a35_legacy_open_summary": DEALS + f"""SELECT count(*) AS total_open_deals, {msum('deal_value')} AS total_pipeline_value,
      {wsum()} AS total_weighted_pipeline, round({msum('deal_value')} / count(*), 2) AS avg_deal_size FROM d WHERE {OPEN}""",
    "a35_legacy_realization": BOTH + f""", {_ladder_cte()} SELECT wo_count AS total_work_orders, amount_excl_gst AS contracted_amount_excl_gst,
      billed_excl_gst AS billed_amount_excl_gst, collected_incl_gst AS collected_amount_incl_gst,
      unbilled_backlog AS unbilled_backlog_excl_gst, receivable_amount AS outstanding_receivables,
      round(realization_rate_pct, 2) AS realization_rate_pct, {pct('collected_incl_gst', 'billed_incl_gst', 2)} AS collection_efficiency_pct
      FROM ladder""",
    # joins and set operations
    "j2_lifecycle": BOTH + """SELECT d.deal_name, d.owner_code AS deal_owner, d.client_code AS deal_client, d.deal_status, d.deal_stage,
      d.deal_value, d.weighted_deal_value, d.sector AS deal_sector, d.closure_probability, w.serial_no AS wo_serial, w.execution_status,
      w.billing_status, w.amount_excl_gst AS wo_contracted_excl_gst, w.billed_excl_gst AS wo_billed_excl_gst,
      w.collected_incl_gst AS wo_collected_incl_gst, w.to_be_billed_excl_gst AS wo_unbilled_excl_gst,
      w.receivable_amount AS wo_receivable, CASE WHEN w.deal_name IS NOT NULL THEN 1 ELSE 0 END AS has_work_order
      FROM d LEFT JOIN w ON d.join_key = w.join_key""",
    "j3_linkage_measure": BOTH + f""", k AS (SELECT coalesce(a.join_key, b.join_key) AS key, coalesce(a.n, 0) AS deals, coalesce(b.n, 0) AS orders
      FROM (SELECT join_key, count(*) AS n FROM d GROUP BY 1) a FULL JOIN (SELECT join_key, count(*) AS n FROM w GROUP BY 1) b
      ON a.join_key = b.join_key),
      t AS (SELECT {cnt('deals > 0')} AS deal_keys, {cnt('orders > 0')} AS order_keys, {cnt('deals > 0 AND orders > 0')} AS matched_keys,
      CAST(sum(CASE WHEN orders > 0 THEN deals ELSE 0 END) AS BIGINT) AS matched_deals, CAST(sum(deals) AS BIGINT) AS all_deals,
      CAST(sum(deals * orders) AS BIGINT) AS joined_rows, CAST(max(CASE WHEN deals > 0 THEN orders ELSE 0 END) AS BIGINT) AS max_fan_out FROM k),
      c AS (SELECT count(*) AS shared_clients FROM (SELECT client_id FROM d WHERE client_id IS NOT NULL INTERSECT SELECT client_id FROM w))
      SELECT *, {pct('matched_deals', 'all_deals')} AS match_rate_pct FROM t, c""",
    "j3_unmatched_keys": BOTH + """SELECT deal_status, count(*) AS unmatched_deals FROM d
      WHERE join_key NOT IN (SELECT join_key FROM w) GROUP BY 1""",
}

_FACT_COLS = "id, metric, value_double, unit, display, must_mention, role"
SQL["facts_pipeline_summary"] = f"""WITH t AS ({_totals(OPEN)}) SELECT {_FACT_COLS} FROM t, LATERAL (VALUES
  ('F1','open_pipeline_value', open_value, 'INR', {inr('open_value')}, TRUE, 'primary'),
  ('F2','open_deals_count', CAST(open_count AS DOUBLE), 'count', {count_text('open_count', 'deals')}, FALSE, 'support'),
  ('F3','weighted_pipeline_value', weighted_value, 'INR', {inr('weighted_value')}, FALSE, 'support'),
  ('F4','tender_share_pct', round(tender_share_pct, 1), 'pct', {pct_text('round(tender_share_pct, 1)')}, FALSE, 'caveat'),
  ('F5','stale_deals_count', CAST(stale_count AS DOUBLE), 'count', {count_text('stale_count', 'deals')}, FALSE, 'caveat'),
  ('F6','avg_deal_size', avg_deal_size, 'INR', {inr('avg_deal_size')}, FALSE, 'support'))
  AS u({_FACT_COLS})"""
SQL["facts_revenue_ladder"] = BOTH + f""", {_ladder_cte()} SELECT {_FACT_COLS} FROM ladder, LATERAL (VALUES
  ('F1','billed_work_orders', billed_excl_gst, 'INR', {inr('billed_excl_gst')}, TRUE, 'primary'),
  ('F2','wo_contracted_value', amount_excl_gst, 'INR', {inr('amount_excl_gst')}, TRUE, 'support'),
  ('F3','realization_rate_pct', round(realization_rate_pct, 1), 'pct', {pct_text('round(realization_rate_pct, 1)')}, FALSE, 'support'),
  ('F4','wo_collected_value', collected_incl_gst, 'INR', {inr('collected_incl_gst')}, TRUE, 'support'),
  ('F5','wo_receivable_value', receivable_amount, 'INR', {inr('receivable_amount')}, TRUE, 'support'),
  ('F6','unbilled_backlog', unbilled_backlog, 'INR', {inr('unbilled_backlog')}, FALSE, 'support'),
  ('F7','won_deal_value', won_value, 'INR', {inr('won_value')}, FALSE, 'support')) AS u({_FACT_COLS})"""
SQL["j1_sector_join"] = BOTH + f""", {RECON} SELECT sector, total_deals, open_deals_count, open_pipeline_value, won_deals_count, won_deal_value FROM recon"""
SQL["j4_scalar_combine"] = BOTH + f""", {_ladder_cte()} SELECT * EXCLUDE (realization_rate_pct, collection_rate_pct, unbilled_backlog) FROM ladder"""
SQL["o1_top_won_ten"] = SQL["a21_top_won_deals"].replace("LIMIT 5", "LIMIT 10")
SQL["o2_full_sort"] = SQL["a5_tender_deals"]
SQL["o3_rule_union"] = BOTH + f", {_DEBT} SELECT issue_category, type, count(*) AS records FROM debt GROUP BY 1, 2"


def _fact_rows(prefix: str, source: str, rows: list[tuple]) -> str:
    """Facts from a one-row source: (id, metric, value, unit, noun, must_mention, role)."""
    def line(i, metric, value, unit, noun, must, role):
        v = f"CAST({value} AS DOUBLE)"
        if unit == "pct":
            v = f"round({v}, 1)"
        shown = inr(v) if unit == "INR" else pct_text(v) if unit == "pct" else count_text(value, noun)
        return f"('F{i}', '{metric}', {v}, '{unit}', {shown}, {str(must).upper()}, '{role}')"
    values = ", ".join(line(*r) for r in rows)
    return f"{prefix} SELECT {_FACT_COLS} FROM {source}, LATERAL (VALUES {values}) AS u({_FACT_COLS})"


_wl = f"WITH t AS ({_win_loss()})"
SQL["facts_win_loss_analysis"] = _fact_rows(_wl, "t", [
    (1, "won_deals_count", "won_count", "count", "deals", True, "support"),
    (2, "won_deals_value", "won_value", "INR", "", True, "primary"),
    (3, "win_rate_count", "win_rate_count", "pct", "", False, "support"),
    (4, "win_rate_value", "win_rate_value", "pct", "", False, "support"),
    (5, "lost_deals_count", "lost_count", "count", "deals", False, "support")])
SQL["facts_owner_performance"] = _fact_rows(f"WITH t AS ({SQL['a9_unassigned_deals']})", "t", [
    (1, "active_owners_count", "owners_count", "count", "owners", False, "support"),
    (2, "unassigned_deals_count", "unassigned_deals", "count", "deals", False, "caveat"),
    (3, "top_owner_pipeline", "top_owner_value", "INR", "", False, "primary")])
_rec = f"WITH t AS ({SQL['a11_receivables']})"
SQL["facts_receivables_summary"] = _fact_rows(_rec, "t", [
    (1, "wo_receivable_value", "total_receivable", "INR", "", True, "primary"),
    (2, "credit_notes_count", "credit_notes_count", "count", "credits", False, "caveat"),
    (3, "gross_receivable_positive", "positive_debtors_sum", "INR", "", False, "support"),
    (4, "outstanding_receivables", "total_receivable", "INR", "", False, "support")])
SQL["facts_collected_cash"] = _fact_rows(_rec, "t", [
    (1, "collected_cash", "total_collected", "INR", "", True, "primary"),
    (2, "total_billed_value", "total_billed", "INR", "", False, "support"),
    (3, "outstanding_receivables", "total_receivable", "INR", "", False, "support")])
_hl = f"WITH t AS ({ORDERS + _health()})"
SQL["facts_workorder_health"] = _fact_rows(_hl, "t", [
    (1, "total_work_orders", "total_orders", "count", "work orders", True, "primary"),
    (2, "completed_work_orders_count", "completed_count", "count", "completed", False, "support"),
    (3, "completion_rate_pct", "completion_rate_pct", "pct", "", False, "support"),
    (4, "delayed_work_orders_count", "delayed_count", "count", "delayed", False, "caveat"),
    (5, "completed_unbilled_count", "completed_unbilled_count", "count", "orders", False, "caveat"),
    (6, "completed_unbilled_value", "completed_unbilled_value", "INR", "", False, "caveat")])
SQL["facts_ongoing_orders"] = _fact_rows(_hl, "t", [
    (1, "ongoing_orders", "ongoing_count", "count", "orders", True, "primary"),
    (2, "ongoing_contracted_value", "ongoing_value", "INR", "", False, "support"),
    (3, "total_work_orders", "total_orders", "count", "total", False, "support")])
SQL["facts_tender_mode"] = _fact_rows(f"WITH t AS ({SQL['a5_tender_view']})", "t", [
    (1, "tender_share_pct", "tender_share_pct", "pct", "", True, "primary"),
    (2, "tender_pipeline_value", "tender_value", "INR", "", False, "support"),
    (3, "tender_deal_count", "tender_count", "count", "deals", False, "support"),
    (4, "open_pipeline", "open_value", "INR", "", False, "support")])
SQL["facts_compare_periods"] = _fact_rows(f"WITH t AS ({SQL['a28_compare_billed']})", "t", [
    (1, "billed_FY98-99 Q1", "value_a", "INR", "", True, "support"),
    (2, "billed_FY98-99 Q2", "value_b", "INR", "", True, "support"),
    (3, "billed_delta_value", "delta", "INR", "", True, "support"),
    (4, "billed_delta_pct", "delta_pct", "pct", "", True, "support")])
SQL["facts_stale_deals"] = _fact_rows(f"WITH t AS ({SQL['a26_stale_totals']})", "t", [
    (1, "stale_deals_count", "stale_count", "count", "stale deals", True, "primary"),
    (2, "stale_deals_value", "stale_value", "INR", "", False, "support")])
