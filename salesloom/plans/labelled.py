"""Labelled questions for routing checks. Fixed values."""

# id, question, group, expected task, expected tool, expected arguments
QUESTIONS = [
    ("Q01", "How's our pipeline looking for the energy sector this quarter?", "energy_pipeline_q4", "lookup",
     "pipeline_summary", {"sector": "Energy", "period": "Q4 FY25-26"}),
    ("Q02", "What is the open pipeline for energy in Q4 FY25-26?", "energy_pipeline_q4", "lookup",
     "pipeline_summary", {"sector": "Energy", "period": "Q4 FY25-26"}),
    ("Q03", "Show me Q4 energy pipeline opportunities and valuation.", "energy_pipeline_q4", "lookup",
     "pipeline_summary", {"sector": "Energy", "period": "Q4 FY25-26"}),
    ("Q04", "Which sector has the biggest open pipeline?", "sector_ranking", "rank", "sector_performance",
     {"metric": "open_pipeline", "top_n": "1"}),
    ("Q05", "Rank sectors by open pipeline value.", "sector_ranking", "rank", "sector_performance",
     {"metric": "open_pipeline"}),
    ("Q06", "What is our top sector by pipeline opportunity size?", "sector_ranking", "rank", "sector_performance",
     {"metric": "open_pipeline", "top_n": "1"}),
    ("Q07", "How much of the pipeline is Tender?", "tender_concentration", "lookup", "pipeline_summary",
     {"deal_type": "Tender"}),
    ("Q08", "What percentage of open deals are tender bids?", "tender_concentration", "lookup", "pipeline_summary",
     {"deal_type": "Tender"}),
    ("Q09", "Show me the tender deal concentration and volume.", "tender_concentration", "lookup",
     "pipeline_summary", {"deal_type": "Tender"}),
    ("Q10", "What did we bill against contracted value?", "revenue_ladder", "summarize", "revenue_ladder", {}),
    ("Q11", "Show me the revenue realization ladder.", "revenue_ladder", "summarize", "revenue_ladder", {}),
    ("Q12", "How much revenue is billed compared to total contracted work orders?", "revenue_ladder", "summarize",
     "revenue_ladder", {}),
    ("Q13", "How much cash have we collected?", "cash_collections", "lookup", "receivables_summary", {}),
    ("Q14", "What is our total collected cash amount?", "cash_collections", "lookup", "receivables_summary", {}),
    ("Q15", "Show total customer collections on a bank receipt basis.", "cash_collections", "lookup",
     "receivables_summary", {}),
    ("Q16", "Which work orders are still ongoing?", "ongoing_work_orders", "diagnose", "work_order_health",
     {"status": "Ongoing"}),
    ("Q17", "Show active or ongoing work orders.", "ongoing_work_orders", "diagnose", "work_order_health",
     {"status": "Ongoing"}),
    ("Q18", "How many work orders are currently in progress?", "ongoing_work_orders", "diagnose",
     "work_order_health", {"status": "Ongoing"}),
    ("Q19", "Any stale open deals?", "stale_deals", "diagnose", "data_debt_list", {"type": "stale_open_deals"}),
    ("Q20", "Which open pipeline deals have had no activity for over 90 days?", "stale_deals", "diagnose",
     "data_debt_list", {"type": "stale_open_deals"}),
    ("Q21", "Show me inactive or stalled pipeline opportunities.", "stale_deals", "diagnose", "data_debt_list",
     {"type": "stale_open_deals"}),
    ("Q22", "How healthy is our data?", "data_health", "diagnose", "data_quality_report", {}),
    ("Q23", "Show me the data quality ledger report and anomaly count.", "data_health", "diagnose",
     "data_quality_report", {}),
    ("Q24", "What data quality issues exist in our CRM and operations data?", "data_health", "diagnose",
     "data_quality_report", {}),
    ("Q25", "What about Mining?", "conversational_followup", "lookup", "pipeline_summary", {"sector": "Mining"}),
    ("Q26", "What is the pipeline value for Mining?", "mining_pipeline", "lookup", "pipeline_summary",
     {"sector": "Mining"}),
    ("Q27", "What is our outstanding receivables balance?", "receivables", "lookup", "receivables_summary", {}),
    ("Q28", "How much money is pending collection from billed work orders?", "receivables", "lookup",
     "receivables_summary", {}),
    ("Q29", "What's our profit margin?", "out_of_scope", "summarize", None, {}),
    ("Q30", "Can we join deals and work orders directly?", "cross_board_refusal", "diagnose",
     "data_quality_report", {}),
]
