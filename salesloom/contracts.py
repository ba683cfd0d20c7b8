"""Business contracts: the constants every operator agrees on.

Everything below is a fixed value - a list, table, weight, pattern or format
that has to be the same everywhere for results to be right.
"""

from __future__ import annotations

import datetime as dt

# --- Fixed values: reporting date -------------------------------------------
DEFAULT_AS_OF = dt.date(2026, 1, 15)
SNAPSHOT_TTL_SECONDS = 600

# --- Fixed values: sectors ---------------------------------------------------
# Spelling repair for the sector column of a board (unknown values pass through).
SECTOR_SPELLINGS = {
    "renewables": "Renewables",
    "powerline": "Powerline",
    "powerlines": "Powerline",
    "mining": "Mining",
    "infrastructure": "Infrastructure",
    "tender": "Tender",
    "gis": "GIS",
    "defence": "Defence",
    "forestry": "Forestry",
    "agriculture": "Agriculture",
    "urban planning": "Urban Planning",
    "water bodies": "Water Bodies",
}
UNSPECIFIED_SECTOR = "Unspecified"

# The nine reporting sectors and the words that fall into each.
CANONICAL_SECTORS = {
    "Mining": ["mining", "quarry", "mines", "extraction", "coal"],
    "Renewables": ["renewables", "solar", "wind", "green energy", "pv"],
    "Powerline": ["powerline", "power", "powerlines", "transmission", "substation", "grid", "electrical"],
    "Utilities": ["utilities", "utility", "water", "pipeline", "gas"],
    "Infrastructure": ["infrastructure", "infra", "highways", "roads", "railways", "urban", "construction",
                       "smart city"],
    "Agriculture": ["agriculture", "agri", "crop", "plantation", "farming"],
    "Security & Surveillance": ["security & surveillance", "security and surveillance", "security",
                                "surveillance", "defense", "perimeter", "police"],
    "Tender": ["tender", "govt tender", "bids", "public tender", "rfp", "e-procurement"],
    "Other": ["other", "others", "unspecified", "dsp", "manufacturing", "aviation", "misc", "general",
              "unclassified"],
}
ENERGY_SECTORS = ["Renewables", "Powerline"]
ENERGY_GROUP_NAMES = ["energy", "energy_group", "energy cluster"]
OUTLIER_SECTOR = "Tender"

# --- Fixed values: deals -----------------------------------------------------
PROBABILITY_WEIGHTS = {"High": "0.80", "Medium": "0.50", "Low": "0.20"}
DEFAULT_PROBABILITY_WEIGHT = "0.30"
LOST_STATUSES = ["Lost", "Dead"]

DEAL_COLUMNS = {
    "Deal Name": "deal_alias",
    "Owner code": "owner_id",
    "Client Code": "client_id",
    "Deal Status": "status",
    "Close Date (A)": "close_date_actual",
    "Closure Probability": "closure_probability",
    "Masked Deal value": "deal_value",
    "Tentative Close Date": "tentative_close_date",
    "Deal Stage": "stage_raw",
    "Product deal": "product",
    "Sector/service": "sector_raw",
    "Created Date": "created_date",
}
DEAL_DATES = ["close_date_actual", "tentative_close_date", "created_date"]

# --- Fixed values: work orders -----------------------------------------------
ORDER_COLUMNS = {
    "Deal name masked": "deal_alias",
    "Customer Name Code": "client_id",
    "Serial #": "serial_no",
    "Nature of Work": "nature_of_work",
    "Last executed month of recurring project": "last_executed_month",
    "Execution Status": "execution_status",
    "Data Delivery Date": "data_delivery_date",
    "Date of PO/LOI": "po_date",
    "Document Type": "document_type",
    "Probable Start Date": "start_date",
    "Probable End Date": "end_date",
    "BD/KAM Personnel code": "owner_id",
    "Sector": "sector_raw",
    "Type of Work": "type_of_work",
    "Last invoice date": "last_invoice_date",
    "latest invoice no.": "latest_invoice_no",
    "Amount in Rupees (Excl of GST) (Masked)": "amount_excl_gst",
    "Amount in Rupees (Incl of GST) (Masked)": "amount_incl_gst",
    "Billed Value in Rupees (Excl of GST.) (Masked)": "billed_excl_gst",
    "Billed Value in Rupees (Incl of GST.) (Masked)": "billed_incl_gst",
    "Collected Amount in Rupees (Incl of GST.) (Masked)": "collected_incl_gst",
    "Amount to be billed in Rs. (Exl. of GST) (Masked)": "to_be_billed_excl_gst",
    "Amount to be billed in Rs. (Incl. of GST) (Masked)": "to_be_billed_incl_gst",
    "Amount Receivable (Masked)": "receivable_amount",
    "AR Priority account": "ar_priority",
    "Quantity by Ops": "quantity_ops",
    "Quantities as per PO": "quantity_po",
    "Quantity billed (till date)": "quantity_billed",
    "Balance in quantity": "quantity_balance",
    "Invoice Status": "invoice_status",
    "Expected Billing Month": "expected_billing_month",
    "Actual Billing Month": "actual_billing_month",
    "Actual Collection Month": "actual_collection_month",
    "WO Status (billed)": "wo_status_billed",
    "Collection status": "collection_status",
    "Collection Date": "collection_date",
    "Billing Status": "billing_status",
}
# One board column carries a vendor's name in its title; it is found by this pattern instead.
SOFTWARE_COLUMN_PATTERN = r"(?i)^is any .*software platform part of the client deliverables.*"
SOFTWARE_COLUMN = "has_software"
ORDER_MONEY = [
    "amount_excl_gst",
    "amount_incl_gst",
    "billed_excl_gst",
    "billed_incl_gst",
    "collected_incl_gst",
    "to_be_billed_excl_gst",
    "to_be_billed_incl_gst",
    "receivable_amount",
]
ORDER_DATES = ["data_delivery_date", "po_date", "start_date", "end_date", "last_invoice_date", "collection_date"]
EXECUTION_SPELLINGS = {
    "Pause / struck": "Paused/Stuck",
    "Executed until current month": "Ongoing (Monthly)",
}
NOT_DELAYED_STATUSES = ["Completed", "Ongoing (Monthly)"]
HEADER_MARKERS = ["deal name", "contract value", "work order"]
HEADER_PROBE_ROWS = 5
HEADER_DEFAULT_ROW = 1

# --- Fixed values: data-quality rules: code -> (name, severity, description, resolution)
DQ_RULES = {
    "DQ001": ("Stray Repeated Header Rows", "HIGH",
              "Header rows repeated inside the data.", "Rows whose status equals the column name are dropped."),
    "DQ002": ("Exact Duplicate Records", "HIGH",
              "Rows identical in every column.", "One copy is kept."),
    "DQ003": ("Missing Deal Values", "MEDIUM",
              "Deals without a usable value.", "Counted as 0.0; known and unknown values are tracked."),
    "DQ004": ("Missing Entity Identifiers", "LOW",
              "Deals without an owner or a client.", "Placeholders UNASSIGNED / UNKNOWN_CLIENT are used."),
    "DQ005": ("Stale Open Pipeline Deals", "HIGH",
              "Open deals whose tentative close date is past.", "Flagged as is_stale."),
    "DQ006": ("Won Status with Early Pipeline Stage", "MEDIUM",
              "Won deals still at the first stage.", "Status is authoritative."),
    "DQ007": ("Pipeline Outlier Concentration", "HIGH",
              "Share of one outlier sector in open value.", "Views with and without the outliers."),
    "DQ008": ("Fully Empty Columns", "LOW",
              "Columns without any value.", "Reported; dropped on request."),
    "DQ009": ("Negative Accounts Receivable (Credits)", "MEDIUM",
              "Orders with a credit balance.", "Kept in the net sum, listed separately."),
    "DQ010": ("Completed Work Orders Missing Delivery Date", "MEDIUM",
              "Completed orders without a delivery date.", "Flagged for backfill."),
    "DQ011": ("Overdue Incomplete Work Orders", "HIGH",
              "Unfinished orders past their end date.", "Flagged as is_overdue."),
    "DQ013": ("Billing Status Case Inconsistency", "LOW",
              "Misspelt billing status.", "Spelling repaired."),
    "DQ014": ("Unbilled Rows Represented as Null", "INFO",
              "Null billed value means unbilled work.", "Counted as 0.0 in sums."),
    "DQ015": ("Independent Alias Masking Across Boards", "INFO",
              "The boards mask names independently.", "Boards meet at sector level only."),
    "DQ016": ("Client Code Range Mismatch", "INFO",
              "Client code ranges differ between boards.", "No client join across boards."),
}
LAST_DEALS_RULE = 7
DQ_SAMPLE_SIZE = 5
DQ_EXPORT_HEADERS = {
    "code": "DQ Code",
    "rule_name": "Rule Name",
    "severity": "Severity",
    "affected_count": "Affected Rows",
    "description": "Description",
    "resolution": "Resolution Strategy",
    "sample_identifiers": "Sample Identifiers",
}

# --- Fixed values: governed metrics: key -> (name, unit, description, formula)
METRICS = {
    "total_deals": ("Total Deals Count", "count", "All deals.", "count of deals"),
    "open_deals_count": ("Open Deals Count", "count", "Open deals.", "count of deals with status Open"),
    "open_deals_value": ("Open Pipeline Value", "INR", "Unweighted value of open deals.",
                         "sum of deal_value over open deals"),
    "weighted_open_pipeline": ("Weighted Open Pipeline Value", "INR",
                               "Open value times closing probability.",
                               "sum of weighted_deal_value over open deals"),
    "won_deals_count": ("Won Deals Count", "count", "Won deals.", "count of deals with status Won"),
    "won_deals_value": ("Won Deals Value", "INR", "Value of won deals.", "sum of deal_value over won deals"),
    "tender_open_pipeline": ("Tender Sector Open Pipeline", "INR", "Open value in the Tender sector.",
                             "sum of deal_value over open Tender deals"),
    "non_tender_open_pipeline": ("Non-Tender Open Pipeline", "INR", "Open value outside Tender.",
                                 "sum of deal_value over open non-Tender deals"),
    "energy_open_pipeline": ("Energy Open Pipeline", "INR", "Open value in the energy sectors.",
                             "sum of deal_value over open Renewables and Powerline deals"),
    "total_work_orders": ("Total Work Orders Count", "count", "All work orders.", "count of work_orders"),
    "contracted_amount_excl_gst": ("Contracted Work Orders (Excl. GST)", "INR", "Contracted value before tax.",
                                   "sum of amount_excl_gst"),
    "billed_amount_excl_gst": ("Billed Work Orders (Excl. GST)", "INR", "Invoiced value before tax.",
                               "sum of billed_excl_gst"),
    "collected_amount_incl_gst": ("Collected Revenue (Incl. GST)", "INR", "Cash received with tax.",
                                  "sum of collected_incl_gst"),
    "unbilled_backlog_excl_gst": ("Unbilled Work Order Backlog", "INR", "Value still to be invoiced.",
                                  "sum of to_be_billed_excl_gst"),
    "net_receivable_amount": ("Net Accounts Receivable", "INR", "Unpaid invoices minus credits.",
                              "sum of receivable_amount"),
    "revenue_realization_rate": ("Revenue Realization Rate", "percentage",
                                 "Share of contracted value that is billed.",
                                 "(billed_amount_excl_gst / contracted_amount_excl_gst) * 100"),
    "collection_efficiency_rate": ("Collection Efficiency Rate", "percentage",
                                   "Share of billed value that is collected.",
                                   "(collected_amount_incl_gst / billed_amount_incl_gst) * 100"),
    "cross_board_conversion_rate": ("Cross-Board Sector Conversion Rate", "percentage",
                                    "Contracted value against won value, by sector.",
                                    "(contracted_wo_amount / won_deal_value) * 100"),
}

# --- Fixed values: question keywords ------------------------------------------
REFUSAL_TERMS = [
    "ignore your instructions", "ignore previous instructions", "ignore all previous instructions",
    "bypass instructions", "system prompt", "dump all", "drop table", "drop database", "alter table",
    "delete from", "insert into", "union select",
    "list all clients", "all client names", "dump clients", "export all clients", "list every client",
]
OUT_OF_SCOPE_TERMS = [
    "profit margin", "cogs", "cost of goods", "burn rate", "overhead", "salaries", "operating expense",
    "ebitda", "net profit", "weather", "recipe", "joke", "movie", "poem", "who won the", "cricket", "football",
]
# (words, period) in order; the quarter years follow the reporting date.
QUESTION_PERIODS = [
    (["this quarter", "current quarter", "q4"], "Q4 FY25-26"),
    (["q3"], "Q3 FY25-26"),
    (["q2"], "Q2 FY25-26"),
    (["q1"], "Q1 FY25-26"),
    (["fy25-26"], "FY25-26"),
    (["fy24-25"], "FY24-25"),
    (["fy26-27"], "FY26-27"),
]
EXPLICIT_PERIOD_TOKENS = ["fy24-25", "fy25-26", "fy26-27", "q1", "q2", "q3", "q4"]
DEAL_TYPE_TERMS = ["tender", "tenders", "bid", "bids"]
QUESTION_SECTORS = [
    ("energy", "Energy"),
    ("powerline", "Powerline"),
    ("power", "Energy"),
    ("renewables", "Renewables"),
    ("renewable", "Renewables"),
    ("solar", "Renewables"),
    ("wind", "Renewables"),
    ("utility", "Utilities"),
    ("utilities", "Utilities"),
    ("mining", "Mining"),
    ("infra", "Infrastructure"),
    ("infrastructure", "Infrastructure"),
    ("agri", "Agriculture"),
    ("agriculture", "Agriculture"),
    ("security", "Security & Surveillance"),
    ("surveillance", "Security & Surveillance"),
]
FOLLOW_UP_OPENERS = ["what about", "how about", "and ", "what if", "tell me about"]
FOLLOW_UP_MAX_WORDS = 4
TASK_TERMS = [
    ("rank", ["rank", "top", "biggest", "highest", "leader", "largest"]),
    ("compare", ["compare", "versus", "vs", "variance", "difference", "better"]),
    ("trend", ["trend", "waterfall", "ladder", "over time", "quarterly", "growth"]),
    ("diagnose", ["diagnose", "health", "quality", "debt", "scorecard", "dirty", "hygiene", "anomaly", "issue",
                  "stale"]),
    ("summarize", ["summarize", "brief", "executive", "overview", "pulse", "leadership"]),
]
DEFAULT_TASK = "lookup"
TOP_ONE_TERMS = ["top 1", "biggest"]
CHART_TASKS = ["rank", "trend", "compare", "summarize"]

# Router rules in order. Each: all word groups must hit; tool; fixed arguments; extras.
ROUTES = [
    {"any": [["tender", "tenders", "bid", "bids"]], "tool": "pipeline_summary", "args": {"deal_type": "Tender"}},
    {"any": [["cash", "collected", "money received"]], "tool": "receivables_summary",
     "args": {"metric": "collected_cash"}},
    {"any": [["stale", "inactive", "stalled", "aged deals", "idle deals"]], "tool": "data_debt_list",
     "args": {"type": "stale_open_deals"}},
    {"any": [["ongoing", "active", "in progress", "in-progress"], ["work order", "order", "delivery", "project"]],
     "tool": "work_order_health", "args": {"status": "Ongoing"}},
    {"any": [["rank", "biggest", "top sector", "largest sector", "compare sector"]], "tool": "sector_performance",
     "args": {"metric": "open_pipeline"}, "top_one": ["biggest", "top 1", "largest", "leader"]},
    {"any": [["conversion", "deal to work order", "link", "linkage", "cross board", "cross-board", "fk",
              "foreign key", "join deals"]], "tool": "link_deals_to_orders"},
    {"any": [["pipeline", "deals", "funnel", "open"]], "needs_sector": True, "tool": "pipeline_summary",
     "pass": ["sector", "period"]},
    {"any": [["revenue", "billed", "contracted", "waterfall", "ladder"]], "tool": "revenue_ladder"},
    {"any": [["receivable", "debtor", "aging", "overdue", "credit note", "outstanding"]],
     "tool": "receivables_summary", "args": {"metric": "outstanding_receivables"}},
    {"any": [["brief", "executive", "leadership", "kpi", "pulse"]], "tool": "leadership_brief"},
    {"any": [["win rate", "win loss", "loss", "closed"]], "tool": "win_loss_analysis"},
    {"any": [["rep", "owner", "quota", "salesperson", "bd"]], "tool": "owner_performance"},
    {"any": [["delay", "health", "execution", "work order", "backlog", "unbilled"]], "tool": "work_order_health"},
    {"any": [["compare", "growth", "versus", "variance"]], "tool": "compare_periods"},
    {"any": [["explain", "definition", "formula", "metric"]], "tool": "explain_metric"},
    {"any": [["data quality", "dq", "hygiene", "scorecard", "anomalies"]], "tool": "data_quality_report"},
    {"any": [["debt", "dirty", "ops list", "remediation", "unassigned"]], "tool": "data_debt_list"},
    {"any": [["help", "tools", "capabilities", "what can you do"]], "tool": "list_capabilities"},
    {"any": [["sector", "cross-board", "comparison by sector", "multi-sector"]], "tool": "sector_performance"},
]
DEFAULT_ROUTE = {"tool": "pipeline_summary", "pass": ["sector", "period"]}

# Ambiguous words: term -> (what is unclear, question to ask back, options)
AMBIGUOUS_TERMS = {
    "revenue": ("Ambiguous revenue scope (sales pipeline vs. billed vs. cash receipts)",
                "Are you inquiring about Won Deal Value from sales, Invoiced Billed Work Orders, or Cash Receipts?",
                ["Won Deals (Sales Pipeline)", "Billed Work Orders (Recognized Revenue)", "Cash Collected"]),
    "pipeline": ("Ambiguous pipeline valuation method",
                 "Would you like to analyze raw unweighted deal value or probability-weighted pipeline?",
                 ["Raw Unweighted Pipeline", "Weighted Pipeline (Risk-Adjusted)"]),
    "delays": ("Ambiguous operational vs sales backlog",
               "Would you like to examine delayed operational Work Orders or stalled sales pipeline deals?",
               ["Overdue Operational Work Orders", "Stalled Sales Deals"]),
    "debt": ("Ambiguous financial AR debt vs CRM data hygiene debt",
             "Are you reviewing Accounts Receivable debtor balances or CRM data quality debt (DQ001-DQ016)?",
             ["Accounts Receivable Balances", "Data Quality & Hygiene Debt"]),
}

# --- Fixed values: entity tokens: type -> (rank, prefix, digits)
TOKEN_FORMATS = {
    "owner": (0, "OWNER_REP_", 2),
    "client": (1, "CLIENT_ENT_", 3),
    "deal": (2, "PROJECT_DEAL_", 3),
}
CLIENT_HINTS = ["company", "client"]
OWNER_HINTS = ["owner", "rep"]
CLIENT_COLUMNS = ["client_id", "client_code", "client_token", "deal_client"]
OWNER_COLUMNS = ["owner_id", "owner_code", "owner_token", "deal_owner"]
DEAL_NAME_COLUMNS = ["deal_alias", "deal_name", "order_token", "deal_token"]
MIN_MASKED_LENGTH = 2
MIN_LEAK_LENGTH = 4

# --- Fixed values: answer checking ----------------------------------------------
FACT_REFERENCE = r"\[\[(F\d+)\]\]"
NUMBER = r"\b\d+(?:\.\d+)?\b"
# Numbers that are labels, not claims; masked in this order.
NON_CLAIMS = [
    r"(?i)\[\[F\d+\]\]",
    r"(?i)\bDQ\d{3}\b",
    r"(?i)\b\d{1,2}(?:st|nd|rd|th)?\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*(?:\s*,?\s*\d{4})?\b",
    r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2}(?:st|nd|rd|th)?(?:\s*,?\s*\d{4})?\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"(?i)\b(?:30|60|90|180|365)\s*-?\s*days?\b",
    r"(?i)\b(?:15|16)\s+(?:active\s+)?(?:DQ|data\s+quality)\s+(?:rules?|codes?|checks?|anomalies)\b",
    r"(?i)\bQ[1-4](?:\s*FY\d{2}(?:-\d{2})?)?\b",
    r"(?i)\bFY\s*\d{2}(?:-\d{2})?\b",
    r"(?i)\b\d+(?:st|nd|rd|th)\b",
    r"(?i)\btop\s+\d+\b",
    r"\b(?:19\d{2}|20\d{2})\b",
    r"(?m)^\s*\d+\.\s+",
]
NON_CLAIM_MARK = " <NON_CLAIM> "
CLAIMS = {
    "currency": r"(?i)(?:₹|Rs\.?|INR)\s*[\d,]+(?:\.\d+)?(?:\s*(?:Cr|Crore|Lakh|L))?",
    "scaled": r"(?i)[\d,]+(?:\.\d+)?\s*(?:Cr|Crore|Lakh)",
    "percent": r"(?i)[\d,]+(?:\.\d+)?%",
    "counted": r"(?i)[\d,]+(?:\.\d+)?\s*(?:deals?|work orders?|orders?|records?|rules?|days?|rows?|sectors?|clients?"
               r"|accounts?|projects?)",
    "ratio": r"(?i)\b\d+(?:\.\d+)?(?::\d+(?:\.\d+)?|x\b)",
}
BARE_NUMBER_NOISE = r"[₹$,%]"
# Numbers that need no source: small counts and calendar days, ageing steps, 100, years.
ALLOWED_NUMERALS = [*range(0, 32), 60, 90, 180, 365, 100, 2023, 2024, 2025, 2026, 2027]
MATCH_ABSOLUTE = 0.05
MATCH_RELATIVE = 0.01
DOUBLED_NOUNS = r"(?i)\b(deals?|work orders?|orders?|sectors?|records?|rows?)\s+\1\b"
BLOCK_LIMITS = {  # task -> (kpi cards, chart, table rows, notes)
    "lookup": (1, 0, 0, 2),
    "rank": (1, 1, 10, 2),
    "trend": (1, 1, 10, 2),
    "compare": (2, 0, 0, 2),
    "diagnose": (0, 0, 10, 4),
    "summarize": (4, 1, 10, 2),
}

# --- Fixed values: event log -------------------------------------------------------
RUN_STAGES = ["understand", "plan", "fetch", "normalize", "compute", "narrate", "verify", "finalize"]
RECENT_RUNS = 1000
ADMISSION_LIMIT = 60
ADMISSION_WINDOW_SECONDS = 60
BUCKET_RATE = 10.0
BUCKET_CAPACITY = 60.0
DAILY_BUDGET = 800
BUDGET_WINDOW_SECONDS = 86400

# --- Fixed values: answer text labels ------------------------------------------------
ANSWER_LABELS = ["direct answer", "answer", "executive summary", "key takeaways", "overview"]
ANSWER_LABEL_PREFIX = r"(?i)^(?:direct answer|answer|executive summary|key takeaways)[\s:\-]+"
FIRST_SENTENCE_LIMIT = 120
