"""Normalisation and tools on small frames with every kind of dirt."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesloom import contracts as C
from salesloom.operators import deals as D
from salesloom.operators import normalize as N
from salesloom.operators import orders as O
from salesloom.operators import quality as Q
from salesloom.operators import sectors as X
from salesloom.plans import registry
from salesloom.sources import boards, event_capture, sheets, snapshots

AS_OF = dt.date(2026, 1, 15)
TITLES = list(C.DEAL_COLUMNS)
ROWS = [
    ("Alpha", "O1", "C1", "Open", None, "High", "100.50", "2026-01-10", "A. Lead Generated", "p", "tender", "2025-05-01"),
    ("Alpha", "O1", "C1", "Open", None, "High", "100.50", "2026-01-10", "A. Lead Generated", "p", "tender", "2025-05-01"),
    ("Beta", None, "C2", "Won", "2025-12-01", "low", "bad", "2025-11-01", "A. Lead Generated", "p", None, "2025-05-01"),
    tuple(TITLES),
    ("Gamma", " ", "C3", "Open", "nonsense", None, "50", "2026-02-01", "B. Qualified", "q", "Solar", "01/02/2025"),
    ("Delta", "O2", None, "Dead", None, "Medium", None, None, None, None, "", None),
]


@pytest.fixture(scope="module")
def sheet(spark):
    return spark.createDataFrame(ROWS, ", ".join(f"`{t}` string" for t in TITLES))


@pytest.fixture(scope="module")
def clean(sheet):
    return N.normalize_deals(sheet, AS_OF)


def test_clean_deals(clean):
    rows = {r["deal_alias"]: r for r in clean.rows.collect()}
    assert len(rows) == 4
    assert rows["Beta"]["deal_value"] == 0.0 and rows["Beta"]["prob_weight"] == 0.3
    assert rows["Beta"]["owner_code"] == "UNASSIGNED" and rows["Beta"]["owner_id"] is None
    assert rows["Alpha"]["is_stale"] is True and rows["Gamma"]["is_stale"] is False
    assert rows["Delta"]["is_stale"] is False and rows["Delta"]["deal_stage"] == "Unknown"
    assert rows["Gamma"]["close_date_actual"] is None
    assert rows["Gamma"]["created_date"] == dt.datetime(2025, 1, 2)
    assert rows["Beta"]["fiscal_quarter"] == "Q3" and rows["Delta"]["fiscal_year"] is None
    assert rows["Alpha"]["sector"] == "Tender" and rows["Delta"]["sector"] == "Unspecified"


def test_deal_ledger(clean):
    led = {r["code"]: r for r in clean.ledger.collect()}
    counts = {k: v["affected_count"] for k, v in led.items()}
    assert counts == {"DQ001": 1, "DQ002": 1, "DQ003": 2, "DQ004": 3, "DQ005": 1, "DQ006": 1, "DQ007": 1}
    assert led["DQ005"]["sample_identifiers"] == ["Alpha"] and led["DQ007"]["sample_identifiers"] == ["Alpha"]
    assert "66.8%" in led["DQ007"]["description"]


def test_empty_board(spark):
    empty = spark.createDataFrame([], ", ".join(f"`{t}` string" for t in TITLES))
    led = {r["code"]: r["affected_count"] for r in N.normalize_deals(empty, AS_OF).ledger.collect()}
    assert len(led) == 7 and set(led.values()) == {0}


def test_raw_rows_add_up(sheet, clean):
    led = {r["code"]: r["affected_count"] for r in clean.ledger.collect()}
    assert sheet.count() == clean.rows.count() + led["DQ001"] + led["DQ002"]


ORDER_ROWS = [
    ("Alpha", "C1", "S1", "Completed", "BIlled", "100", "100", "118", "150", "-32", "2025-01-01", "2025-02-01", None),
    ("Beta", "C2", "S2", "Pause / struck", None, "200", None, None, None, "0", None, "2025-02-01", None),
    (None, None, "S3", "Executed until current month", "Update Required", "x", "5", "5.9", "0", "5.9", "2025-01-01",
     "2026-05-01", None),
    ("Eps", "C9", "S4", "Completed", "Billed", "50", None, None, None, None, "2025-01-01", "2025-02-01", None),
    ("Zeta", "C9", "S5", None, " BIlled", "10", "10", "10", "10", "0", "2025-01-01", None, None),
]
ORDER_TITLES = ["Deal name masked", "Customer Name Code", "Serial #", "Execution Status", "Billing Status ",
                "Amount in Rupees (Excl of GST) (Masked)", "Billed Value in Rupees (Excl of GST.) (Masked)",
                "Billed Value in Rupees (Incl of GST.) (Masked)", "Collected Amount in Rupees (Incl of GST.) (Masked)",
                "Amount Receivable (Masked)", "Date of PO/LOI", "Probable End Date", "Invoice Status"]


@pytest.fixture(scope="module")
def orders(spark):
    sheet = spark.createDataFrame(ORDER_ROWS, ", ".join(f"`{t}` string" for t in ORDER_TITLES))
    return N.normalize_orders(sheet, AS_OF)


def test_clean_orders(orders):
    rows = {r["serial_no"]: r for r in orders.rows.collect()}
    assert rows["S1"]["billing_status"] == "Billed" and rows["S2"]["billing_status"] == "Not Specified"
    assert rows["S5"]["billing_status"] == " BIlled"  # counted, but only the exact text is repaired
    assert rows["S2"]["execution_status"] == "Paused/Stuck" and rows["S3"]["execution_status"] == "Ongoing (Monthly)"
    assert rows["S2"]["is_overdue"] and not rows["S1"]["is_overdue"] and not rows["S3"]["is_overdue"]
    assert rows["S3"]["deal_name"] == "UNKNOWN_WO" and rows["S3"]["amount_excl_gst"] == 0.0
    assert "has_software" in rows["S1"].asDict()


def test_order_ledger(orders):
    led = {r["code"]: r for r in orders.ledger.collect()}
    assert {k: v["affected_count"] for k, v in led.items()} == {
        "DQ008": 1, "DQ009": 1, "DQ010": 2, "DQ011": 1, "DQ013": 2, "DQ014": 2, "DQ015": 5, "DQ016": 5}
    assert led["DQ008"]["sample_identifiers"] == ["Invoice Status"]


def test_samples_stay_small(spark):
    many = spark.range(100_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("name"))
    from salesloom.operators.ledger import rule_samples
    row = rule_samples(many, {"X": F.lit(True)}, F.col("name")).first()
    assert row["sample_identifiers"] == [f"{i:06d}" for i in range(5)]
    plan = rule_samples(many, {"X": F.lit(True)}, F.col("name"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_sector_rows_add_up(context):
    view = X.sector_reconciliation(context.deals, context.orders)
    total = view.agg(F.sum("total_deals"), F.sum("total_work_orders")).first()
    assert tuple(total) == (context.deals.count(), context.orders.count())
    assert view.count() == 9


def test_ladder_identities(context):
    row = O.ladder(context.deals, context.orders).first()
    assert row["unbilled_backlog"] == pytest.approx(row["amount_excl_gst"] - row["billed_excl_gst"])
    assert row["receivable_amount"] == pytest.approx(row["billed_incl_gst"] - row["collected_incl_gst"])


def test_counts_come_before_limits(context):
    from salesloom.plans.context import AS_OF as bridge_day
    totals = O.health_totals(context.orders, bridge_day).first()
    assert totals["delayed_count"] > 10 and O.delayed_orders(context.orders, bridge_day).count() == 10


def test_every_tool_gives_facts(context):
    given = {"compare_periods": {"metric": "open_pipeline_value", "period_a": "Q1 FY1998", "period_b": "Q2 FY1998"},
             "explain_metric": {"metric": "open_pipeline_value"}, "resolve_period": {"text": "Q3 FY25-26"}}
    boards_ = context.boards
    assert len(registry.TOOLS) == 16
    for name in registry.TOOLS:
        result = registry.run(name, boards_, ignored=1, **given.get(name, {}))
        facts = result.facts.collect()
        assert result.tool == name and facts
        assert all(f["id"].startswith("F") and f["metric"] and f["display"] for f in facts), name
    with pytest.raises(KeyError):
        registry.run("no_such_tool", boards_)


def test_tender_and_stale_modes(context):
    tender = registry.run("pipeline_summary", context.boards, deal_type="Tender", sector="Mining")
    assert tender.facts.first()["metric"] == "tender_share_pct"
    stale = registry.run("data_debt_list", context.boards, type="stale_open_deals", limit=3)
    assert stale.tables["t_stale_deals"].count() == 3
    ongoing = registry.run("work_order_health", context.boards, status="Ongoing")
    assert ongoing.facts.first()["metric"] == "ongoing_orders"


def test_csv_lines(context):
    lines = registry.run("data_debt_list", context.boards, format="csv", severity="LOW").tables["csv_rows"].collect()
    assert any("DQ004,deals" in r["line"] for r in lines)


def test_board_pages_stop_at_the_last_page(spark, tmp_path):
    item = lambda i, extra=(): {"id": str(i), "name": f"N{i}", "column_values": [
        {"id": "c", "text": "x", "column": {"title": "T"}}, {"id": "c2", "text": "", "column": {"title": "U"}},
        {"id": "raw", "text": "r", "column": None}, *extra]}
    page = lambda items, cursor: {"boards": [{"id": "1", "name": "b", "items_page": {"cursor": cursor, "items": items}}]}
    import json
    pages = [page([item(1, [{"id": "c", "text": "later", "column": {"title": "T"}}])], "k2"), page([item(2)], None),
             page([item(3)], "k4")]
    for i, p in enumerate(pages, 1):
        (tmp_path / f"page={i}").mkdir()
        (tmp_path / f"page={i}" / "p.json").write_text(json.dumps(p))
    items = boards.read_items(spark, str(tmp_path))
    wide = boards.widen(items, ["T", "U", "raw"], "Deal Name").orderBy("Deal Name").collect()
    assert [tuple(r) for r in wide] == [("N1", "later", None, "r"), ("N2", "x", None, "r")]


def test_header_on_any_of_the_first_rows(spark, tmp_path):
    for at, name in ((0, "a"), (2, "b"), (9, "c")):
        lines = ["t,u"] * at + ["Deal Name ,Value"] + [f"d{i},{i}" for i in range(3)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines))
    read = lambda n: sheets.read_floating_header(spark, str(tmp_path / f"{n}.csv"), 2)
    assert read("a").columns == ["Deal Name", "Value"] and read("a").count() == 3
    assert read("b").columns == ["Deal Name", "Value"] and read("b").count() == 3
    assert read("c").columns == ["t", "u"] and read("c").count() == 11  # no header found: the second row


def test_snapshot_survives_a_failed_load(spark, context, tmp_path):
    path = str(tmp_path / "s")
    now = dt.datetime(2026, 1, 1, 12)
    small = lambda: (context.deals.limit(5), context.orders.limit(5), context.deals.limit(1).select("deal_alias"))

    def broken():
        raise IOError("source is down")

    with pytest.raises(IOError):
        snapshots.refresh(spark, path, broken, now)
    first = snapshots.refresh(spark, path, small, now)
    later = now + dt.timedelta(minutes=5)
    assert snapshots.refresh(spark, path, broken, later) == first  # still fresh: not even tried
    much_later = now + dt.timedelta(hours=1)
    assert snapshots.refresh(spark, path, broken, much_later) == first
    row = snapshots.status(snapshots.manifest(spark, path), much_later).first()
    assert row["is_stale"] and row["source"] == "stale_snapshot" and len(row["checksum"]) == 16
    assert snapshots.read(spark, path, "deals").count() == 5


def test_event_names_cross_file_splits(spark, tmp_path):
    lines = [": hi", "event: tool"] + [f'data: {{"n": {i}}}' for i in range(400)] + ["event: answer", "data: {bad",
                                                                                    'data: {"n": 400}', ""]
    (tmp_path / "c.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        rows = event_capture.read_events(spark, str(tmp_path / "c.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 401 and len({r["block"] for r in rows}) > 3
    assert sorted(r["event"] for r in rows)[0] == "answer" and sum(r["event"] == "tool" for r in rows) == 400
