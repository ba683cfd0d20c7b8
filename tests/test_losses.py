"""Readers that lose nothing, skewed joins, receipts with every reason, ledgers that read an export once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesloom.operators import audits as A
from salesloom.operators import normalize as N
from salesloom.operators.skew import left_join_split
from salesloom.plans.registry import RECEIPT_RULES, Boards, receipt
from salesloom.session import stored
from salesloom.sources import boards, sheets

ITEM = "id string, name string, column_values array<struct<id:string,text:string,value:string,type:string,column:struct<title:string>>>"


def cell(title, text, id="c"):
    return (id, text, None, "text", (title,))


def test_unlisted_titles_are_kept_and_counted(spark):
    rows = [("1", "one", [cell("A", "x"), cell("Z", "extra"), cell("A", "y"), cell("Y", "")]),
            ("2", "two", [cell("B", "b"), cell("Z", "more"), ("W", "id only", None, "text", None)]), ("3", "three", None), ("4", None, [])]
    items = spark.createDataFrame(rows, ITEM)
    got = {r["Name"]: r for r in boards.widen(items, ["A", "B"], "Name", rest="rest").collect()}
    assert (got["one"]["A"], got["two"]["B"]) == ("y", "b")
    assert [tuple(x) for x in got["one"]["rest"]] == [("A", "x"), ("Z", "extra")]
    assert [tuple(x) for x in got["two"]["rest"]] == [("Z", "more"), ("W", "id only")] and got["three"]["rest"] == []
    assert {tuple(r) for r in boards.unlisted(items, ["A", "B"], "Name").collect()} == {("Z", 2), ("A", 1), ("W", 1)}


def test_surplus_cells_and_quoted_line_breaks_are_kept(spark, tmp_path):
    text = ('Export of today\nDeal Name,Value,Status\nAlpha,1,Open\n"Beta\nof two lines",2,"a ""quoted"" word"\n'
            'Gamma,3,Won,left,"over, quoted"\nDelta,4\n"Epsilon, Inc",5,Open,""\n')
    (tmp_path / "wide.csv").write_text(text)
    rows = sheets.read_floating_header(spark, str(tmp_path / "wide.csv"), 3, surplus="more").collect()
    got = {r["Deal Name"]: (r["Value"], r["Status"], r["more"]) for r in rows}
    assert got == {"Alpha": ("1", "Open", None), "Beta\nof two lines": ("2", 'a "quoted" word', None), "Gamma": ("3", "Won", ["left", "over, quoted"]),
                   "Delta": ("4", None, None), "Epsilon, Inc": ("5", "Open", [""])}
    plain = sheets.read_floating_header(spark, str(tmp_path / "wide.csv"), 3)
    assert plain.columns == ["Deal Name", "Value", "Status"] and plain.count() == 5


def test_a_join_whose_right_side_is_mostly_placeholders(spark):
    left = spark.range(300).select(F.when(F.col("id") % 50 == 0, "placeholder").when(F.col("id") % 7 == 0, F.lit(None).cast("string"))
                                   .otherwise(F.concat(F.lit("k"), F.col("id") % 90)).alias("key"), F.col("id").alias("l"))
    right = spark.range(6000).select(F.when(F.col("id") % 10 != 0, "placeholder").when(F.col("id") % 11 == 0, F.lit(None).cast("string"))
                                     .otherwise(F.concat(F.lit("k"), F.col("id") % 130)).alias("key"), F.col("id").alias("r"))
    order = lambda df: sorted(map(tuple, df.select("key", "l", "r").collect()), key=repr)
    assert order(left_join_split(left, right, "key")) == order(left.join(right, "key", "left"))
    without = left.filter("key != 'placeholder'")
    got = left_join_split(without, right, "key")
    assert order(got) == order(without.join(right, "key", "left")) and got.filter("key = 'placeholder'").isEmpty()
    none = right.limit(0)
    assert order(left_join_split(left, none, "key")) == order(left.join(none, "key", "left"))


@pytest.mark.parametrize("considered, used, missing, share, link, stale, fallback, level, reasons", [
    (100, 100, 0, 10.0, None, False, False, "high", 0), (100, 75, 0, 10.0, None, False, False, "medium", 1),
    (100, 100, 30, 10.0, None, True, False, "medium", 2), (100, 40, 0, 60.0, 49.9, True, True, "low", 4),
    (100, 100, 0, 50.0, 50.0, False, False, "high", 0), (0, 0, 0, 0.0, None, False, False, "high", 0)])
def test_every_reason_of_a_receipt(spark, considered, used, missing, share, link, stale, fallback, level, reasons):
    """Each input is measured on rows that are made to give it."""
    held = spark.createDataFrame([("big", share), *[(f"small{i}", (100 - share) / 20) for i in range(20)], (None, 900.0), ("debt", -50.0)],
                                 "entity string, value double") if share else spark.createDataFrame([], "entity string, value double")
    assert A.concentration(held, "entity", "value").first()[0] == share
    counted = spark.createDataFrame([(considered, used)], "considered long, used long")
    rows = spark.range(max(considered, 1)).select((F.col("id") >= missing).alias("ok"), F.lit("e").alias("entity"), F.lit(0.0).alias("value"))
    coverage = None if link is None else spark.createDataFrame([(link,)], "match_rate_pct double")
    inputs = A.receipt_inputs(counted, rows, "entity", "value", F.col("ok"), coverage, stale, fallback)
    inputs = inputs.withColumn("single_entity_share_pct", F.lit(share))
    got = A.receipt(inputs, "tool", "statement", None, dt.date(2024, 1, 1)).first()
    assert got["missing_key_field"] == missing and got["confidence"] == level and len(got["confidence_reasons"]) == reasons


def test_a_tool_without_account_has_no_receipt(spark, context):
    assert "list_capabilities" not in RECEIPT_RULES
    with pytest.raises(KeyError):
        receipt("list_capabilities", Boards(context.deals, context.orders, None))


def test_a_kept_ledger_reads_each_export_once(spark, context):
    """What is written names lineitem once; all that follows reads what was written."""
    plans = []

    def keep(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, name)

    orders = N.normalize_orders(context.orders_sheet, keep=keep)
    deals = N.normalize_deals(context.deals_sheet, keep=keep)
    plans.append(N.full_ledger(deals, orders)._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("l_extendedprice#") > 0 for p in plans) == 1
    assert plans[0].count("l_shipdate") > 0 and "c_mktsegment" not in plans[-1] and "l_shipdate" not in plans[-1]
    # Of the stored rows of each board there are two scans: one for counts, one for samples.
    assert plans[-1].count("_header") <= plans[-1].count("Relation") * 8 and plans[-1].count("Relation") <= 8
    again = N.full_ledger(N.normalize_deals(context.deals_sheet), N.normalize_orders(context.orders_sheet))
    order = lambda df: sorted(map(str, df.collect()))
    assert order(N.full_ledger(deals, orders)) == order(again)


def test_context_has_wide_plans_compiled(spark):
    from salesloom.plans.context import Context
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "65535")
        Context(spark, "/none")
        assert spark.conf.get(limit) == "8000"
        spark.conf.set(limit, "4000")
        Context(spark, "/none")
        assert spark.conf.get(limit) == "4000"
    finally:
        spark.conf.set(limit, before)


def test_pages_are_written_compressed_in_one_exchange(spark, tmp_path):
    import os
    from salesloom.sources import boards
    rows = spark.createDataFrame([(f"Deal-{i % 40}", None if i % 3 == 0 else "x", i % 4) for i in range(80)], "`Deal Name` string, b string, _page long")
    paged = rows.repartition("_page").dropDuplicates()
    path = boards.write_pages(paged, "_page", "Deal Name", str(tmp_path / "pages"))
    files = [f for f in os.listdir(path) if not f.startswith((".", "_"))]
    assert files and all(f.endswith(".json.gz") for f in files)
    pages = boards.read_pages(spark, path).collect()
    assert {p["page"] for p in pages} == {0, 1, 2, 3}
    items = [i for p in pages for i in p["boards"][0]["items_page"]["items"]]
    assert sorted((i["name"], i["column_values"][0]["text"], len(i["column_values"])) for i in items) == sorted(
        {(r[0], r[1] or "", 1) for r in rows.collect()})


def test_orders_are_derived_once_for_all_snapshots(spark, context, monkeypatch):
    from salesloom.plans import board_queries as B
    from salesloom.sources import snapshots
    written = []
    write = snapshots.write
    monkeypatch.setattr(snapshots, "write", lambda s, path, i, deals, orders, *more: (
        written.append((i, orders.inputFiles())), write(s, path, i, deals, orders, *more)))
    path = B.snapshot(context)
    assert "work_orders/snapshot_id=1" in written[1][1][0] and "lineitem" in " ".join(written[0][1])
    assert snapshots.latest_id(spark, path) == 2
    assert spark.read.parquet(f"{path}/work_orders/snapshot_id=3").count() == context.orders.count()


def test_receipts_derive_each_board_once(context):
    """Their plan reads stored boards, and these give what whole boards give."""
    from salesloom.plans.text_queries import receipts
    got = receipts(context)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "receipt-orders" in plan and "lineitem" not in plan and "customer" not in plan
    rows = {r.tool_name: r for r in got.collect()}
    assert set(rows) == set(RECEIPT_RULES)
    for tool in RECEIPT_RULES:
        given = {"sector": "Mining"} if tool == "win_loss_analysis" else {}
        want, one = receipt(tool, context.boards, **given).first(), rows[tool]
        assert all(one[c] == want[c] for c in ("considered", "used", "missing_key_field", "single_entity_share_pct",
                                               "cross_board_link_coverage_pct", "confidence"))
        assert one.reasons == "; ".join(want.confidence_reasons)
