"""Physical plans: what reaches the scan, what is broadcast, where Python runs."""

import pytest

from salesloom.plans.queries import QUERIES

PYTHON_ALLOWED = ("e1_", "e2_", "e3_")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_and_filters_reach_the_scan(spark, context):
    text = spark._jvm.PythonSQLUtils.explainString(
        QUERIES["a16_delayed_orders"](context)._jdf.queryExecution(), "formatted")
    assert "l_quantity" not in text
    assert "PushedFilters" in text


def test_sector_view_joins_are_broadcasts(context):
    text = plan(QUERIES["a13_sector_reconciliation"](context))
    assert text.count("BroadcastHashJoin sector") + text.count("BroadcastHashJoin [sector") >= 2
    assert "CartesianProduct" not in text


@pytest.mark.parametrize("name", [n for n in QUERIES if n[:2] in ("a1", "a2", "a3", "q6", "v5", "v6", "j3", "r5")])
def test_no_cartesian_product_and_no_python(context, name):
    text = plan(QUERIES[name](context))
    assert "CartesianProduct" not in text
    assert "Python" not in text and "Pandas" not in text or name.startswith(PYTHON_ALLOWED)


def test_top_lists_need_no_full_sort(context):
    assert "TakeOrderedAndProject" in plan(QUERIES["a4_top_open_deals"](context))


def test_grouping_sets_scan_once(context):
    text = plan(QUERIES["a3_open_grouping_sets"](context))
    assert text.count("orders.parquet") <= 1 or text.count("FileScan") == 3
