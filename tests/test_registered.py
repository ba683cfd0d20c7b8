"""Registered queries agree with their SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.check_parity import compare, connect

from .conftest import SMALL

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
PICKED = ["a1_open_deal_totals", "a10_revenue_ladder", "a13_sector_reconciliation", "a22_debt_records",
          "a31_governed_metrics", "nd14_clean_deals", "nw15_ledger", "f13_period_bounds", "q5_route",
          "q6_carried_period", "t3_tokenized_columns", "t4_tokenized_text", "v6_verdicts", "e1_sliding_window",
          "e6_replay_pages", "s12_event_capture"]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", PICKED)
def test_parity(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), con, ORACLES[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 9
