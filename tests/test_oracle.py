"""Every registered query with an SQL answer gives that answer on the small tables."""

import pytest

import __spark_entry__ as entry
from oracles.sql import ORACLE
from tallywatch.plans.registry import QUERIES
from tests.compare import connect, differences

# The streams are checked in test_streaming, the residual in test_models; all of them at sf0.01 by compare.py.
SLOW = {
    "stream_velocity", "stream_scoring", "stream_state_velocity", "stream_state_late", "stream_scoring_rolling", "stream_hybrid",
    "gbt_residual",
}


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - SLOW))
def test_matches_sql(spark, folder, con, name):
    assert differences(entry.queries()[name](spark, folder), con, entry.oracle_sql()[name])[:3] == []


def test_registry_is_complete():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    without_sql = set(QUERIES) - set(ORACLE)
    assert without_sql == {
        "forest_scores", "gbt_scores", "gbt_attributions", "hybrid_scores", "alerts_explained",
    }


def test_entry_has_one_row(spark):
    assert entry.entry(spark).count() == 1
