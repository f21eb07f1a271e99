"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from siftwell.plans import load_plans
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
PLANS = load_plans()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, p in PLANS.items() if p.sql])
def test_same_as_sql(spark, con, name):
    assert differences(PLANS[name].run(spark, FOLDER), con, PLANS[name].sql) == []


@pytest.mark.parametrize("name", [n for n, p in PLANS.items() if not p.sql])
def test_runs_without_sql(spark, name):
    assert PLANS[name].run(spark, FOLDER).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
