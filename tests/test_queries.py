from __future__ import annotations

import pytest

from quillon.plans.catalog import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.helpers import rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    a, b = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df()
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
