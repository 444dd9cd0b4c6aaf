"""Every query of the reference's operators runs, and gives the rows of its SQL where there is SQL."""

from __future__ import annotations

import os

import pytest

from pagewarden import registry

from .compare import assert_same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, registry.queries()[name], registry.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_without_sql_runs(spark, name):
    rows = registry.queries()[name](spark, SF).collect()
    assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
