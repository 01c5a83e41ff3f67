"""Every query against its SQL, and those without SQL for rows."""

from __future__ import annotations

import pytest

from quillspark.plans.catalogue import ORACLE_SQL, QUERIES
from tests.compare import difference


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(spark, sf_dir, QUERIES[name], ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_query_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_and_registries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 9
