from __future__ import annotations

import pytest

from quillspark.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import difference


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(spark, sf_dir, QUERIES[name], ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_query_returns_every_row(spark, sf_dir, name):
    table = "pages" if name == "op10_warc" else "documents"
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
