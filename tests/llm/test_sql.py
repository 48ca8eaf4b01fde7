"""The queries that SQL can express, against DuckDB."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import compare, connect  # noqa: E402

from quarry.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, queries.queries()[name], queries.oracle_sql()[name]) == ""
