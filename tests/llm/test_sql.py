"""Queries that SQL can express, against their DuckDB SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from harness import compare, duck
from ledgerlens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    result = compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF, duck(SF))
    assert result["ok"], result
