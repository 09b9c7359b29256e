"""Every registered query against its independent DuckDB SQL (row count, column names and types, values).

Runs on sf0.001 by default; ``LEDGERLENS_ORACLE_SF=/root/testdata/sf0.01`` runs the driver's correctness scale.
"""

import os

import pytest

from harness import compare, duck
from ledgerlens.catalog import catalog

SF = os.environ.get("LEDGERLENS_ORACLE_SF", "/root/testdata/sf0.001")
ENTRIES = catalog()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_matches_oracle(spark, con, name):
    entry = ENTRIES[name]
    res = compare(spark, name, entry.run, entry.sql, SF, con)
    assert res["ok"], res


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    rows = df.collect()
    assert df.columns == ["cohort", "total_users", "month_number", "percentage"]
    assert len(rows) == 21
    assert set(ENTRIES) <= set(e.oracle_sql()) <= set(e.queries())
