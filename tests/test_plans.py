"""Plan shapes that matter at scale, checked on Parquet-backed tables (the production read path)."""

import re

import pytest

from ledgerlens.catalog import catalog
from ledgerlens.plans import economics, report, users
from ledgerlens.sources import fixtures as fx
from ledgerlens.sources.registry import Tables

SF = "/root/testdata/sf0.001"
NAMES = ["transactions", "contracts", "labels_apps", "token_prices_hourly", "l1_batch_fees", "l1_verification_fees",
         "l1_bridge_revenue", "l1_gas_oracle_fees", "l2_gas_oracle_fees"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # untruncated PushedFilters in plan strings
    root = tmp_path_factory.mktemp("tables")
    src = fx.long_history(spark, SF)
    for name in NAMES:
        src[name].write.parquet(str(root / name))
    return Tables.from_parquet(spark, str(root), NAMES)


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def first_input_below(plan: str, marker: str) -> str:
    """The first node below the line containing ``marker`` that is not a Filter or Project."""
    lines = plan.split("\n")
    idx = next(i for i, line in enumerate(lines) if marker in line)
    for line in lines[idx + 1:]:
        node = line.strip(" :+-")
        if not node.startswith(("Filter", "Project")):
            return node
    raise AssertionError(plan)


def scan_lines(df) -> list[str]:
    return [line for line in physical(df).split("\n") if "FileScan parquet" in line]


def test_window_bounds_and_cut_pushed_into_scan_with_pruned_columns(stored):
    df = users.actives(stored, fx.LONG_AS_OF, 1, "month")
    (scan,) = scan_lines(df)
    assert "GreaterThanOrEqual(block_timestamp,2001-06-15T12:00)" in scan
    assert "LessThanOrEqual(block_timestamp,2001-07-15T12:00)" in scan
    read_schema = re.search(r"ReadSchema: (struct<[^>]*>)", scan).group(1)
    assert read_schema == "struct<block_timestamp:timestamp_ntz,from_address:string>"


def test_complete_period_cut_on_raw_timestamp(stored):
    (scan,) = scan_lines(users.active_accounts_chart(stored, fx.LONG_AS_OF, "month"))
    assert "LessThan(block_timestamp,2001-07-01T00:00)" in scan


def test_top_k_chart_runs_fact_pipeline_once(spark, stored):
    df = users.contract_transactions_chart(stored, fx.LONG_AS_OF, "month")
    assert df.count() > 0
    df.collect()
    final = physical(df).split("== Initial Plan ==")[0]
    assert "WindowGroupLimit" in final and "Partial" in final
    assert final.count("Generate explode") == 1
    assert "ReusedExchange" in final


def test_trending_contract_test_after_aggregation(stored):
    plan = optimized(users.trending_contracts(stored, fx.LONG_AS_OF, "month"))
    assert first_input_below(plan, "Join LeftSemi").startswith("Aggregate [contract")


def test_price_join_meets_hourly_aggregate_not_rows(stored):
    plan = optimized(economics.gas_revenue(stored, fx.LONG_AS_OF, "month"))
    node = first_input_below(plan, "Join Inner")
    assert node.startswith("Aggregate") and "AS hour" in node and "sum(_rev_wei_high" in node


def test_retention_has_no_window_and_no_fact_join(stored):
    plan = optimized(users.retention_chart(stored, fx.RETENTION_AS_OF, "month"))
    assert "Window" not in plan
    assert plan.count("Join ") == 1


def test_report_broadcasts_only_bounded_daily_series(stored):
    plan = physical(report.report(stored, fx.REPORT_START, fx.REPORT_END, fx.LONG_AS_OF))
    assert plan.count("BroadcastHashJoin") == 5
    assert "SortMergeJoin" not in plan


def test_no_python_in_any_registered_plan(spark):
    for name, entry in catalog().items():
        plan = physical(entry.run(spark, SF))
        assert "EvalPython" not in plan and "PythonUDF" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


FACTS = ["transactions", "l1_batch_fees"]  # day folders; the other tables stay unpartitioned (both paths in one registry)


@pytest.fixture(scope="module")
def day_partitioned(spark, stored, tmp_path_factory):
    from ledgerlens.sources.layout import write_fact_table

    root = tmp_path_factory.mktemp("by_day")
    src = fx.long_history(spark, SF)
    for name in NAMES:
        if name in FACTS:
            write_fact_table(name, src[name], str(root / name))
        else:
            src[name].write.parquet(str(root / name))
    return Tables.from_parquet(spark, str(root), NAMES)


def test_windows_prune_date_partitions(day_partitioned):
    (scan,) = scan_lines(users.actives(day_partitioned, fx.LONG_AS_OF, 1, "month"))
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", scan).group(1)
    assert "block_date" in filters and ">=" in filters and "<=" in filters
    scans = scan_lines(users.trending_contracts(day_partitioned, fx.LONG_AS_OF, "month"))
    tx_scan = next(s for s in scans if "transactions" in s)
    assert ">=" in re.search(r"PartitionFilters: \[([^\]]*)\]", tx_scan).group(1)


@pytest.mark.parametrize(
    "metric",
    [
        lambda t: users.actives(t, fx.LONG_AS_OF, 1, "month"),
        lambda t: users.actives_growth(t, fx.LONG_AS_OF, 1, "month", "g"),
        lambda t: users.trending_contracts(t, fx.LONG_AS_OF, "month", min_wallets=0),
        lambda t: users.active_accounts_chart(t, fx.LONG_AS_OF, "week"),
        lambda t: economics.scalar_profit(t, fx.LONG_AS_OF, "week"),
        lambda t: report.report(t, fx.REPORT_START, fx.REPORT_END, fx.LONG_AS_OF),
    ],
)
def test_partitioned_layout_gives_same_results(stored, day_partitioned, metric):
    a = sorted(map(tuple, metric(stored).collect()))
    b = sorted(map(tuple, metric(day_partitioned).collect()))
    assert a == b and a


def test_project_charts_share_one_scan_and_one_contract_join(spark, stored):
    charts = users.project_charts(stored, fx.LONG_AS_OF, "month", min_wallets=0)
    rows = charts.collect()
    final = physical(charts).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    scans = [line for line in final.split("\n") if "FileScan parquet" in line and "/transactions" in line]
    assert len(scans) == 1 and sum("/contracts" in line for line in final.split("\n") if "FileScan parquet" in line) == 1
    for chart, fn in (("num_transactions", users.contract_transactions_chart), ("eth_fees", users.contract_gas_chart), ("num_unique_wallets", users.contract_users_chart)):
        got = sorted((r.date, r.project, r[chart]) for r in rows if r.chart == chart)
        assert got == sorted(map(tuple, fn(stored, fx.LONG_AS_OF, "month", min_wallets=0).collect())) and got
