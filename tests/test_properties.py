"""Properties of the metrics and equivalence of the rewritten plans with their literal forms (sf0.001 fixtures)."""

from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.aggs import distinct_counts
from ledgerlens.functions.exprs import period, project_of
from ledgerlens.plans import deployers, economics, users
from ledgerlens.sources import fixtures as fx
from ledgerlens.timeframe import truncate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return fx.long_history(spark, SF)


@pytest.mark.parametrize("tf", ["week", "month"])
def test_retention_offset_zero_is_100_and_bounded(spark, t, tf):
    rows = users.retention_chart(t, fx.RETENTION_AS_OF, tf).collect()
    assert rows
    assert all(r["percentage"] == 100.0 for r in rows if r[f"{tf}_number"] == 0)
    assert all(0 < r["percentage"] <= 100.0 for r in rows)


def test_retention_equals_a_plain_computation(spark):
    """The bitmask plan against sets of active months in Python; cohorts lie in and out of the six-month scope."""
    tables, as_of = fx.late_senders(spark, SF), fx.LONG_AS_OF
    months: dict[str, set[int]] = {}
    for r in tables.as_of(as_of)["transactions"].select("from_address", "block_timestamp").collect():
        months.setdefault(r[0], set()).add(r[1].year * 12 + r[1].month - 1)
    current = as_of.year * 12 + as_of.month - 1
    cohorts: dict[int, list[set[int]]] = {}
    for active in months.values():
        complete = {m for m in active if m < current}
        if complete:
            cohorts.setdefault(min(complete), []).append(complete)
    want = set()
    for birth, members in cohorts.items():
        for m in range(birth, current):
            users_then = sum(m in active for active in members)
            if birth >= current - 6 and users_then:
                share = (Decimal(users_then * 100) / len(members)).quantize(Decimal("0.000001"), ROUND_HALF_UP)
                want.add((f"{birth // 12 % 100:02d}-{birth % 12 + 1:02d}-01", len(members), m - birth, float(share.quantize(Decimal("0.01"), ROUND_HALF_UP))))
    got = {tuple(r) for r in users.retention_chart(tables, as_of, "month").collect()}
    assert got == want and len(cohorts) > len({r[0] for r in want}) > 1


def test_fee_shares_sum_to_100(spark, t):
    for r in economics.l1vl2fee(t, fx.LONG_AS_OF, "month").collect():
        if r["l1_fee"] is not None:
            assert r["l1_fee"] + r["l2_fee"] == pytest.approx(100.0, abs=2e-6)


def test_project_chart_totals_equal_unfolded_sum(spark, t):
    tt = t.as_of(fx.LONG_AS_OF)
    chart = users.contract_transactions_chart(t, fx.LONG_AS_OF, "month")
    got = {r["date"]: r["s"] for r in chart.groupBy("date").agg(F.sum("num_transactions").alias("s")).collect()}
    contracts = tt["contracts"].select(F.col("address").alias("c"))
    rows = tt["transactions"].join(contracts, F.col("to_address") == F.col("c"), "left").filter(F.col("c").isNotNull() | (F.col("value") > 0))
    per = rows.groupBy(period("block_timestamp", "month").alias("p"), project_of("c", F.col("value") > 0).alias("project")).agg(
        F.count_distinct("hash").alias("n"), F.count_distinct("from_address").alias("w")
    )
    want = {r["d"]: r["s"] for r in per.filter("w > 10").groupBy(F.date_format("p", "yyyy-MM-dd").alias("d")).agg(F.sum("n").alias("s")).collect()}
    assert got == want


def test_distinct_counts_equal_count_distinct(spark, t):
    tx = t.as_of(fx.LONG_AS_OF)["transactions"].withColumn("p", period("block_timestamp", "month"))
    ours = distinct_counts(tx, ["p"], {"w": "from_address", "h": "hash"})
    ref = tx.groupBy("p").agg(F.count_distinct("from_address").alias("w"), F.count_distinct("hash").alias("h"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.select("p", "w", "h").collect()))


def test_scalar_profit_is_revenue_minus_costs(spark, t):
    rev = economics.scalar_revenue(t, fx.LONG_AS_OF, "week").collect()[0]["gas_rev"]
    profit = economics.scalar_profit(t, fx.LONG_AS_OF, "week").collect()[0]["profit"]
    tt = t.as_of(fx.LONG_AS_OF)
    since = F.col("block_timestamp") >= F.lit("2001-07-08 12:00:00").cast("timestamp_ntz")
    costs = sum(float(tt[name].filter(since).agg(F.sum("gas_spend")).collect()[0][0] or 0) for name in ("l1_batch_fees", "l1_verification_fees"))
    assert profit == pytest.approx(rev - costs, abs=1e-4)


def test_chain_pivot_equals_inner_join_of_series(spark, t):
    wide = {r["date"]: (r["c1"], r["c2"], r["c3"]) for r in deployers.chain_key_deployers(t, fx.LONG_AS_OF, "week", fx.FIXTURE_CHAINS).collect()}
    series = {}
    for chain in fx.FIXTURE_CHAINS:
        series[chain] = {r["date"]: r["filtered_deployers"] for r in deployers.key_deployers(t, fx.LONG_AS_OF, "week", chain).collect()}
    common = set(series["c1"]) & set(series["c2"]) & set(series["c3"])
    assert wide == {d: tuple(series[c][d] for c in fx.FIXTURE_CHAINS) for d in common}


def test_user_cards_equal_single_cards(spark):
    ti = fx.intraday(spark, SF)
    row = users.cards(ti, fx.INTRADAY_AS_OF).collect()[0]
    assert row["actives_24h"] == users.actives(ti, fx.INTRADAY_AS_OF, 1, "day").collect()[0][0]
    assert row["actives_growth_7d"] == users.actives_growth(ti, fx.INTRADAY_AS_OF, 7, "day", "g").collect()[0][0]
    assert row["actives_1m"] == users.actives(ti, fx.INTRADAY_AS_OF, 1, "month").collect()[0][0]


@pytest.mark.parametrize("tf", ["day", "week", "month"])
def test_daily_rollup_gives_same_charts(spark, t, tf):
    activity = users.daily_activity(t, fx.LONG_AS_OF)
    for metric, as_of in ((users.active_accounts_chart, fx.LONG_AS_OF), (users.transactions_chart, fx.LONG_AS_OF), (users.retention_chart, fx.RETENTION_AS_OF)):
        direct = metric(t, as_of, tf).collect()
        rolled = metric(t, as_of, tf, users.daily_activity(t, as_of) if as_of != fx.LONG_AS_OF else activity).collect()
        assert direct == rolled and direct, metric.__name__


def test_users_dashboard_reads_a_stored_rollup(spark, t, tmp_path):
    from ledgerlens.plans import rollups

    rollups.refresh(spark, t, str(tmp_path), fx.LONG_AS_OF, ("daily_activity",))
    activity = rollups.read(spark, t, str(tmp_path), "daily_activity", fx.LONG_AS_OF)
    board = users.dashboard(t, fx.LONG_AS_OF, "month", activity)
    assert board["transactions_chart"].collect() == users.transactions_chart(t, fx.LONG_AS_OF, "month").collect()
    assert "block_date" in board["retention_chart"]._jdf.queryExecution().optimizedPlan().toString()


def test_dashboards_expose_original_keys(spark, t):
    from ledgerlens.plans import bd

    board = users.dashboard(t, fx.LONG_AS_OF, "month")
    assert set(board) == {
        "time", "actives_24h", "actives_growth_24h", "actives_7d", "actives_growth_7d", "actives_1m", "actives_growth_1m",
        "active_accounts_chart", "transactions_chart", "retention_chart", "contract_transactions_chart", "contract_gas_chart",
        "trending_contracts",
    }
    assert board["actives_1m"].collect() == users.actives(t, fx.LONG_AS_OF, 1, "month").collect()
    assert board["actives_growth_1m"].collect() == users.actives_growth(t, fx.LONG_AS_OF, 1, "month", "monthly_growth").collect()
    assert set(economics.dashboard(t, fx.LONG_AS_OF)) == {
        "gross_profit", "batch_fees", "verify_fees", "gas_revenue", "l1vl2fee", "week_gross_profit", "week_revenue",
        "month_gross_profit", "month_revenue", "all_gross_profit", "all_revenue",
    }
    assert set(bd.dashboard(t, fx.LONG_AS_OF)) == {"leaderboard"}
    assert set(deployers.deployers_dashboard(t, fx.LONG_AS_OF, chain="c1", chains=fx.FIXTURE_CHAINS)) == {
        "all_deployers", "key_deployers", "returning_key_deployers", "chain_key_deployers",
    }
    assert set(deployers.developers_dashboard(t, fx.COMMITS_AS_OF)) == {"commits", "git_devs"}


def test_catalog_tables_registry(spark, t):
    from ledgerlens.sources.registry import Tables

    t.as_of(fx.LONG_AS_OF)["transactions"].createOrReplaceGlobalTempView("transactions")
    cat = Tables.from_catalog(spark, "global_temp", ["transactions"])
    assert cat.as_of(fx.LONG_AS_OF)["transactions"].count() == t.as_of(fx.LONG_AS_OF)["transactions"].count()


@pytest.mark.parametrize("tf", ["day", "month"])
def test_economics_rollup_gives_same_results(spark, t, tf):
    hourly = economics.hourly_fees(t, fx.LONG_AS_OF)
    for direct, rolled in [
        (economics.gross_profit(t, fx.LONG_AS_OF, tf), economics.gross_profit(t, fx.LONG_AS_OF, tf, hourly)),
        (economics.gas_revenue(t, fx.LONG_AS_OF, tf), economics.gas_revenue(t, fx.LONG_AS_OF, tf, hourly)),
        (economics.l1vl2fee(t, fx.LONG_AS_OF, tf), economics.l1vl2fee(t, fx.LONG_AS_OF, tf, hourly)),
        (economics.scalar_profit(t, fx.LONG_AS_OF, "all"), economics.scalar_profit(t, fx.LONG_AS_OF, "all", hourly)),
        (economics.scalar_revenue(t, fx.LONG_AS_OF, "all"), economics.scalar_revenue(t, fx.LONG_AS_OF, "all", hourly)),
        (economics.scalar_profit(t, fx.LONG_AS_OF, "week"), economics.scalar_profit(t, fx.LONG_AS_OF, "week", hourly)),
    ]:
        assert direct.collect() == rolled.collect()
    board = economics.dashboard(t, fx.LONG_AS_OF, tf)
    assert board["gas_revenue"].collect() == economics.gas_revenue(t, fx.LONG_AS_OF, tf).collect()
