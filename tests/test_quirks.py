"""Hand-made tiny frames, one per semantic edge case of the metrics (FIXTURES.md section 3)."""

import datetime as dt
from decimal import Decimal as D

import pytest

from ledgerlens.plans import bd, deployers, economics, report, users
from ledgerlens.sources.registry import Tables
from ledgerlens.sources.schemas import SCHEMAS

T = dt.datetime


def tables(spark, **rows) -> Tables:
    return Tables({name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()})


def tx(h, ts, frm, to, value=0, l1=0, price=0, gas=0):
    return (h, ts, frm, to, D(value), D(l1), D(price), D(gas))


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


AS_OF = T(2024, 3, 20, 12)


def test_growth_null_when_previous_window_empty(spark):
    t = tables(spark, transactions=[tx("a", T(2024, 3, 20, 1), "w1", "x")])
    assert one(users.actives_growth(t, AS_OF, 1, "day", "g"))["g"] is None
    assert one(users.actives(t, AS_OF, 1, "day"))["active_wallets"] == 1


def test_half_open_boundary_counts_as_current(spark):
    edge = AS_OF - dt.timedelta(days=1)
    t = tables(spark, transactions=[tx("a", edge, "w1", "x"), tx("b", edge - dt.timedelta(seconds=1), "w2", "x")])
    # current: w1 only; previous: w2 only -> growth 0.0
    assert one(users.actives_growth(t, AS_OF, 1, "day", "g"))["g"] == 0.0
    assert one(users.actives(t, AS_OF, 1, "day"))["active_wallets"] == 1


def test_month_end_clipping(spark):
    as_of = T(2024, 3, 31)
    t = tables(spark, transactions=[tx("a", T(2024, 2, 29), "w1", "x"), tx("b", T(2024, 2, 28, 23, 59), "w2", "x")])
    assert one(users.actives(t, as_of, 1, "month"))["active_wallets"] == 1


def test_rows_after_as_of_are_cut(spark):
    t = tables(spark, transactions=[tx("a", AS_OF + dt.timedelta(hours=1), "w1", "x")])
    assert one(users.actives(t, AS_OF, 1, "day"))["active_wallets"] == 0


def test_partial_period_only_in_economics_charts(spark):
    t = tables(
        spark,
        transactions=[tx("a", T(2024, 3, 5), "w1", "x", l1=10**18), tx("b", T(2024, 2, 5), "w1", "x", l1=10**18)],
        l1_batch_fees=[(T(2024, 3, 5), D("1.00"), D("2.00")), (T(2024, 2, 5), D("1.00"), D("2.00"))],
    )
    chart = users.transactions_chart(t, AS_OF, "month").collect()
    assert [r["date"] for r in chart] == ["24-02-01"]
    fees = economics.batch_fees(t, AS_OF, "month").collect()
    assert [r["date"] for r in fees] == ["24-02-01", "24-03-01"]


def _project_rows(n_wallets_by_contract, when=T(2024, 2, 10)):
    rows = []
    for c, n in n_wallets_by_contract.items():
        for i in range(n):
            rows.append(tx(f"{c}-{i}", when, f"w{i}", c, value=0, l1=10**14))
    return rows


def test_top_k_ties_lower_name_kept_and_small_projects_dropped(spark):
    wallets = {f"c{i:02d}": 30 - i for i in range(9)}  # c00..c08: 30..22 wallets, ranks 1-9
    wallets.update({"c10": 15, "c09": 15})  # tie at rank 10: c09 kept, c10 folded into Other
    wallets.update({"c11": 14, "small": 10})  # c11 -> Other; small (10 wallets) dropped everywhere
    contracts = [(c, "d", T(2020, 1, 1)) for c in wallets]
    t = tables(spark, transactions=_project_rows(wallets), contracts=contracts)
    rows = {r["project"]: r["num_transactions"] for r in users.contract_transactions_chart(t, AS_OF, "month").collect()}
    assert "c09" in rows and "c10" not in rows and "small" not in rows
    assert rows["Other"] == 15 + 14
    assert len(rows) == 11


def test_other_absent_when_nothing_left(spark):
    wallets = {"a": 12, "b": 11}
    t = tables(spark, transactions=_project_rows(wallets), contracts=[(c, "d", T(2020, 1, 1)) for c in wallets])
    rows = users.contract_users_chart(t, AS_OF, "month").collect()
    assert sorted(r["project"] for r in rows) == ["a", "b"]


def test_zero_value_call_to_non_contract_dropped_and_value_transfer_kept(spark):
    rows = [tx(f"v{i}", T(2024, 2, 10), f"w{i}", f"eoa{i}", value=1) for i in range(11)]
    rows += [tx(f"z{i}", T(2024, 2, 10), f"w{i}", "eoa", value=0) for i in range(11)]
    t = tables(spark, transactions=rows)
    out = users.contract_transactions_chart(t, AS_OF, "month").collect()
    assert [(r["project"], r["num_transactions"]) for r in out] == [("ETH transfer", 11)]


def test_two_addresses_one_label_stay_two_rows(spark):
    wallets = {"a1": 12, "a2": 11}
    labels = [("a1", "App", "app", "DEX"), ("a2", "App", "app", "DEX")]
    t = tables(spark, transactions=_project_rows(wallets), contracts=[(c, "d", T(2020, 1, 1)) for c in wallets], labels_apps=labels)
    out = users.contract_users_chart(t, AS_OF, "month").collect()
    assert [r["project"] for r in out] == ["App", "App"]


def test_previous_zero_trending_filtered_leaderboard_growth_zero(spark):
    rows = [tx(f"h{i}", AS_OF - dt.timedelta(days=3), f"w{i}", "c", l1=10**18) for i in range(20)]
    t = tables(spark, transactions=rows, contracts=[("c", "d", T(2020, 1, 1))], labels_apps=[("c", "App", "app", "DEX")])
    assert users.trending_contracts(t, AS_OF, "month").count() == 0
    row = one(bd.leaderboard(t, AS_OF, "month"))
    assert (row["wallets"], row["wallets_growth"], row["eth_fees_growth"], row["eth_fees"]) == (20, 0.0, 0.0, 20.0)


def test_trending_growth_and_threshold(spark):
    prev = [tx(f"p{i}", AS_OF - dt.timedelta(days=40), f"w{i}", "c", l1=10**18) for i in range(11)]
    cur = [tx(f"c{i}", AS_OF - dt.timedelta(days=3), f"w{i}", "c", l1=10**18) for i in range(22)]
    t = tables(spark, transactions=prev + cur, contracts=[("c", "d", T(2020, 1, 1))])
    row = one(users.trending_contracts(t, AS_OF, "month"))
    assert (row["project"], row["txns_current"], row["txn_growth"], row["accounts_growth"], row["gas_growth"]) == ("Unknown", 22, 100.0, 100.0, 100.0)


def test_null_and_excluded_categories_not_in_leaderboard(spark):
    rows = [tx("h1", AS_OF - dt.timedelta(days=1), "w", "a"), tx("h2", AS_OF - dt.timedelta(days=1), "w", "b"), tx("h3", AS_OF - dt.timedelta(days=1), "w", "n")]
    labels = [("a", "A", None, None), ("b", "B", "b", "NFT"), ("n", "N", "n", "DEX")]
    t = tables(spark, transactions=rows, labels_apps=labels)
    assert [r["project"] for r in bd.leaderboard(t, AS_OF, "month").collect()] == ["N"]


def test_missing_price_hour_and_zero_gas_price(spark):
    rows = [
        tx("priced", T(2024, 3, 1, 10, 30), "w", "x", l1=10**18, price=1, gas=1),
        tx("unpriced", T(2024, 3, 1, 11, 30), "w", "x", l1=2 * 10**18, price=1, gas=1),
        tx("zero_gas", T(2024, 3, 1, 10, 40), "w", "x", l1=4 * 10**18, price=0, gas=1),
    ]
    prices = [(T(2024, 3, 1, 10), "ETH", D("2000.00")), (T(2024, 3, 1, 11), "BTC", D("60000.00"))]
    t = tables(spark, transactions=rows, token_prices_hourly=prices)
    rev = one(economics.gas_revenue(t, AS_OF, "month"))
    assert (rev["gas_rev"], rev["gas_rev_usd"]) == (1.0, 2000.0)
    assert one(economics.scalar_revenue(t, AS_OF, "all"))["gas_rev"] == 3.0
    share = one(economics.l1vl2fee(t, AS_OF, "month"))
    assert share["l1_fee"] + share["l2_fee"] == pytest.approx(100.0)


def test_verification_joined_on_batch_period(spark):
    rows = [tx("a", T(2024, 2, 5), "w", "x", l1=10**18, price=1, gas=1), tx("b", T(2024, 3, 5), "w", "x", l1=10**18, price=1, gas=1)]
    prices = [(T(2024, 2, 5), "ETH", D("1.00")), (T(2024, 3, 5), "ETH", D("1.00"))]
    batch = [(T(2024, 3, 5), D("0.25"), D("0.25"))]
    verify = [(T(2024, 2, 5), D("0.5"), D("0.5")), (T(2024, 3, 5), D("0.5"), D("0.5"))]
    t = tables(spark, transactions=rows, token_prices_hourly=prices, l1_batch_fees=batch, l1_verification_fees=verify)
    out = {r["date"]: r["profit"] for r in economics.gross_profit(t, AS_OF, "month").collect()}
    assert out == {"24-02-01": 1.0, "24-03-01": 0.25}


def test_scalar_profit_null_without_revenue(spark):
    t = tables(spark, l1_batch_fees=[(AS_OF - dt.timedelta(days=1), D("1.00"), D("1.00"))])
    assert one(economics.scalar_profit(t, AS_OF, "week"))["profit"] is None


def test_fee_product_above_64_bits_is_exact(spark):
    gas_price, gas_used = 10**13, 5 * 10**6  # product 5e19 > 2^63
    t = tables(spark, transactions=[tx("a", AS_OF - dt.timedelta(hours=1), "w", "x", l1=1, price=gas_price, gas=gas_used)])
    assert one(economics.scalar_revenue(t, AS_OF, "week"))["gas_rev"] == 50.0


def test_rolling_mean_skips_calendar_gaps(spark):
    c = [(f"a{i}", f"d{i}", ts) for i, ts in enumerate([T(2024, 1, 1), T(2024, 1, 8), T(2024, 1, 8), T(2024, 1, 22)])]
    t = tables(spark, contracts=c)
    out = [r["all_deployers"] for r in deployers.all_deployers(t, AS_OF, "week").collect()]
    assert out == [1.0, 1.5, pytest.approx(4 / 3)]


def _dep(chain, who, ts, token="none", min_len=1, used=1):
    return (chain, who, ts, token, min_len, used)


def test_new_and_returning_by_week_within_one_month(spark):
    d = [_dep("c1", "x", T(2024, 1, 2)), _dep("c1", "x", T(2024, 1, 16)), _dep("c1", "y", T(2023, 12, 5)), _dep("c1", "y", T(2024, 1, 3))]
    t = tables(spark, deployments=d)
    out = {(r["date"], r["classification"]): r["num_accounts"] for r in deployers.returning_key_deployers(t, AS_OF, "month", "c1").collect()}
    assert out == {
        ("23-12-01", "Newly Active Deployer"): 1,
        ("24-01-01", "Newly Active Deployer"): 1,
        ("24-01-01", "Returning Deployer"): 2,
    }


def test_unqualified_and_null_token_type_deployments_drop(spark):
    d = [_dep("c1", "a", T(2024, 1, 2), token="erc20"), _dep("c1", "b", T(2024, 1, 2), token=None), _dep("c1", "c", T(2024, 1, 2), used=0), _dep("c1", "d", T(2024, 1, 2))]
    t = tables(spark, deployments=d)
    assert [r["filtered_deployers"] for r in deployers.key_deployers(t, AS_OF, "month", "c1").collect()] == [1.0]


def test_chain_series_keep_dates_present_everywhere(spark):
    d = [_dep(c, "a", T(2024, 1, 2)) for c in ("c1", "c2", "c3")] + [_dep(c, "a", T(2024, 1, 9)) for c in ("c1", "c2")]
    t = tables(spark, deployments=d)
    out = deployers.chain_key_deployers(t, AS_OF, "week", ("c1", "c2", "c3")).collect()
    assert [(r["date"], r["c1"], r["c2"], r["c3"]) for r in out] == [("24-01-01", 1.0, 1.0, 1.0)]


def test_commits_start_date_and_week_cut(spark):
    g = [(T(2023, 10, 6), "a"), (T(2023, 10, 7), "a"), (T(2023, 10, 7), "b"), (T(2024, 3, 19), "c")]
    t = tables(spark, git_commits=g)
    out = [(r["date"], r["commits"]) for r in deployers.commits(t, AS_OF, "month").collect()]
    assert out == [("23-10-01", 2.0)]  # 2023-10-06 excluded; the current week (from 2024-03-18) is cut
    devs = [(r["date"], r["active_devs"]) for r in deployers.git_devs(t, AS_OF, "month").collect()]
    assert devs == [("23-10-01", 2.0)]


def test_report_end_midnight_and_null_totals(spark):
    rows = [
        tx("a", T(2024, 1, 1, 5), "w", "x", l1=10**18, price=1, gas=1),
        tx("b", T(2024, 1, 2, 0, 0, 0), "w", "x", l1=10**18, price=1, gas=1),
        tx("c", T(2024, 1, 2, 0, 0, 1), "w", "x", l1=10**18, price=1, gas=1),
    ]
    day1, day2 = T(2024, 1, 1), T(2024, 1, 2)
    t = tables(
        spark,
        transactions=rows,
        l1_bridge_revenue=[(day1, D("0.50"))],
        l1_batch_fees=[(day1, D("0.10"), D("1")), (day2, D("0.10"), D("1"))],
        l1_verification_fees=[(day1, D("0.20"), D("1")), (day2, D("0.20"), D("1"))],
        l2_gas_oracle_fees=[(day1, D("0.05"))],
    )
    out = report.report(t, "2024-01-01", "2024-01-02").collect()
    assert [(r["day"], r["l2_transaction_quantity"]) for r in out] == [("2024-01-01", 1), ("2024-01-02", 1)]
    first, second = out
    assert (first["total_revenue"], first["total_cost"], first["l1_gas_oracle_cost"]) == (1.5, 0.35, 0.0)
    assert second["total_revenue"] is None and second["total_cost"] == pytest.approx(0.3)


def test_slug_without_payload_gets_null_tvl(spark):
    rows = [tx("h1", AS_OF - dt.timedelta(days=1), "w", "a"), tx("h2", AS_OF - dt.timedelta(days=1), "w", "b")]
    labels = [("a", "A", "sa", "DEX"), ("b", "B", "sb", "DEX")]
    payloads = [("sa", '{"currentChainTvls": {"main": 12.5}}')]
    t = tables(spark, transactions=rows, labels_apps=labels, protocol_tvl=payloads)
    out = {r["project"]: r["tvl"] for r in bd.leaderboard_tvl(t, AS_OF, "month", "main").collect()}
    assert out == {"A": 12.5, "B": None}
    assert sorted(r["slug"] for r in bd.slugs(t).collect()) == ["sa", "sb"]


def test_timeframe_rejected(spark):
    with pytest.raises(ValueError):
        users.active_accounts_chart(tables(spark), AS_OF, "year")


def test_dashboard_sink_writes_json_records(spark, tmp_path):
    from ledgerlens.plans.sink import write_dashboard

    t = tables(spark, transactions=[tx("a", T(2024, 3, 20, 1), "w1", "x"), tx("b", T(2024, 3, 19, 1), "w2", "x")])
    written = write_dashboard({"time": users.stamp(AS_OF), "cards": users.cards(t, AS_OF)}, str(tmp_path), fmt="json")
    assert list(written) == ["time", "cards"]
    assert one(spark.read.json(written["time"]))["time"] == users.stamp(AS_OF)
    row = one(spark.read.json(written["cards"]))
    assert (row["actives_24h"], row["actives_growth_24h"], row["actives_7d"]) == (1, 0.0, 2)
    assert users.stamp(AS_OF) == "20/03/24 12:00"


def test_as_of_defaults_to_now(spark):
    t = tables(spark, transactions=[tx("a", dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - dt.timedelta(hours=1), "w1", "x")])
    assert one(users.actives(t, None, 1, "day"))["active_wallets"] == 1


def test_wide_production_wei_columns_kept_exact(spark):
    from pyspark.sql import types as Ty

    wide = Ty.StructType([Ty.StructField(f.name, Ty.DecimalType(38, 0) if isinstance(f.dataType, Ty.DecimalType) else f.dataType) for f in SCHEMAS["transactions"].fields])
    big = 10**30  # does not fit the fixture width DECIMAL(26,0)
    df = spark.createDataFrame([("a", AS_OF - dt.timedelta(hours=1), "w", "x", D(0), D(big), D(10**13), D(5 * 10**6))], wide)
    t = Tables({"transactions": df})
    assert t["transactions"].schema["receipt_l1_fee"].dataType == Ty.DecimalType(38, 0)
    assert one(economics.scalar_revenue(t, AS_OF, "week"))["gas_rev"] == float(big // 10**18 + 50)


def test_scalar_profit_keeps_cents_with_wide_wei_columns(spark):
    from pyspark.sql import types as Ty

    wide = Ty.StructType([Ty.StructField(f.name, Ty.DecimalType(38, 0) if isinstance(f.dataType, Ty.DecimalType) else f.dataType) for f in SCHEMAS["transactions"].fields])
    df = spark.createDataFrame([("a", AS_OF - dt.timedelta(hours=1), "w", "x", D(0), D(3 * 10**18), D(1), D(1))], wide)
    t = Tables({"transactions": df, "l1_batch_fees": spark.createDataFrame([(AS_OF - dt.timedelta(hours=2), D("0.25"), D("1"))], SCHEMAS["l1_batch_fees"]),
                "l1_verification_fees": spark.createDataFrame([(AS_OF - dt.timedelta(hours=2), D("0.50"), D("1"))], SCHEMAS["l1_verification_fees"])})
    assert one(economics.scalar_profit(t, AS_OF, "week"))["profit"] == 2.25


def test_assert_unique_reports_duplicate_labels(spark):
    from ledgerlens.sources.registry import assert_unique

    clean = tables(spark, labels_apps=[("a", "A", "a", "DEX")], contracts=[("c", "d", T(2020, 1, 1))])
    assert_unique(clean)
    dup = tables(spark, labels_apps=[("a", "A", "a", "DEX"), ("a", "A2", "a", "DEX")])
    with pytest.raises(ValueError, match="labels_apps"):
        assert_unique(dup)
