"""Money is exact, clocks are UTC, keys are checked."""

import datetime as dt
from decimal import Decimal

import pytest

from ledgerlens.plans import economics, report, users
from ledgerlens.sources.registry import Tables
from ledgerlens.sources.schemas import SchemaError
from ledgerlens.timeframe import as_datetime

AT = dt.datetime(2024, 5, 3, 10)
CLOCK = dt.datetime(2024, 5, 9)


@pytest.fixture(params=["decimal(38,12)", "decimal(18,9)", "double"])
def tables(spark, request):
    kind = request.param
    cost = spark.createDataFrame([(AT, "0.0041", "14.123456789")] * 3, "t timestamp_ntz, a string, b string").selectExpr(
        "t as block_timestamp", f"cast(a as {kind}) as gas_spend", f"cast(b as {kind}) as gas_spend_usd")
    tx = spark.createDataFrame([("h", AT, "w", "c", Decimal(1), Decimal(0), Decimal(10**9 + 7), Decimal(30000))],
                               "hash string, block_timestamp timestamp_ntz, from_address string, to_address string, value decimal(38,0), receipt_l1_fee decimal(38,0), "
                               "receipt_effective_gas_price decimal(38,0), receipt_gas_used decimal(38,0)")
    price = spark.createDataFrame([(AT, "ETH", Decimal("3123.456789123"))], "hour timestamp_ntz, symbol string, usd_price decimal(20,9)")
    return Tables({"transactions": tx, "token_prices_hourly": price, "l1_batch_fees": cost, "l1_verification_fees": cost, "l1_gas_oracle_fees": cost.drop("gas_spend_usd"),
                   "l2_gas_oracle_fees": cost.drop("gas_spend_usd"), "l1_bridge_revenue": cost.selectExpr("block_timestamp", "gas_spend as bridge_fee")})


def test_small_amounts_keep_their_places(tables):
    fee = Decimal(10**9 + 7) * 30000
    eth = float(fee / 10**18)
    row = economics.batch_fees(tables, CLOCK, "month").collect()[0]
    assert (row.batch_fees, row.batch_fees_usd) == (0.0123, 42.370370367)
    row = economics.gas_revenue(tables, CLOCK, "day").collect()[0]
    assert row.gas_rev == eth and row.gas_rev_usd == pytest.approx(float(fee * Decimal("3123.456789123") / 10**18), rel=1e-15)
    row = economics.gross_profit(tables, CLOCK, "month").collect()[0]
    assert row.profit == pytest.approx(eth - 0.0246, rel=1e-14) and row.profit_usd == pytest.approx(float(fee * Decimal("3123.456789123") / 10**18 - Decimal("84.740740734")), rel=1e-14)
    for window in economics.SCALAR_WINDOWS:
        assert economics.scalar_revenue(tables, CLOCK, window).collect()[0][0] == eth
        assert economics.scalar_profit(tables, CLOCK, window).collect()[0][0] == pytest.approx(eth - 0.0246, rel=1e-14)
    row = report.report(tables, "2024-05-01", "2024-05-05", CLOCK).collect()[0]
    assert (row.l2_gas_rev, row.l1_messaging_rev, row.total_cost) == (eth, 0.0123, 0.0492)


def test_narrowing_sources_are_refused(spark):
    wide = spark.createDataFrame([(AT, Decimal("0.1234567890123456789"))], "block_timestamp timestamp_ntz, gas_spend decimal(38,19)")
    with pytest.raises(SchemaError, match="more places"):
        Tables({"l1_gas_oracle_fees": wide})["l1_gas_oracle_fees"]


def test_clocks_with_an_offset_are_converted(spark):
    zone = dt.timezone(dt.timedelta(hours=2))
    assert as_datetime(dt.datetime(2024, 5, 3, 12, tzinfo=zone)) == as_datetime("2024-05-03T12:00:00+02:00") == AT
    assert as_datetime("2024-05-03T10:00:00Z") == as_datetime("2024-05-03 10:00:00") == AT
    tx = spark.createDataFrame([("h", dt.datetime(2024, 5, 3, 11), "w")], "hash string, block_timestamp timestamp_ntz, from_address string")
    tx = tx.selectExpr("*", "'c' as to_address", *[f"cast(0 as decimal(38,0)) as {c}" for c in ("value", "receipt_l1_fee", "receipt_effective_gas_price", "receipt_gas_used")])
    for clock, n in ((dt.datetime(2024, 5, 3, 12, tzinfo=zone), 0), ("2024-05-03T13:30:00+02:00", 1)):
        assert users.actives(Tables({"transactions": tx}), clock, 1, "day").collect()[0][0] == n


def test_duplicate_keys_are_found_on_load(spark):
    payloads = spark.createDataFrame([("a", "{}"), ("a", "{}"), ("b", "{}")], "slug string, payload string")
    with pytest.raises(ValueError, match="protocol_tvl"):
        Tables({"protocol_tvl": payloads}).validated()
    assert Tables({"protocol_tvl": payloads.dropDuplicates()}).validated()["protocol_tvl"].count() == 2


def test_periods_without_a_named_deployer_stay(spark):
    from ledgerlens.plans import deployers

    rows = [("c1", None, AT, "none", 1, 1), ("c1", "d", AT + dt.timedelta(days=1), "none", 1, 1)]
    frame = spark.createDataFrame(rows, "chain string, deployer string, created_at timestamp_ntz, token_type string, is_min_length int, is_used int")
    got = [tuple(r) for r in deployers.returning_key_deployers(Tables({"deployments": frame}), CLOCK, "day", "c1").collect()]
    assert got == [("24-05-03", "Newly Active Deployer", 0), ("24-05-04", "Newly Active Deployer", 1)]
