"""The publishing stream recomputes dashboards from stored tables when transaction files arrive."""

import uuid

from ledgerlens.plans import economics
from ledgerlens.plans.sink import read_dashboard
from ledgerlens.sources import fixtures as fx
from ledgerlens.sources.registry import Tables
from ledgerlens.streaming.refresh import start_refresh

SF = "/root/testdata/sf0.001"
NAMES = ["transactions", "token_prices_hourly", "l1_batch_fees", "l1_verification_fees", "contracts", "labels_apps",
         "l1_bridge_revenue", "l1_gas_oracle_fees", "l2_gas_oracle_fees", "protocol_tvl"]


def test_refresh_publishes_on_arrival_and_resumes(spark, tmp_path):
    root = tmp_path / "tables"
    src = fx.long_history(spark, SF)
    for name in NAMES:
        src[name].write.parquet(str(root / name))
    out = tmp_path / "published"

    def factory():
        return Tables.from_parquet(spark, str(root), NAMES)

    query_name = f"refresh_test_{uuid.uuid4().hex}"  # checkpoints live under spark.checkpoint.dir

    def run():
        q = start_refresh(spark, str(root / "transactions"), factory, str(out), "month", ("economics",),
                          clock=lambda: fx.LONG_AS_OF, available_now=True, query_name=query_name)
        q.awaitTermination(300)
        return q

    run()
    got = sorted(map(tuple, read_dashboard(spark, str(out / "economics"), "gas_revenue").collect()))
    want = sorted(map(tuple, economics.gas_revenue(factory(), fx.LONG_AS_OF, "month").collect()))
    assert got == want and len(got) == 79
    # A second run with no new files publishes nothing new: the checkpoint records the files already seen.
    versions = spark.read.parquet(str(out / "economics" / "published")).count()
    run()
    assert spark.read.parquet(str(out / "economics" / "published")).count() == versions == 1


def test_publish_deployers_and_developers_with_options(spark, tmp_path):
    from ledgerlens.plans import deployers
    from ledgerlens.streaming.refresh import publish

    tables = fx.long_history(spark, SF)
    written = publish(tables, fx.LONG_AS_OF, str(tmp_path), "week", ["deployers", "developers"], fmt="json",
                      options={"deployers": {"chain": "c1", "chains": fx.FIXTURE_CHAINS}})
    assert set(written) == {"deployers.all_deployers", "deployers.key_deployers", "deployers.returning_key_deployers",
                            "deployers.chain_key_deployers", "developers.commits", "developers.git_devs"}
    got = spark.read.json(written["deployers.key_deployers"]).count()
    assert got == deployers.key_deployers(tables, fx.LONG_AS_OF, "week", "c1").count() > 0


def test_publish_all_six_dashboards_with_rollups_time_and_report(spark, tmp_path):
    from ledgerlens.plans import users
    from ledgerlens.streaming.refresh import DASHBOARDS, publish

    tables = fx.long_history(spark, SF)
    options = {"deployers": {"chain": "c1", "chains": fx.FIXTURE_CHAINS}, "econ_report": {"start": fx.REPORT_START, "end": fx.REPORT_END}}
    out, rollups = str(tmp_path / "out"), str(tmp_path / "rollups")
    for _ in range(2):
        written = publish(tables, fx.LONG_AS_OF, out, "month", list(DASHBOARDS), options=options, rollup_dir=rollups, spark=spark)
    assert read_dashboard(spark, f"{out}/users", "time").collect()[0][0] == users.stamp(fx.LONG_AS_OF)
    assert read_dashboard(spark, f"{out}/econ_report", "report").count() > 0
    assert {k.split(".")[0] for k in written} == set(DASHBOARDS)
    for name, key, direct in (("users", "retention_chart", users.retention_chart), ("users", "transactions_chart", users.transactions_chart), ("economics", "gross_profit", economics.gross_profit)):
        assert sorted(map(tuple, read_dashboard(spark, f"{out}/{name}", key).collect())) == sorted(map(tuple, direct(tables, fx.LONG_AS_OF, "month").collect()))


def test_rollups_append_closed_days_and_take_late_rows(spark, tmp_path):
    import datetime as dt

    from ledgerlens.plans import rollups, users

    tx = fx.long_history(spark, SF)["transactions"].cache()
    clock = dt.datetime(1996, 5, 20, 7)
    late = tx.filter("block_timestamp = timestamp_ntz '1996-05-19'").limit(1)
    first = Tables({"transactions": tx.filter("block_timestamp < timestamp_ntz '1996-05-19'")})
    everything = Tables({"transactions": tx.unionByName(late)})
    root = str(tmp_path)
    rollups.refresh(spark, first, root, clock)
    for at in (clock + dt.timedelta(days=1), clock + dt.timedelta(days=40)):
        rollups.refresh(spark, everything, root, at)
        for name, (direct, *_) in rollups.ROLLUPS.items():
            got = rollups.read(spark, everything, root, name, at)
            want = direct(everything, at)
            assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        chart = users.retention_chart(everything, at, "week", rollups.read(spark, everything, root, "daily_activity", at))
        assert chart.collect() == users.retention_chart(everything, at, "week").collect()
    tx.unpersist()


def test_rollups_take_rows_that_are_ten_and_thirty_days_late(spark, tmp_path):
    import datetime as dt

    from ledgerlens.plans import rollups
    from ledgerlens.sources.schemas import SCHEMAS
    from ledgerlens.state.keysets import runs_of

    clock = dt.datetime(1996, 5, 20, 7)
    fees = ("receipt_effective_gas_price", "receipt_gas_used", "receipt_l1_fee")
    schema = SCHEMAS["transactions"]
    times = [dt.datetime(1996, 5, 20, 5) - dt.timedelta(days=k % 40, hours=k % 3) for k in range(160)]
    made = spark.createDataFrame([(t, f"0x{k % 7}") for k, t in enumerate(times)], "t timestamp_ntz, a string")
    value = {"block_timestamp": "t", "from_address": "a"}
    tx = made.selectExpr(*[f"cast({value.get(f.name, '7' if f.name in fees else 'null')} as {f.dataType.simpleString()}) as {f.name}" for f in schema.fields]).cache()
    late = [f"(to_date(block_timestamp) = date '{x}' and {rows})" for x, rows in (("1996-05-09", "from_address < '0x4'"), ("1996-04-20", "true"))]
    before, after = Tables({"transactions": tx.filter(f"not ({' or '.join(late)})")}), Tables({"transactions": tx})
    assert all(tx.filter(x).count() for x in late)
    rollups.refresh(spark, before, str(tmp_path), clock)
    rollups.refresh(spark, after, str(tmp_path), clock)
    for name, (direct, *_) in rollups.ROLLUPS.items():
        got, want = rollups.read(spark, after, str(tmp_path), name, clock), direct(after, clock)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, name
    assert set(map(tuple, rollups.refresh(spark, after, str(tmp_path), clock).values())) == {()}
    days = {dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 2, 1), dt.date(2024, 2, 3)}
    at = lambda m, d: dt.datetime(2024, m, d)
    assert runs_of(days) == [(at(1, 1), at(1, 3)), (at(2, 1), at(2, 2)), (at(2, 3), at(2, 4))]
    assert runs_of(days, most=2) == [(at(1, 1), at(1, 3)), (at(2, 1), at(2, 4))]
    tx.unpersist()
