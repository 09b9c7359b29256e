"""A contract and a wallet that each hold a third of all rows: plans split the hot key and results stay exact."""

import datetime as dt
from decimal import Decimal as D

import pytest

from ledgerlens.plans import users
from ledgerlens.sources.registry import Tables
from ledgerlens.sources.schemas import SCHEMAS

AS_OF = dt.datetime(2024, 3, 20, 12)
SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",  # force the sort-merge join a large contract table would get
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture()
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    n = 30000
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        to = "hot_contract" if hot else f"c{i % 400}"
        frm = "hot_wallet" if i % 3 == 1 else f"w{i % 5000}"
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i)
        rows.append((f"h{i}", ts, frm, to, D(i % 2), D(10**14), D(10**9), D(21000)))
    contracts = [("hot_contract", "d", dt.datetime(2020, 1, 1))] + [(f"c{j}", "d", dt.datetime(2020, 1, 1)) for j in range(0, 400, 2)]
    frames = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    frames["transactions"] = spark.createDataFrame(rows, SCHEMAS["transactions"]).repartition(16)
    frames["contracts"] = spark.createDataFrame(contracts, SCHEMAS["contracts"])
    yield Tables(frames)
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("hot_targets", [1, 3, 10_000])
def test_hot_contract_and_missing_targets_need_no_skew_split(spark, skewed, monkeypatch, hot_targets):
    """Default skew thresholds, skew join off: the hot contract's rows and those without a target are spread."""
    from pyspark.sql import functions as F

    from ledgerlens.operators import ranking

    monkeypatch.setattr(ranking, "HOT_TARGETS", hot_targets)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    gone = F.col("hash").rlike("[05]$") & (F.col("to_address") != "hot_contract")
    tables = skewed.with_tables(transactions=skewed["transactions"].withColumn("to_address", F.when(~gone, F.col("to_address"))))
    df = users.contract_transactions_chart(tables, AS_OF, "month", min_wallets=0)
    rows = df.collect()
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in plan and "TakeOrderedAndProject" in plan or "GlobalLimit" in plan
    known = {r.address for r in tables["contracts"].collect()}
    counts: dict[tuple, set] = {}
    for r in tables.as_of(AS_OF)["transactions"].select("hash", "to_address", "value", F.date_format(F.date_trunc("month", "block_timestamp"), "yyyy-MM-dd").alias("d")).collect():
        if r.to_address in known or r.value > 0:
            counts.setdefault((r.d, r.to_address if r.to_address in known else "ETH transfer"), set()).add(r.hash)
    total: dict[str, int] = {}
    for (d, _), hashes in counts.items():
        total[d] = total.get(d, 0) + len(hashes)
    assert {d: sum(r["num_transactions"] for r in rows if r["date"] == d) for d in total} == total
    for r in rows:
        if r["project"] in ("hot_contract", "ETH transfer"):
            assert r["num_transactions"] == len(counts[r["date"], r["project"]])
    assert {r["project"] for r in rows} >= {"hot_contract", "ETH transfer", "Other"}


def test_hot_wallet_and_contract_results_exact(spark, skewed):
    tx = skewed.as_of(AS_OF)["transactions"]
    from pyspark.sql import functions as F

    want = {r["d"]: r["n"] for r in tx.groupBy(F.date_format(F.date_trunc("month", "block_timestamp"), "yy-MM-dd").alias("d")).agg(F.count_distinct("from_address").alias("n")).collect()}
    got = {r["date"]: r["active_wallets"] for r in users.active_accounts_chart(skewed, AS_OF, "month").collect()}
    assert got == {d: n for d, n in want.items() if d < "24-03-01"}
    retention = users.retention_chart(skewed, AS_OF, "month").collect()
    assert all(r["percentage"] == 100.0 for r in retention if r["month_number"] == 0)


def test_rows_of_hot_targets_are_not_shuffled_to_meet_the_contracts(spark, skewed, monkeypatch):
    """The hot contract is a third of all rows: the contract join's shuffle has the rows of other targets only."""
    from pyspark.sql import functions as F

    from ledgerlens.operators import ranking
    from test_bucketed import shuffled_rows

    monkeypatch.setattr(ranking, "HOT_TARGETS", 1)
    tx = skewed["transactions"].withColumn("to_address", F.when(~F.col("hash").endswith("7"), F.col("to_address")))
    rows = tx.select("hash", "from_address", "to_address", (F.col("value") > 0).alias("_transfer")).localCheckpoint()
    df = ranking._classified_spread(rows, skewed["contracts"]).select("hash", "project")
    got = sorted(df.collect())
    plain = sorted(ranking._classified(rows, skewed["contracts"]).filter("to_address is not null or _transfer").select("hash", "project").collect())
    assert got == plain and len(got) > 20000
    cold = rows.filter("to_address <> 'hot_contract'").count()
    assert 0 < max(shuffled_rows(df)) <= cold < 20000
