"""Joins on the target address: the bucketed layout (no shuffle, hot targets spread, results exact) and the runtime filter of app labels."""

import datetime as dt
from decimal import Decimal as D

import pytest

from ledgerlens.plans import bd, stored, users
from ledgerlens.session import CLUSTER
from ledgerlens.sources import bucketed
from ledgerlens.sources.registry import Tables
from ledgerlens.sources.schemas import SCHEMAS

AS_OF = dt.datetime(2024, 3, 20, 12)
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture()
def conf(spark):
    old: dict = {}

    def set_all(values: dict) -> None:
        for k, v in values.items():
            old.setdefault(k, spark.conf.get(k, None))
            spark.conf.set(k, v)

    yield set_all
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture()
def tables(spark):
    """A contract and an account that is none hold a third of the rows each, others have no target; contracts appear late."""
    rows = []
    for i in range(6000):
        to = ("hot_contract", "hot_account", None if i % 9 == 2 else f"c{i % 211}")[i % 3]
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=19 * i)
        rows.append((f"h{i - i % 17 if i % 40 == 0 else i}", ts, None if i % 31 == 0 else f"w{i % 97}", to, D(i % 2), D(10**14 + i), D(10**9), D(21000)))
    contracts = [("hot_contract", "d", dt.datetime(2020, 1, 1))] + [(f"c{j}", "d", dt.datetime(2020 if j % 4 else 2025, 1, 1)) for j in range(0, 211, 2)]
    labels = [("hot_contract", "Hot", "hot", "DeFi"), ("c2", "Two", "two", "DeFi"), ("c4", "Coin", "coin", "ERC20")]
    frames = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    frames["transactions"] = spark.createDataFrame(rows, SCHEMAS["transactions"]).repartition(8)
    frames["contracts"] = spark.createDataFrame(contracts, SCHEMAS["contracts"])
    frames["labels_apps"] = spark.createDataFrame(labels, SCHEMAS["labels_apps"])
    return Tables(frames)


def exchanges_below_joins(df) -> list[str]:
    """The lines of the plan below its first sort-merge join that are shuffles."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    return [line for line in lines[at:] if "Exchange hashpartitioning" in line or "Exchange SinglePartition" in line]


@pytest.mark.parametrize("share", [None, 0.2, 1e-6, 1.0])
def test_charts_equal_whatever_is_hot_and_join_without_shuffle(spark, tables, conf, tmp_path, share):
    want = {tf: users.project_charts(tables, AS_OF, tf, 0).collect() for tf in ("week", "month")}
    at = bucketed.write_targets(spark, tables["transactions"], tables["contracts"], f"t_{tmp_path.name}", 8, share, str(tmp_path))
    hot = {r.address for r in at.hot.collect()}
    assert hot == {0.2: {"hot_contract", "hot_account"}, 1.0: set()}.get(share, hot)
    conf(NO_BROADCAST)
    for tf, rows in want.items():
        df = stored.project_charts(at, tables, AS_OF, tf, 0)
        assert exchanges_below_joins(stored.project_rows(at, AS_OF, tf)) == []
        assert df.collect() == rows
    assert {r.project for r in want["month"]} >= {"Hot", "ETH transfer", "Other"}


def test_hot_targets_fill_buckets_evenly(spark, tables, tmp_path):
    """A third of all rows on one address: no bucket holds more than its share and what the cold addresses add."""
    from pyspark.sql import functions as F

    at = bucketed.write_targets(spark, tables["transactions"], tables["contracts"], f"t_{tmp_path.name}", 8, 0.05, str(tmp_path))
    per = [r["count"] for r in at.transactions.groupBy(F.pmod(F.hash("target_key"), F.lit(8)).alias("bucket")).count().collect()]
    assert len(per) == 8 and sum(per) == 6000 and max(per) < 2 * 6000 / 8
    assert at.transactions.where("target_key = to_address and to_address like 'hot%'").count() == 0


def test_buckets_grow_with_the_rows_and_targets_are_counted_once(spark, tables, tmp_path, monkeypatch):
    """A bucket is one task: with more rows there are more buckets, not larger ones, and results stay the same."""
    from pyspark.sql import functions as F

    want = users.project_charts(tables, AS_OF, "week", 0).collect()
    monkeypatch.setattr(bucketed, "ROWS_PER_BUCKET", 500)
    at = bucketed.write_targets(spark, tables["transactions"], tables["contracts"], f"t_{tmp_path.name}", 2, None, str(tmp_path))
    for name, n in (("transactions", 12), ("contracts", 12)):
        described = {r.col_name: r.data_type for r in spark.sql(f"describe extended t_{tmp_path.name}_{name}").collect()}
        assert described["Num Buckets"] == str(n)
    per = [r["count"] for r in at.transactions.groupBy(F.pmod(F.hash("target_key"), F.lit(12)).alias("bucket")).count().collect()]
    assert sum(per) == 6000 and max(per) < 2 * 500
    assert stored.project_charts(at, tables, AS_OF, "week", 0).collect() == want


def test_one_file_a_day_and_bucket_and_days_pruned(spark, tables, tmp_path):
    at = bucketed.write_targets(spark, tables["transactions"], tables["contracts"], f"t_{tmp_path.name}", 4, None, str(tmp_path))
    days = list((tmp_path / "transactions").glob("block_date=*"))
    assert len(days) > 70 and all(len(list(d.glob("*.parquet"))) <= 4 for d in days)
    plan = stored.project_rows(at, dt.datetime(2024, 1, 10), "week")._jdf.queryExecution().executedPlan().toString()
    assert "block_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_tables_and_bad_parameters(spark, tables, tmp_path):
    none = tables["transactions"].limit(0)
    at = bucketed.write_targets(spark, none, tables["contracts"].limit(0), f"t_{tmp_path.name}", 2, None, str(tmp_path))
    assert stored.project_charts(at, tables, AS_OF, "week").collect() == []
    assert bucketed.is_stored(spark, f"t_{tmp_path.name}") and not bucketed.is_stored(spark, "t_nothing")
    for buckets, share in ((0, None), (4, 0.0), (4, 1.5)):
        with pytest.raises(ValueError):
            bucketed.write_targets(spark, none, tables["contracts"], "t_bad", buckets, share, str(tmp_path))


def shuffled_rows(df) -> list[int]:
    """Rows written by each shuffle of an executed plan."""
    out: list[int] = []

    def walk(node) -> None:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            out.append(node.metrics().get("shuffleRecordsWritten").get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_app_labels_beyond_the_broadcast_sift_transactions_before_the_shuffle(spark, tables, conf, tmp_path):
    for name in ("transactions", "labels_apps"):
        tables[name].write.parquet(str(tmp_path / name))
    at = Tables.from_parquet(spark, str(tmp_path), ["transactions", "labels_apps"])
    conf(NO_BROADCAST | {k: v for k, v in CLUSTER.items() if "bloomFilter" in k})
    sift = "spark.sql.optimizer.runtime.bloomFilter.enabled"
    conf({"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1KB", sift: "false"})
    plain = bd.leaderboard(at, AS_OF, "month")
    want = plain.collect()
    conf({sift: "true"})
    df = bd.leaderboard(at, AS_OF, "month")
    rows = df.collect()
    assert rows == want and {r.project for r in rows} == {"Hot", "Two"}
    assert "might_contain" in df._jdf.queryExecution().optimizedPlan().toString()
    assert "might_contain" not in plain._jdf.queryExecution().optimizedPlan().toString()
    # The largest shuffle of the plain plan is that of the transactions; only rows of labelled apps are left of it.
    known = at["transactions"].where("to_address in ('hot_contract', 'c2')").count()
    assert max(shuffled_rows(plain)) > 1.4 * max(shuffled_rows(df))
    assert max(shuffled_rows(df)) <= 2 * known
