"""Stored key sets, rollups and manifests against the direct plans: late, replaced and removed days, windows that divide days."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import bd, deployers, economics, rollups, stored, users
from ledgerlens.sources.layout import write_fact_table
from ledgerlens.sources.registry import Tables
from ledgerlens.sources.schemas import SCHEMAS
from ledgerlens.state.keysets import KeySets, _ids, _sets

CLOCK = dt.datetime(2024, 3, 20, 7, 45, 30)
DAY = dt.timedelta(days=1)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def same(a, b):
    assert a.columns == b.columns and rows_of(a) == rows_of(b)


def transactions(spark, rows):
    """(time, sender, target, hash) with fees that depend on the hash."""
    made = spark.createDataFrame(rows, "block_timestamp timestamp_ntz, from_address string, to_address string, hash string")
    fee = F.crc32(F.coalesce("hash", F.lit("")))
    made = made.withColumns({"value": F.lit(None), "receipt_l1_fee": fee, "receipt_effective_gas_price": fee % 5, "receipt_gas_used": fee % 1000})
    return made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS["transactions"].fields])


def chain_rows(n=1500, seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        ts = CLOCK - dt.timedelta(days=int(rng.triangular(0, 75, 0)), seconds=rng.randint(0, 86400))
        sender = None if k % 40 == 0 else f"0x{int(rng.triangular(0, 90, 10))}"
        out.append((ts, sender, rng.choice(["A", "B", "C", "D", None]), None if k % 97 == 0 else f"h{k}"))
    edge = [CLOCK, CLOCK - DAY, CLOCK - 2 * DAY, CLOCK - 7 * DAY, dt.datetime(2024, 2, 20, 7, 45, 30), dt.datetime(2024, 1, 20, 7, 45, 30), dt.datetime(2024, 3, 19), dt.datetime(2024, 3, 20)]
    out += [(ts + dt.timedelta(microseconds=x), f"0xe{j}", "A", f"e{j}{x}") for j, ts in enumerate(edge) for x in (-1, 0, 1)]
    out += [out[5], out[5], (dt.datetime(2023, 11, 1), None, "A", "lone"), (CLOCK + DAY, "future", "A", "f")]
    return out


def registry(spark, tx, **more):
    contracts = spark.createDataFrame([("A",), ("B",), ("C",)], "address string").withColumns({"deployer": F.lit("x"), "block_timestamp": F.lit("2023-01-01").cast("timestamp_ntz")})
    labels = spark.createDataFrame([("A", "App", "app", "DEX"), ("B", "App", "app", "DEX"), ("D", "Coin", None, "ERC20"), ("C", "Solo", None, "NFT2")], "address string, name string, slug string, category string")
    return Tables({"transactions": tx, "contracts": contracts, "labels_apps": labels, **more})


def check_users(state, tables, at=CLOCK):
    same(stored.cards(state, tables, at), users.cards(tables, at))
    same(stored.actives(state, tables, at, 7, "day"), users.actives(tables, at, 7, "day"))
    same(stored.actives_growth(state, tables, at, 1, "month", "g"), users.actives_growth(tables, at, 1, "month", "g"))
    for tf in ("day", "month"):
        same(stored.active_accounts_chart(state, at, tf), users.active_accounts_chart(tables, at, tf))
    for tf in ("day", "week"):
        same(stored.retention_chart(state, at, tf), users.retention_chart(tables, at, tf))


def test_bitmaps_hold_their_ids(spark):
    ids = [0, 1, 7, 8, 32767, 32768, 40000, 3 * 32768 + 5]
    df = spark.createDataFrame([(dt.date(2024, 1, 1 + k % 2), i) for k, i in enumerate(ids)], "block_date date, id long")
    assert rows_of(_ids(_sets(df, "block_date"))) == rows_of(df)


def test_sets_are_made_where_all_ids_of_a_bucket_are(spark):
    """A day's bucket is dealt as ids, once: no task makes bitmaps of its own of a bucket that others hold ids of."""
    ids = spark.range(0, 8 * 32768, 16, 8).select((F.col("id") / 16 % 3).cast("int").alias("d"), F.expr("id * 7 % 65536 + id % 3").alias("id")).distinct()
    df = _sets(ids.repartition(8).select(F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("d")).alias("block_date"), "id"), "block_date")
    assert sorted(_ids(df).collect()) == sorted(ids.select(F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("d")).alias("block_date"), "id").collect())
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    shuffled = next(line for line in plan if "Exchange hashpartitioning(block_date" in line)
    assert "bitmap_construct_agg" not in "".join(plan[plan.index(shuffled) + 1:]), plan


def test_sets_follow_late_replaced_and_removed_rows(spark, tmp_path):
    rows = chain_rows()
    day = lambda r: (CLOCK - r[0]).days
    late = [r for r in rows if day(r) in (30, 31, 55) and r[1] in ("0x3", "0x9", "0x20", "0x70", "0x80")]
    # First a part of the rows at an earlier clock, among them a sender's only early row that goes later.
    early = [(CLOCK - 70 * DAY, "0xgone", "A", "g1"), (CLOCK - 70 * DAY, "0xmoves", "A", "g2"), (CLOCK - 20 * DAY, "0xmoves", "A", "g3")]
    first = registry(spark, transactions(spark, [r for r in rows if r not in late] + early))
    state = stored.senders(spark, first, str(tmp_path / "s"), CLOCK - 9 * DAY)
    check_users(state, first, CLOCK - 9 * DAY)
    # Late rows come, a day loses rows and another has a sender replaced at the same number of rows.
    swapped = [(t, "0xnew" if s == "0x10" and day((t, s)) == 40 else s, a, h) for t, s, a, h in rows]
    later = registry(spark, transactions(spark, [*swapped, early[2]]))
    state = stored.senders(spark, later, str(tmp_path / "s"), CLOCK)
    check_users(state, later)
    assert KeySets(spark, str(tmp_path / "s")).until == dt.datetime(2024, 3, 20)
    # All rows of a sender come back; nothing changes after that.
    again = registry(spark, transactions(spark, [*rows, *early]))
    state = stored.senders(spark, again, str(tmp_path / "s"), CLOCK)
    check_users(state, again)
    version = state.commit.facts, state.commit.live["firsts"]
    state = stored.senders(spark, again, str(tmp_path / "s"), CLOCK)
    assert (state.commit.facts, state.commit.live["firsts"]) == version
    # Days since the last refresh are read from the facts.
    same(stored.cards(state, again, CLOCK + 3 * DAY), users.cards(again, CLOCK + 3 * DAY))
    with pytest.raises(ValueError):
        stored.active_accounts_chart(state, CLOCK + 3 * DAY, "day")


def test_empty_history(spark, tmp_path):
    none = registry(spark, transactions(spark, []))
    state = stored.senders(spark, none, str(tmp_path / "s"), CLOCK)
    check_users(state, none)


def by_day(spark, root, tx):
    write_fact_table("transactions", tx, f"{root}/transactions")
    return Tables.from_parquet(spark, str(root), ["transactions"])


def test_refresh_reads_only_days_of_new_files_and_windows_only_their_ends(spark, tmp_path):
    rows = [r for r in chain_rows() if r[0] <= CLOCK]
    tables = by_day(spark, tmp_path / "all", transactions(spark, rows))
    dims = registry(spark, None)
    tables = tables.with_tables(contracts=dims["contracts"], labels_apps=dims["labels_apps"])
    state = stored.senders(spark, tables, str(tmp_path / "s"), CLOCK)
    rollups.refresh(spark, tables, str(tmp_path / "r"), CLOCK)
    # A copy that has nothing but the days at the windows' ends: what is read is there, so results stay the same.
    ends = {(CLOCK - k * DAY).date() for k in (0, 1, 2, 7, 14)} | {dt.date(2024, 2, 20), dt.date(2024, 1, 20)}
    for d in ends:
        folder = f"transactions/block_date={d}"
        if (tmp_path / "all" / folder).exists():
            shutil.copytree(tmp_path / "all" / folder, tmp_path / "ends" / folder)
    cut = Tables.from_parquet(spark, str(tmp_path / "ends"), ["transactions"]).with_tables(contracts=dims["contracts"], labels_apps=dims["labels_apps"])
    same(stored.cards(state, cut, CLOCK), users.cards(tables, CLOCK))
    same(stored.retention_chart(state, CLOCK, "week"), users.retention_chart(tables, CLOCK, "week"))
    activity, hourly = (rollups.read(spark, cut, str(tmp_path / "r"), name, CLOCK) for name in ("target_activity", "hourly_fees"))
    for tf in ("week", "month", "day"):
        same(stored.trending_contracts(activity, cut, CLOCK, tf, min_wallets=0), users.trending_contracts(tables, CLOCK, tf, min_wallets=0))
        same(stored.leaderboard(activity, cut, CLOCK, tf), bd.leaderboard(tables, CLOCK, tf))
    for window in ("week", "month", "all"):
        same(economics.scalar_revenue(cut, CLOCK, window, hourly), economics.scalar_revenue(tables, CLOCK, window))
    plan = stored.cards(state, tables, CLOCK)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "from_address" in line]
    assert scans and all("PartitionFilters" in s and "block_date" in s for s in scans)

    # A day is replaced by a file with as many rows, another gets a file 60 days late: these two days are read, no other one.
    replaced, grown = (CLOCK - 12 * DAY).date(), (CLOCK - 60 * DAY).date()
    old = [r for r in rows if r[0].date() == replaced]
    assert old
    shutil.rmtree(tmp_path / "all" / f"transactions/block_date={replaced}")
    write_fact_table("transactions", transactions(spark, [(t, f"{s}-other", a, h) for t, s, a, h in old]), str(tmp_path / "all/transactions"), mode="append")
    write_fact_table("transactions", transactions(spark, [(dt.datetime.combine(grown, dt.time(3)), s, "A", f"late{s}") for s in ("0x1", "0xlate", "0x50")]), str(tmp_path / "all/transactions"), mode="append")
    tables = Tables.from_parquet(spark, str(tmp_path / "all"), ["transactions"]).with_tables(contracts=dims["contracts"], labels_apps=dims["labels_apps"])
    files, changed = stored.changes(tables, "transactions", state.seen_files())
    assert sorted(changed) == [grown, replaced] and files.count() > 20
    assert set(map(tuple, rollups.refresh(spark, tables, str(tmp_path / "r"), CLOCK).values())) == {(grown, replaced)}
    state = stored.senders(spark, tables, str(tmp_path / "s"), CLOCK)
    check_users(state, tables)
    for name, (direct, *_) in rollups.ROLLUPS.items():
        same(rollups.read(spark, tables, str(tmp_path / "r"), name, CLOCK), direct(tables, CLOCK))


def test_manifest_of_a_table_without_day_folders_reads_new_files_only(spark, tmp_path):
    path = str(tmp_path / "transactions")
    rows = [r for r in chain_rows(200) if r[0] <= CLOCK]
    transactions(spark, rows).coalesce(2).write.parquet(path)
    tables = Tables.from_parquet(spark, str(tmp_path), ["transactions"])
    state = stored.senders(spark, tables, str(tmp_path / "s"), CLOCK)
    transactions(spark, [(CLOCK - 33 * DAY, "0xlate", "A", "l"), (CLOCK - 34 * DAY, "0x1", "A", "m")]).coalesce(1).write.mode("append").parquet(path)
    tables = Tables.from_parquet(spark, str(tmp_path), ["transactions"])
    _, changed = stored.changes(tables, "transactions", state.seen_files())
    assert sorted(changed) == [(CLOCK - 34 * DAY).date(), (CLOCK - 33 * DAY).date()]
    state = stored.senders(spark, tables, str(tmp_path / "s"), CLOCK)
    same(stored.cards(state, tables, CLOCK), users.cards(tables, CLOCK))
    same(stored.retention_chart(state, CLOCK, "week"), users.retention_chart(tables, CLOCK, "week"))


def test_first_seen_split_moves_with_late_deployments(spark, tmp_path):
    rng = random.Random(8)
    rows = [("c1" if k % 5 else "c2", None if k % 50 == 0 else f"d{int(rng.triangular(0, 60, 5))}", CLOCK - dt.timedelta(days=rng.randint(0, 100), hours=rng.randint(0, 20)),
             rng.choice(["none", "none", "erc20", None]), rng.choice([1, 1, 0]), 1) for k in range(900)]
    late = [("c1", "d7", CLOCK - 30 * DAY, "none", 1, 1), ("c1", "d5", CLOCK - 130 * DAY, "none", 1, 1), ("c1", "dx", CLOCK - 95 * DAY, "none", 1, 1)]
    kind = "chain string, deployer string, created_at timestamp_ntz, token_type string, is_min_length int, is_used int"
    for data in (rows, rows + late):
        tables = Tables({"deployments": spark.createDataFrame(data, kind)})
        state = stored.key_deployers(spark, tables, str(tmp_path / "d"), CLOCK, "c1")
        for tf in ("day", "week", "month"):
            same(stored.returning_key_deployers(state, CLOCK, tf), deployers.returning_key_deployers(tables, CLOCK, tf, "c1"))


class Counted:
    """Transactions of a table without files; ``reads`` counts how often their rows are read."""

    def __init__(self, spark, rows):
        self.seen = spark.sparkContext.accumulator(0)
        seen, df = self.seen, transactions(spark, rows)
        self.n = len(rows)

        def tell(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        self.df = df.mapInArrow(tell, df.schema)

    def reads(self):
        out, self.seen.value = self.seen.value / self.n, 0
        return out


def test_first_build_reads_the_facts_once_and_later_ones_find_every_change(spark, tmp_path):
    rows = [r for r in chain_rows(400) if r[0] < CLOCK.replace(hour=0, minute=0, second=0)]
    facts = Counted(spark, rows)
    tables = registry(spark, facts.df)
    names = tuple(rollups.ROLLUPS)
    for name in names:
        rollups.refresh(spark, tables, str(tmp_path / "r"), CLOCK, (name,))
        assert facts.reads() == 1, name
    stored.senders(spark, tables, str(tmp_path / "s"), CLOCK)
    assert facts.reads() == 1
    # Nothing changed: the digests carried along are those of the rows, which are read once to see it.
    assert set(map(tuple, rollups.refresh(spark, tables, str(tmp_path / "r"), CLOCK).values())) == {()}
    assert facts.reads() == len(names)
    swapped = [(t, "0xnew" if k == 7 else s, a, h) for k, (t, s, a, h) in enumerate(rows)]
    later = registry(spark, transactions(spark, swapped))
    day = rows[7][0].date()
    assert rollups.refresh(spark, later, str(tmp_path / "r"), CLOCK) == {"daily_activity": [day], "hourly_fees": [], "target_activity": [day]}
    state = stored.senders(spark, later, str(tmp_path / "s"), CLOCK)
    check_users(state, later)
    for name, (direct, *_) in rollups.ROLLUPS.items():
        same(rollups.read(spark, later, str(tmp_path / "r"), name, CLOCK), direct(later, CLOCK))
