"""Logical tables derived from the driver's TPC-H-like Parquet tables (test and bench fixtures).

The derivations are fixed by FIXTURES.md so that Spark and the DuckDB oracle read identical rows; the SQL twin of
each view lives in :mod:`ledgerlens.oracle`. Two registries exist:

* :func:`long_history` - seven years of midnight timestamps from ``lineitem``/``orders``/``part``;
* :func:`intraday` - thirty days of sub-second timestamps from ``events`` (trailing-day cards, hourly prices).

All derivations are DataFrame expressions: column pruning and filters of the metrics reach the source scans.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import Tables

# Fixed clocks of the fixtures (FIXTURES.md).
LONG_AS_OF = dt.datetime(2001, 7, 15, 12, 0, 0)
RETENTION_AS_OF = dt.datetime(1995, 7, 15, 12, 0, 0)
INTRADAY_AS_OF = dt.datetime(2024, 1, 29, 12, 0, 0)
COMMITS_AS_OF = dt.datetime(2024, 1, 30, 0, 0, 0)
REPORT_START = dt.date(2000, 1, 1)
REPORT_END = dt.date(2000, 1, 31)
# Chains of the fixture deployments table and the chain key of the fixture TVL payloads.
FIXTURE_CHAINS = ("c1", "c2", "c3")
FIXTURE_TVL_CHAIN = "c1"


def _dec(col: Column, p: int, s: int = 0) -> Column:
    return col.cast(f"decimal({p},{s})")


def _reader(spark: SparkSession, sf_dir: str):
    """Reader of the driver tables: one read per table and registry."""
    cache: dict[str, DataFrame] = {}

    def read(name: str) -> DataFrame:
        if name not in cache:
            cache[name] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
        return cache[name]

    return read


def _price(billionths: Column) -> Column:
    """A price of nine places from its whole number of 1e-9."""
    return _dec(_dec(billionths, 18) * _dec(F.lit("0.000000001"), 9, 9), 20, 9)


def _fee_stream(col: Column) -> Column:
    # Order priority -> fee stream.
    return (
        F.when(col == "1-URGENT", "batch")
        .when(col == "2-HIGH", "verify")
        .when(col == "3-MEDIUM", "bridge")
        .when(col == "4-NOT SPECIFIED", "l1_oracle")
        .otherwise("l2_oracle")
    )


def _common(read) -> dict:

    def contracts() -> DataFrame:
        o = read("orders")
        address = F.when(F.col("o_orderkey") < 20, F.concat(F.lit("Brand#"), (F.col("o_orderkey") + 1).cast("string"))).otherwise(
            F.concat(F.lit("C"), F.col("o_orderkey").cast("string"))
        )
        return o.select(address.alias("address"), F.col("o_custkey").cast("string").alias("deployer"), F.col("o_orderdate").alias("block_timestamp"))

    def labels_apps() -> DataFrame:
        brands = read("part").select(F.col("p_brand").alias("address")).distinct()
        k = F.substring("address", 7, 100).cast("int")
        t = brands.withColumn("k", k).filter(F.col("k") <= 15)
        # Label categories by k mod 4.
        category = F.when(F.col("k") % 4 == 0, "ERC20").when(F.col("k") % 4 == 1, "DEX").when(F.col("k") % 4 == 2, "NFT").otherwise("LENDING")
        return t.select(
            "address",
            F.concat(F.lit("App_"), (F.col("k") % 6).cast("string")).alias("name"),
            F.when(F.col("k") % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("app-"), (F.col("k") % 6).cast("string"))).alias("slug"),
            category.alias("category"),
        )

    def fee_events() -> DataFrame:
        o = read("orders")
        # Amounts of 18 places: the price in cents times a fixed share of a unit.
        cents = _dec(_dec(F.col("o_totalprice"), 18, 2) * 100, 12)
        return o.select(
            F.col("o_orderdate").alias("block_timestamp"),
            _fee_stream(F.col("o_orderpriority")).alias("stream"),
            (cents * _dec(F.lit("0.000000123456789123"), 18, 18)).alias("gas_spend"),
            (cents * _dec(F.lit("0.000123456789123457"), 18, 18)).alias("gas_spend_usd"),
        )

    def fee_table(stream: str, rename: str | None = None):
        def build() -> DataFrame:
            df = fee_events().filter(F.col("stream") == stream).drop("stream")
            return df.withColumnRenamed("gas_spend", rename) if rename else df

        return build

    def deployments() -> DataFrame:
        o = read("orders")
        chain = F.when(F.col("o_orderkey") % 3 == 0, "c1").when(F.col("o_orderkey") % 3 == 1, "c2").otherwise("c3")
        return o.select(
            chain.alias("chain"),
            F.col("o_custkey").cast("string").alias("deployer"),
            F.col("o_orderdate").alias("created_at"),
            F.when(F.col("o_orderpriority") == "5-LOW", "erc20").otherwise("none").alias("token_type"),
            F.when(F.col("o_totalprice") > 50000, 1).otherwise(0).alias("is_min_length"),
            F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("is_used"),
        )

    def git_commits() -> DataFrame:
        e = read("events")
        return e.select(F.col("ts").alias("date"), F.col("user_id").cast("string").alias("username"))

    def protocol_tvl() -> DataFrame:
        # One JSON payload per slug of the fixture labels, except app-5 (a slug without payload).
        brands = read("part").select(F.col("p_brand"), F.col("p_retailprice"))
        k = F.substring("p_brand", 7, 100).cast("int")
        per_slug = (
            brands.withColumn("k", k)
            .filter((F.col("k") <= 15) & (F.col("k") % 5 != 0))
            .groupBy(F.concat(F.lit("app-"), (F.col("k") % 6).cast("string")).alias("slug"))
            .agg(_dec(F.sum(_dec(F.col("p_retailprice"), 18, 2)), 18, 2).alias("tvl"))
            .filter(F.col("slug") != "app-5")
        )
        payload = F.to_json(
            F.struct(F.struct(F.col("tvl").alias(FIXTURE_TVL_CHAIN), (F.col("tvl") * 2).alias("c2")).alias("currentChainTvls"))
        )
        return per_slug.select("slug", payload.alias("payload"))

    return {
        "contracts": contracts,
        "labels_apps": labels_apps,
        "l1_batch_fees": fee_table("batch"),
        "l1_verification_fees": fee_table("verify"),
        "l1_bridge_revenue": fee_table("bridge", "bridge_fee"),
        "l1_gas_oracle_fees": fee_table("l1_oracle"),
        "l2_gas_oracle_fees": fee_table("l2_oracle"),
        "deployments": deployments,
        "git_commits": git_commits,
        "protocol_tvl": protocol_tvl,
    }


def _long_transactions(read, li: DataFrame, target: Column) -> DataFrame:
    # Dimension sides of the fixture joins are small; the planner broadcasts them.
    o = read("orders").select("o_orderkey", "o_custkey")
    p = read("part").select("p_partkey", "p_brand")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("hash"),
        F.col("l_shipdate").alias("block_timestamp"),
        F.col("o_custkey").cast("string").alias("from_address"),
        target.alias("to_address"),
        # Whole numbers go through bigint, which casts to a decimal faster than a double does.
        _dec(F.when(F.col("l_returnflag") == "N", F.lit(0).cast("bigint")).otherwise(F.round("l_quantity").cast("bigint")), 38).alias("value"),
        _dec(_dec(F.round("l_extendedprice").cast("bigint"), 20) * _dec(F.lit(100000000000000), 15) + (F.col("l_orderkey") * 7919 + F.col("l_linenumber")), 26).alias("receipt_l1_fee"),
        _dec(F.round(F.col("l_discount") * 100).cast("bigint") * (F.lit(1000000000000) + F.col("l_suppkey")), 20).alias("receipt_effective_gas_price"),
        _dec(F.round(F.col("l_quantity") * 100000).cast("bigint"), 8).alias("receipt_gas_used"),
    )


def long_history(spark: SparkSession, sf_dir: str) -> Tables:
    read = _reader(spark, sf_dir)

    def transactions() -> DataFrame:
        return _long_transactions(read, read("lineitem"), F.col("p_brand"))

    def token_prices_hourly() -> DataFrame:
        o = read("orders").select(F.date_trunc("hour", "o_orderdate").cast("timestamp_ntz").alias("hour"), "o_orderdate")
        day = F.dayofyear("o_orderdate").cast("bigint")
        eth = o.select("hour", F.lit("ETH").alias("symbol"), _price((1000 + day) * 1000000000 + day * 1234567).alias("usd_price")).distinct()
        btc = o.select("hour", F.lit("BTC").alias("symbol"), _price(F.lit(30000000000000)).alias("usd_price")).distinct()
        return eth.unionByName(btc)

    factories = _common(read)
    factories.update({"transactions": transactions, "token_prices_hourly": token_prices_hourly})
    return Tables(factories)


def late_senders(spark: SparkSession, sf_dir: str) -> Tables:
    """The long history with senders that first appear late: two of three change their name every four months."""
    base = long_history(spark, sf_dir)

    def transactions() -> DataFrame:
        ts, sender = F.col("block_timestamp"), F.col("from_address")
        third = F.floor((F.year(ts) * 12 + F.month(ts)) / 4).cast("int").cast("string")
        return base["transactions"].withColumn("from_address", F.when(sender.cast("int") % 3 == 0, sender).otherwise(F.concat(sender, F.lit("@"), third)))

    return base.with_tables(transactions=transactions)


def dense(spark: SparkSession, sf_dir: str) -> Tables:
    """The long history's rows within four weeks before ``LONG_AS_OF`` and on 40 contracts: many wallets per day and target."""
    base = long_history(spark, sf_dir)
    read = _reader(spark, sf_dir)

    def transactions() -> DataFrame:
        li = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_suppkey")
        back = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_orderkey") % 14).otherwise(F.col("l_orderkey") % 28).cast("int")
        moved = li.withColumn("l_shipdate", F.lit("2001-07-15 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(back))
        return _long_transactions(read, moved, F.when(F.col("l_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("C"), (F.col("l_partkey") % 40 + 20).cast("string"))))

    return base.with_tables(transactions=transactions)


def intraday(spark: SparkSession, sf_dir: str) -> Tables:
    read = _reader(spark, sf_dir)

    def transactions() -> DataFrame:
        e = read("events")
        wei_unit = _dec(F.lit(100000000000000), 15)
        return e.select(
            F.col("event_id").cast("string").alias("hash"),
            F.col("ts").alias("block_timestamp"),
            F.col("user_id").cast("string").alias("from_address"),
            F.col("event_type").alias("to_address"),
            F.lit(None).cast("decimal(38,0)").alias("value"),
            _dec(_dec(F.round(F.col("value") * 100), 20) * wei_unit + F.col("event_id") * 31, 26).alias("receipt_l1_fee"),
            _dec(_dec(F.col("event_id") % 10, 5) * (wei_unit + F.col("event_id") % 977), 20).alias("receipt_effective_gas_price"),
            _dec(21000 + F.col("event_id") % 1000, 8).alias("receipt_gas_used"),
        )

    def token_prices_hourly() -> DataFrame:
        e = read("events").filter(F.hour("ts") != 3)
        return e.select(
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
            F.lit("ETH").alias("symbol"),
            _price((1000 + F.dayofyear("ts").cast("bigint") * 10 + F.hour("ts")) * 1000000000 + F.dayofyear("ts") * 7654321 + F.hour("ts") * 1357).alias("usd_price"),
        ).distinct()

    factories = _common(read)
    factories.update({"transactions": transactions, "token_prices_hourly": token_prices_hourly})
    return Tables(factories)
