"""Write PLANS.md: the physical plan of each headline metric over day-partitioned Parquet tables.

Usage: ``python tools/plan_excerpts.py [sf_dir] [out]``. The fixture tables are written once to a fresh scratch
folder (transactions and fee tables by day), read back through ``Tables.from_parquet`` (the production path), and
for each metric the operator tree of ``explain("formatted")`` is kept together with the pushed filters, partition
filters and read schema of every scan.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.plans import bd, deployers, economics, report, users  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402
from ledgerlens.sources import fixtures as fx  # noqa: E402
from ledgerlens.sources.layout import write_fact_table  # noqa: E402
from ledgerlens.sources.registry import Tables  # noqa: E402

DAY_PARTITIONED = ["transactions", "l1_batch_fees", "l1_verification_fees"]
TABLES = DAY_PARTITIONED + ["contracts", "labels_apps", "token_prices_hourly", "l1_bridge_revenue", "l1_gas_oracle_fees", "l2_gas_oracle_fees", "deployments"]

L = fx.LONG_AS_OF
METRICS = {
    "Q1-Q6 user cards, one scan (`users.cards`)": lambda t: users.cards(t, L),
    "Q7 active wallets per week (`users.active_accounts_chart`)": lambda t: users.active_accounts_chart(t, L, "week"),
    "Q9 cohort retention by month (`users.retention_chart`)": lambda t: users.retention_chart(t, fx.RETENTION_AS_OF, "month"),
    "Q10 top-10 + Other by transactions (`users.contract_transactions_chart`)": lambda t: users.contract_transactions_chart(t, L, "week"),
    "Q11 top-10 + Other by fees (`users.contract_gas_chart`)": lambda t: users.contract_gas_chart(t, L, "week"),
    "Q12 trending contracts (`users.trending_contracts`)": lambda t: users.trending_contracts(t, L, "week"),
    "Q13 leaderboard (`bd.leaderboard`)": lambda t: bd.leaderboard(t, L, "month"),
    "Q14 gross profit per month (`economics.gross_profit`)": lambda t: economics.gross_profit(t, L, "month"),
    "Q18 profit, trailing week (`economics.scalar_profit`)": lambda t: economics.scalar_profit(t, L, "week"),
    "Q27 new vs returning deployers (`deployers.returning_key_deployers`)": lambda t: deployers.returning_key_deployers(t, L, "week", "c1"),
    "Q28 key deployers of three chains (`deployers.chain_key_deployers`)": lambda t: deployers.chain_key_deployers(t, L, "week", fx.FIXTURE_CHAINS),
    "Q31 daily report (`report.report`)": lambda t: report.report(t, fx.REPORT_START, fx.REPORT_END, L),
}


NOTES = {
    "Q1-Q6": "Two-level flag aggregate: partial aggregate per sender before the one shuffle; partition filters keep two months.",
    "Q7": "Partial aggregate on (week, sender) before the shuffle, then a count per week; the cut is on the raw timestamp.",
    "Q9": "One aggregate per sender (first month, bitmask of active months), exploded to at most 6 rows, counted; no self-join, no window; cohort sizes are a broadcast of at most 6 rows.",
    "Q10": "The initial plan repeats the per-(week, project) aggregate under the union; at runtime AQE reuses its shuffle (ReusedExchange, pinned by tests/test_plans.py), so the facts are read once. WindowGroupLimit runs before and after the shuffle by week.",
    "Q11": "Rows are reduced to (week, target, flag, wallet) with fees pre-summed before the contract join; reuse as for Q10.",
    "Q12": "Two-level aggregate per target first (tagged wallet/hash rows, keyed by value in the first shuffle), then the contract test as a semi join of one row per address; top 20 by TakeOrderedAndProject.",
    "Q13": "Transactions meet the (broadcast) label table; each row is tagged twice (wallet, hash) and a two-level aggregate gives the four conditional distinct counts and both fee sums.",
    "Q14": "Hourly revenue aggregate before the price join; per-month cost aggregates are broadcast (one row per month).",
    "Q18": "Revenue and both cost tables in one global aggregate over a tagged union; all three scans partition-pruned to the week.",
    "Q27": "Distinct (deployer, week, week-of-first) rows before the per-deployer window.",
    "Q28": "One aggregate keyed by (chain, week), per-chain rolling window, pivot with the fixed chain list.",
    "Q31": "Seven daily aggregates over the pruned range, star-joined by broadcast (at most one row per day of the range).",
}


def excerpt(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    tree, _, details = text.partition("\n\n\n")
    scans = []
    for block in details.split("\n\n"):
        if block.lstrip().startswith("(") and "Scan parquet" in block.split("\n")[0]:
            keep = [line for line in block.split("\n") if line.startswith(("(", "Location", "PartitionFilters", "PushedFilters", "ReadSchema"))]
            scans.append("\n".join(re.sub(r"InMemoryFileIndex \[file:[^\]]*/", "InMemoryFileIndex [", k) for k in keep))
    return tree.strip() + "\n\n" + "\n\n".join(scans)


def main(argv: list[str]) -> None:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    out = argv[2] if len(argv) > 2 else os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    spark = local_session(8, 8)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    root = tempfile.mkdtemp(prefix="ledgerlens-plans-", dir=os.environ.get("TMPDIR", "/tmp"))
    src = fx.long_history(spark, sf_dir)
    for name in TABLES:
        if name in DAY_PARTITIONED:
            write_fact_table(name, src[name], f"{root}/{name}")
        else:
            src[name].write.parquet(f"{root}/{name}")
    tables = Tables.from_parquet(spark, root, TABLES)
    parts = [
        "# Physical plans of the headline metrics\n",
        f"Generated by `tools/plan_excerpts.py` from `{sf_dir}`: fixture tables written as Parquet (transactions and fee",
        "tables partitioned by day), read through `Tables.from_parquet`, `local[8]`, AQE on (initial plans; AQE re-plans",
        "at runtime). Scan details keep pushed filters, partition filters and the read schema.\n",
    ]
    for title, build in METRICS.items():
        note = NOTES.get(title.split(" ")[0], "")
        parts.append(f"## {title}\n\n{note}\n\n```\n{excerpt(build(tables))}\n```\n")
    with open(out, "w") as fh:
        fh.write("\n".join(parts))
    print(out)


if __name__ == "__main__":
    main(sys.argv)
