"""Benchmark of the headline queries: every reference metric at its dashboard's default timeframe.

Runs on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1). Each query is built from the
fixture tables and executed in full through the ``noop`` sink (no driver collect); the reported time per query is
the best of ``$BENCH_REPEAT`` runs (default 3: the JVM and code generation warm up over the first runs; the
first-run times are reported too). Prints one JSON line.

``BENCH_ALL=1`` times every registered query instead of the headline set.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    from ledgerlens.catalog import catalog
    from ledgerlens.session import local_session

    spark = local_session(cpus, shuffle_partitions=cpus, memory=os.environ.get("BENCH_MEMORY", "16g"))
    entries = catalog()
    # JVM start-up and class loading belong to no query: one untimed query on the smallest fixtures first.
    entries["report"].run(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    selected = {n: e for n, e in entries.items() if os.environ.get("BENCH_ALL") == "1" or e.headline}
    timings: dict[str, float] = {}
    first: dict[str, float] = {}
    for name, entry in selected.items():
        best = None
        for i in range(repeat):
            t0 = time.perf_counter()
            entry.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            elapsed = time.perf_counter() - t0
            if i == 0:
                first[name] = round(elapsed, 3)
            best = elapsed if best is None else min(best, elapsed)
        timings[name] = round(best, 3)
        print(f"{name}: {timings[name]:.3f}s (first {first[name]:.3f}s)", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    result = {
        "metric": "headline_queries_total_warm",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "first_run": first,
        "first_run_total": round(sum(first.values()), 3),
        "n_queries": len(timings),
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
