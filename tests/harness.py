"""Spark-versus-DuckDB comparison of registered queries (the same checks as the driver's correctness gate).

Usage: ``python tests/harness.py [sf_dir] [name-substring ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402,I001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


SPARK_TO_DUCK = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v) if not isinstance(v, str) else v


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, name: str, run, sql: str, sf_dir: str, con=None) -> dict:
    con = con or duck(sf_dir)
    t0 = time.time()
    df = run(spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    t_spark = time.time() - t0
    s_cols = df.columns
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows), "spark_sec": round(t_spark, 2)}
    res["columns_match"] = sorted(c.lower() for c in s_cols) == sorted(c.lower() for c in d_cols)
    if not res["columns_match"]:
        res["spark_cols"], res["oracle_cols"] = s_cols, d_cols
    a = rows_of([c.lower() for c in s_cols], s_rows)
    b = rows_of([c.lower() for c in d_cols], d_rows)
    res["values_match"] = a == b
    if not res["values_match"]:
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        res["only_spark"], res["only_oracle"] = diff_a, diff_b
    s_types = {f.name.lower(): SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    d_types = {c.lower(): str(t) for c, t in zip(d_cols, rel.types)}
    res["types_match"] = s_types == d_types
    if not res["types_match"]:
        res["spark_types"], res["oracle_types"] = s_types, d_types
    res["ok"] = res["columns_match"] and res["values_match"] and res["types_match"] and len(s_rows) == len(d_rows)
    return res


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    filters = [a for a in argv[1:] if not a.startswith("/")]
    from ledgerlens.catalog import catalog
    from ledgerlens.session import local_session

    spark = local_session(8, 8)
    con = duck(sf_dir)
    bad = 0
    for name, entry in catalog().items():
        if filters and not any(f in name for f in filters):
            continue
        try:
            res = compare(spark, name, entry.run, entry.sql, sf_dir, con)
        except Exception as exc:  # report and continue
            res = {"name": name, "ok": False, "error": f"{type(exc).__name__}: {str(exc)[:400]}"}
        bad += not res["ok"]
        print(res, flush=True)
    print(f"FAILED {bad}" if bad else "ALL OK")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
