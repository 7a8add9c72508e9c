"""Run registered queries in Spark and their SQL twins in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, fn, sql):
    """Return (ok, message, spark seconds)."""
    start = time.perf_counter()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.perf_counter() - start
    if sql is None:
        return bool(got), f"rows={len(got)} (no SQL)", took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", took
    left, right = rows_of(df.columns, got), rows_of(names, want)
    if left == right:
        return True, f"rows={len(left)}", took
    only_left = [r for r in left if r not in set(right)][:2]
    only_right = [r for r in right if r not in set(left)][:2]
    return False, f"rows {len(left)} vs {len(right)}\n   spark {only_left}\n   sql   {only_right}", took


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry_point
    from foliospark.session import get_spark

    sf, names = sys.argv[1], sys.argv[2:]
    sf_path = f"/root/testdata/sf{sf}"
    session = get_spark("oracle", master="local[8]", **{"spark.driver.memory": "16g"})
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sf_path)
    fns, sqls = entry_point.queries(), entry_point.oracle_sql()
    bad = 0
    for name in fns:
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            ok, message, took = compare(session, con, sf_path, fns[name], sqls.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, message, took = False, f"{type(exc).__name__}: {str(exc)[:400].split("JVM stacktrace")[0]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {took:6.2f}s {message}", flush=True)
    print("failed:", bad)
