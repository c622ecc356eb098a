"""Compare registered queries with their DuckDB text: ``python tests/oracle_check.py [prefix ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from workload.views import BASE_TABLES  # noqa: E402


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "asDict"):
        v = v.asDict(recursive=True)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _key(row):
    return tuple((v is None, type(v).__name__, str(v)) for v in row)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty text when both agree, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    raw = rel.fetchall()
    if sorted(names) != cols:
        return f"columns differ: {cols} vs {sorted(names)}"
    want = [tuple(norm(r[names.index(c)]) for c in cols) for r in raw]
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    if not want:
        return "no rows"
    bad = [(a, b) for a, b in zip(sorted(got, key=_key), sorted(want, key=_key)) if a != b]
    types = {c: (type(a).__name__, type(b).__name__) for c, a, b in zip(cols, got[0], want[0])
             if type(a) is not type(b) and a is not None and b is not None}
    if bad:
        return f"{len(bad)} rows differ in {cols}, e.g. {bad[0]}"
    return f"types differ: {types}" if types else ""


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    from stepweave.session import spark_session

    spark = spark_session(**{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                             "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = connect(sf)
    bad = 0
    for q in entry.queries():
        if len(sys.argv) > 1 and not any(q.startswith(p) for p in sys.argv[1:]):
            continue
        t0 = time.time()
        try:
            problem = compare(spark, con, q, sf)
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {q:32s} {time.time() - t0:6.2f}s {problem[:900]}", flush=True)
    print("failures:", bad)
