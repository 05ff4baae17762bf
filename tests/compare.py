"""Run queries and their SQL twins side by side: python -m tests.compare [scale] [name ...]"""

from __future__ import annotations

import glob
import hashlib
import math
import os
import sys
import time

import duckdb


def connection(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(glob.glob(f"{base}/*.parquet")):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else round(f, 6) + 0.0
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in sorted(v.items())}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def compare(spark, base: str, name: str, query, sql: str) -> str:
    began = time.time()
    df = query(spark, base)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    rel = connection(base).execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}"
    if got == want:
        return f"ok {len(got)} rows {took:.1f}s {hashlib.md5(''.join(got).encode()).hexdigest()[:6]}"
    a, b = [x for x in got if x not in set(want)], [x for x in want if x not in set(got)]
    return f"DIFFERS {len(got)} against {len(want)}: only Spark {a[:2]}, only SQL {b[:2]}"


if __name__ == "__main__":
    import __spark_entry__ as e

    from reqloom.session import local_session

    base = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark = local_session()
    q, s = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or q:
        for n in [k for k in q if k == name or (name.endswith("*") and k.startswith(name[:-1]))]:
            try:
                if n in s:
                    print(n, compare(spark, base, n, q[n], s[n]), flush=True)
                else:
                    began = time.time()
                    print(n, "no SQL,", q[n](spark, base).count(), f"rows {time.time() - began:.1f}s", flush=True)
            except Exception as x:  # noqa: BLE001
                print(n, "ERROR", str(x)[:1500], flush=True)
    spark.stop()
