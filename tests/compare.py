"""Runs registered jobs next to their SQL twins. ``python tests/compare.py [names...]``."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark_df, con, sql):
    got = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(spark_df.columns) != sorted(want_cols):
        return f"columns {sorted(spark_df.columns)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows_of(spark_df.columns, got), rows_of(want_cols, want)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} of {len(a)} rows differ, e.g.\n   {diff[0][0]}\n   {diff[0][1]}"
    types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    kinds = {d[0]: str(d[1]) for d in cur.description}
    fits = {
        "string": {"VARCHAR"}, "bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "date": {"DATE"},
        "boolean": {"BOOLEAN"}, "timestamp_ntz": {"TIMESTAMP"},
    }
    odd = [f"{n} {t} vs {kinds[n]}" for n, t in types.items() if kinds[n] not in fits.get(t, set())]
    return f"ok {len(a)} rows" + (f"  TYPES {odd}" if odd else "")


if __name__ == "__main__":
    from demandloom.plans.registry import load
    from demandloom.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), duck(sf)
    queries, oracles = load()
    names = [n for n in queries if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]
    for n in names:
        t0 = time.time()
        try:
            df = queries[n](spark, sf)
            msg = compare(df, con, oracles[n]) if n in oracles else f"rows only {df.count()} {df.columns}"
        except Exception as e:  # report and go on
            msg = "ERROR " + str(e)[:1500]
        print(f"{n:32s} {time.time() - t0:6.2f}s  {msg}", flush=True)
