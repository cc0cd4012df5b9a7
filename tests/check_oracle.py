"""Compares registered queries with their oracle SQL in DuckDB: ``python tests/check_oracle.py [names...]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from reelmark.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else f
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple((x is not None, str(x)) for x in row)


def main():
    sf = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    spark = build_session("check", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="reelmark-check-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, job in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t0 = time.time()
        try:
            df = job(spark, sf)
            rows = df.collect()
            took = time.time() - t0
            if name not in oracles:
                print(f"{name:32} rows-only {len(rows):7} {took:6.1f}s", flush=True)
                if not rows:
                    bad.append(name)
                continue
            t1 = time.time()
            cur = con.execute(oracles[name])
            names_o = [c[0] for c in cur.description]
            want = cur.fetchall()
            cols = sorted(df.columns)
            if sorted(names_o) != cols:
                print(f"{name:32} COLUMNS {sorted(names_o)} vs {cols}")
                bad.append(name)
                continue
            a = sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=key)
            pos = [names_o.index(c) for c in cols]
            b = sorted((tuple(norm(r[p]) for p in pos) for r in want), key=key)
            ok = a == b
            print(f"{name:32} {'OK' if ok else 'DIFF':5} {len(a):7}/{len(b):<7} spark {took:5.1f}s duck {time.time() - t1:5.1f}s", flush=True)
            if not ok or not a:
                bad.append(name)
            if not ok:
                sa, sb = set(a), set(b)
                print("   cols", cols)
                for r in sorted(sa - sb, key=key)[:3]:
                    print("   spark", str(r)[:600])
                for r in sorted(sb - sa, key=key)[:3]:
                    print("   duck ", str(r)[:600])
        except Exception as e:  # noqa: BLE001
            print(f"{name:32} ERROR {str(e)[:900]}", flush=True)
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
