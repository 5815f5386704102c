"""Run the registered queries and compare them with their SQL twins.

    python tools/check_queries.py [--sf 0.01] [key or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "float": "FLOAT", "date": "DATE"}


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(repr(v)) + 0.0
    return v


def rows_of(data, names, order):
    idx = [names.index(c) for c in order]
    out = [tuple(norm(r[i]) for i in idx) for r in data]
    return sorted(out, key=repr)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("keys", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--no-oracle", action="store_true")
    args = ap.parse_args()
    from gradelake.plans import registry
    from gradelake.session import local_session

    registry.load_all()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    bad = 0
    spark.range(10).selectExpr("sum(id)").collect()
    for key, fn in registry.QUERIES.items():
        if args.keys and not any(key.startswith(k) for k in args.keys):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            got = df.collect()
        except Exception as e:  # noqa: BLE001
            print(f"ERR   {key}: {str(e)[:1500]}")
            bad += 1
            continue
        dt = time.time() - t0
        sql = registry.ORACLES.get(key)
        if sql is None or args.no_oracle:
            print(f"rows  {key}: {len(got)} rows {dt:.2f}s  {[tuple(r) for r in got[:2]]}"[:400])
            continue
        t0 = time.time()
        try:
            cur = con.execute(sql)
            want = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"SQLERR {key}: {str(e)[:1200]}")
            bad += 1
            continue
        ds = time.time() - t0
        names = [d[0] for d in cur.description]
        types = {d[0]: str(d[1]).upper() for d in cur.description}
        stypes = {n: TYPES.get(t, t) for n, t in df.dtypes}
        problems = []
        if sorted(names) != sorted(df.columns):
            problems.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
        else:
            diff = {c: (stypes[c], types[c]) for c in names if stypes[c] != types[c]}
            if diff:
                problems.append(f"types {diff}")
            order = sorted(names)
            a, b = rows_of(got, df.columns, order), rows_of(want, names, order)
            if len(a) != len(b):
                problems.append(f"rows {len(a)} vs {len(b)}")
            if a != b:
                sa, sb = {repr(x) for x in a}, {repr(x) for x in b}
                only_a, only_b = sorted(sa - sb)[:2], sorted(sb - sa)[:2]
                problems.append(f"values {order}\n   spark {len(sa - sb)} {only_a}\n   sql   {len(sb - sa)} {only_b}"[:1500])
        status = "ok   " if not problems else "DIFF "
        bad += bool(problems)
        print(f"{status} {key}: {len(got)} rows {dt:.2f}s sql {ds:.2f}s {'; '.join(problems)}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
