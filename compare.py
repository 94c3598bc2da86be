"""Run the registered queries next to their SQL and report differences.

Usage: python compare.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

from auditloom.catalog import REGISTRY
from auditloom.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def cell(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0] == "--sf":
        sf, args = args[1], args[2:]
    spark = local_session("compare", 8)
    bad = 0
    for name in sorted(REGISTRY):
        if args and not any(name.startswith(a) for a in args):
            continue
        item, t0 = REGISTRY[name], time.time()
        try:
            df = item.run(spark, sf)
            got = rows_of(df.columns, df.collect())
            took = time.time() - t0
            if item.sql is None:
                print(f"rows  {name}: {len(got[1])} rows {took:.1f}s", flush=True)
                continue
            con = duckdb.connect()
            con.sql("SET TimeZone='UTC'")
            for t in TABLES:
                con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
            t1 = time.time()
            rel = con.sql(item.sql)
            want = rows_of(rel.columns, rel.fetchall())
            dtypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
            sql_took = time.time() - t1
            same = got == want
            bad += not same
            print(f"{'ok   ' if same else 'DIFF '} {name}: {len(got[1])} rows {took:.1f}s sql {sql_took:.1f}s", flush=True)
            if not same:
                print("   columns", got[0], want[0])
                g, w = set(got[1]), set(want[1])
                print("   spark only", sorted(g - w)[:3], len(g - w))
                print("   sql only  ", sorted(w - g)[:3], len(w - g))
            else:
                odd = [c for c in df.columns if dict(df.dtypes)[c] == "int" and dtypes[c] != "INTEGER" or dict(df.dtypes)[c] == "bigint" and dtypes[c] != "BIGINT" or dict(df.dtypes)[c] == "double" and dtypes[c] != "DOUBLE"]
                if odd:
                    print("   types", [(c, dict(df.dtypes)[c], dtypes[c]) for c in odd])
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:700]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
