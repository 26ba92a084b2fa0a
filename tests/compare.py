"""Run queries in Spark and their SQL in DuckDB, and compare the rows.

    python -m tests.compare [--sf 0.01] [prefix ...]
"""

import argparse
import math
import sys
import time
import traceback

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    import datetime
    import decimal
    import numpy as np
    if v is None:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark_df, con, sql):
    """None when equal, otherwise a text saying what differs."""
    sn, s = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    dn, d = rows([c[0] for c in cur.description], cur.fetchall())
    if sn != dn:
        return f"columns {sn} != {dn}", len(s)
    if len(s) != len(d):
        return f"rows {len(s)} != {len(d)}; spark {s[:2]} duck {d[:2]}", len(s)
    bad = [(x, y) for x, y in zip(s, d) if x != y]
    if bad:
        return f"{len(bad)} of {len(s)} rows differ, first: {bad[0]}", len(s)
    return None, len(s)


def main():
    from gridspark.queries import ORACLES, QUERIES
    from tests.conftest import make_session
    a = argparse.ArgumentParser()
    a.add_argument("--sf", default="0.01")
    a.add_argument("--trace", action="store_true")
    a.add_argument("prefix", nargs="*")
    args = a.parse_args()
    sf = f"/root/testdata/sf{args.sf}"
    spark, con = make_session(), duck(sf)
    fails = 0
    for name, fn in QUERIES.items():
        if args.prefix and not any(name.startswith(p) for p in args.prefix):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in ORACLES:
                msg, n = compare(df, con, ORACLES[name])
            else:
                msg, n = None, len(df.collect())
        except Exception as e:
            msg, n = f"{type(e).__name__}: {str(e)[:600]}", -1
            if args.trace:
                traceback.print_exc()
        fails += msg is not None
        flag = "ok  " if msg is None else "FAIL"
        print(f"{flag} {name} rows={n} {time.time() - t:.1f}s {'' if name in ORACLES else '(no sql)'} {msg or ''}", flush=True)
    print("failures:", fails)
    return fails


if __name__ == "__main__":
    sys.exit(min(main(), 1))
