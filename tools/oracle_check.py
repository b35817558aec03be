"""Run every registered query in Spark and its oracle SQL in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name ...]

Mirrors the driver's gate: same column names, same row count, and the same
multiset of rows (doubles compared exactly after both sides round).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _norm(v):
    if v is None:
        return ("", "")
    if isinstance(v, bool):
        return ("i", str(int(v)))
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        if isinstance(v, float) and math.isnan(v):
            return ("n", "nan")
        return ("f", repr(round(float(v), 9) + 0.0))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return ("l", repr([_norm(x) for x in v]))
    if isinstance(v, bool):
        return ("i", str(int(v)))
    if isinstance(v, int):
        return ("i", str(v))
    return ("s", str(v))


def _scalar(x):
    import pandas as pd
    if x is None or isinstance(x, (list, tuple)) or hasattr(x, "__len__") and not isinstance(x, str):
        return x
    try:
        if pd.isna(x):
            return None
    except (TypeError, ValueError):
        pass
    if hasattr(x, "item"):
        return x.item()
    return x


def compare(sp, dd):
    sc = sorted(sp.columns)
    dc = sorted(dd.columns)
    if sc != dc:
        return f"COLUMNS spark={sc} duck={dc}"
    if len(sp) != len(dd):
        return f"ROWS spark={len(sp)} duck={len(dd)}"
    import pandas as pd  # noqa: F401

    def rows(df):
        out = []
        for rec in df[sc].itertuples(index=False, name=None):
            out.append(tuple(_norm(_scalar(x)) for x in rec))
        return sorted(out)

    a, b = rows(sp), rows(dd)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"VALUES {len(bad)} rows differ; first: spark={bad[0][0]} duck={bad[0][1]}"
    return "OK"


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    import duckdb
    from fathom.plans.registry import ORACLE, QUERIES, load_all
    from fathom.plans.tables import TABLES
    from fathom.session import local_session
    load_all()
    spark = local_session(8, 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    names = args or list(QUERIES)
    ok = 0
    for n in names:
        t0 = time.time()
        try:
            sp = QUERIES[n](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} SPARK-ERROR {str(e)[:400]}")
            continue
        ts = time.time() - t0
        if n not in ORACLE:
            print(f"{n:28s} rows-only {len(sp)} rows ({ts:.1f}s)")
            continue
        try:
            dd = con.execute(ORACLE[n]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} DUCK-ERROR {str(e)[:400]}")
            continue
        res = compare(sp, dd)
        ok += res == "OK"
        print(f"{n:28s} {res} [{len(sp)} rows, {ts:.1f}s]")
    print(f"{ok}/{len([n for n in names if n in ORACLE])} oracle matches")


if __name__ == "__main__":
    main()
