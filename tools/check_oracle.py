"""Run every registered query in Spark and its oracle SQL in DuckDB and compare.

Usage: python tools/check_oracle.py [sf_dir] [name ...]
Compares row count, column names and the multiset of rows (doubles compared at 5
decimals; ``--strict`` compares the exact values).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tablesight.plans.registry import oracle_sql, queries  # noqa: E402
from tablesight.plans.tables import TABLES  # noqa: E402
from tablesight.session import get_spark  # noqa: E402


STRICT = "--strict" in sys.argv


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if STRICT else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _family_spark(t: str) -> str:
    if t in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if t in ("float", "double"):
        return "float"
    return {"string": "str", "boolean": "bool"}.get(t, "decimal" if t.startswith("decimal") else t)


def _family_duck(t: str) -> str:
    t = t.upper()
    if t in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT"):
        return "int"
    if t in ("FLOAT", "DOUBLE"):
        return "float"
    if t.startswith("DECIMAL"):
        return "decimal"
    return {"VARCHAR": "str", "BOOLEAN": "bool"}.get(t, t.lower())


def main() -> int:
    args = [a for a in sys.argv[1:] if a != "--strict"]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            cols = sdf.columns
            srows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(srows)} rows ({dt:.1f}s) [no oracle]")
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = [tuple(_norm(x) for x in r) for r in cur.fetchall()]
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(exc)[:400]}")
            bad += 1
            continue
        if sorted(cols) != sorted(dcols):
            print(f"FAIL {name}: columns {cols} vs {dcols}")
            bad += 1
            continue
        stypes = {n: _family_spark(t) for n, t in sdf.dtypes}
        dtypes = {d[0]: _family_duck(str(d[1])) for d in cur.description}
        type_diff = {c: (stypes[c], dtypes[c]) for c in cols if stypes[c] != dtypes[c]}
        if type_diff:
            print(f"TYPE {name}: {type_diff}")
        idx = [dcols.index(c) for c in cols]
        drows = [tuple(r[i] for i in idx) for r in drows]
        key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
        s1, s2 = sorted(srows, key=key), sorted(drows, key=key)
        if s1 != s2:
            diff = [(a, b) for a, b in zip(s1, s2) if a != b][:3]
            print(f"FAIL {name}: rows {len(s1)} vs {len(s2)}; first diffs {diff}")
            bad += 1
        else:
            print(f"OK   {name}: {len(s1)} rows ({dt:.1f}s)")
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
